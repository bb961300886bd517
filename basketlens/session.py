"""SparkSession construction and shared-storage settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "basketlens") -> SparkSession:
    """Return (or create) a session with the settings the operators assume.

    On a cluster the master and resources come from spark-submit; ``master``
    is only for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset.

    On a cluster the setting names a shared folder (HDFS/S3/...) that survives
    executor loss. Only local runs and tests fall back to a fresh temp folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not path and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="basketlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("_SCOPES", default=())
_SAVED: WeakSet[DataFrame] = WeakSet()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Frames ``saved`` in the block leave the disk at its end, shuffle files at the end of their query.

    Without it both stay until the driver's garbage collector finds them, if at
    all. Blocks nest; nothing lazy that reads a frame of a block outlives it.
    """
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        _SCOPES.reset(token)
        for path in mine:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str, scope: int = -1) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    For a frame that several branches of a plan read: its sources are evaluated
    once, the branches prune columns, and a lost executor costs a scan. It lasts
    as long as its ``scratch`` block: the innermost (-1), the one around that
    (-2) or the outermost (0); without such a block it stays.
    """
    return saved_in_parts([df], name, scope)


def saved_in_parts(frames: Iterable[DataFrame], name: str, scope: int = -1) -> DataFrame:
    """As ``saved``, for one frame that comes in parts, written one after another: the disk holds one part's shuffles."""
    path, scopes = None, _SCOPES.get()
    for df in frames:
        if path is None:
            spark = df.sparkSession
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
            if -len(scopes) <= scope < len(scopes):
                scopes[scope].append(path)
        df.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _SAVED.add(out)
    return out


def is_saved(df: DataFrame) -> bool:
    """Whether ``df`` is what ``saved`` returned: it need not be written again."""
    return df in _SAVED


def task_parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-heavy Python stages: at least one per core.

    Used with an explicit ``repartition(n)``, which AQE does not coalesce, so
    vectorised Python work is spread over every core instead of the one or
    two tasks a small aggregated input would otherwise be coalesced into.
    """
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(spark.sparkContext.defaultParallelism, min(shuffle, 4 * spark.sparkContext.defaultParallelism))
