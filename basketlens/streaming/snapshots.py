"""Incremental LTV snapshots (S10, S11): an append-only, versioned history and its trend.

A snapshot is identified by ``(snapshot_date, pipeline_version)``. A run writes
its rows under a run id of its own,

    data/snapshot_date=D/pipeline_version=V/run_id=R/...

and becomes visible only when its manifest entry, one small file committed at
the very end, appears under ``manifest/``. Readers start from the manifest: a
run that failed half-way or is still writing is never seen, two versions of a
date stay side by side, and running the same date and version again supersedes
the earlier run without touching its files.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SNAPSHOT_MEASURES = ["lifespan_years", "ltv", "annual_spend_rate", "churn_probability", "survival_probability",
                     "projected_ltv"]
KEY = ["snapshot_date", "pipeline_version"]
_MANIFEST = "run_id string, published long, snapshot_date date, pipeline_version string, rows long"


def write_run(rows: DataFrame, path: str) -> str:
    """Writes the rows of one run (they carry ``snapshot_date`` and ``pipeline_version``); nothing is visible yet."""
    run = uuid.uuid4().hex
    rows.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy(*KEY, "run_id").parquet(f"{path}/data")
    return run


def publish(spark: SparkSession, path: str, run: str) -> None:
    """Makes a written run visible: one manifest file with its snapshots and their rows."""
    written = _data(spark, path).where(F.col("run_id") == run).groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
    entry = written.select(F.lit(run).alias("run_id"), F.lit(time.time_ns()).alias("published"), *KEY, "rows")
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def append_snapshot(rows: DataFrame, path: str) -> None:
    """Write one run and publish it."""
    publish(rows.sparkSession, path, write_run(rows, path))


def _data(spark: SparkSession, path: str) -> DataFrame:
    """All written rows; folder names are read as text and dates, never guessed (a version 1.10 stays 1.10)."""
    types = {"snapshot_date": T.DateType(), "pipeline_version": T.StringType(), "run_id": T.StringType()}
    found = spark.read.parquet(f"{path}/data").schema
    schema = T.StructType([T.StructField(f.name, types.get(f.name, f.dataType), True) for f in found.fields])
    return spark.read.schema(schema).parquet(f"{path}/data")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The published snapshots: for each date and version the run published last."""
    m = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    w = Window.partitionBy(*KEY).orderBy(F.col("published").desc(), F.col("run_id"))
    return m.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def read_snapshots(spark: SparkSession, path: str, since: str | None = None, until: str | None = None,
                   version: str | None = None) -> DataFrame:
    """Rows of the published snapshots in a date range, of all versions or one.

    The manifest has a row per run, so the runs to read are known before the
    data is touched and become a filter on partition columns.
    """
    m = manifest(spark, path)
    if since:
        m = m.where(F.col("snapshot_date") >= F.lit(since).cast("date"))
    if until:
        m = m.where(F.col("snapshot_date") <= F.lit(until).cast("date"))
    if version:
        m = m.where(F.col("pipeline_version") == version)
    keep = m.select("snapshot_date", "pipeline_version", "run_id").collect()  # one row per published snapshot
    rows = _data(spark, path)
    if not keep:
        return rows.limit(0).drop("run_id")
    days = [r.snapshot_date for r in keep]
    rows = rows.where(F.col("snapshot_date").between(min(days), max(days)) & F.col("run_id").isin([r.run_id for r in keep]))
    return rows.join(F.broadcast(m.select(*KEY, "run_id")), [*KEY, "run_id"], "left_semi").drop("run_id")


def read_snapshot_history(spark: SparkSession, path: str, since: str | None = None,
                          until: str | None = None, version: str | None = None) -> DataFrame:
    """Snapshots in a date range with the change since each customer's previous snapshot of the same version.

    The predecessor of a customer's first row in the range may lie before it:
    the last snapshot of each customer before ``since`` is found by a partial
    aggregate over the measures compared and joins the window, then leaves the
    result. A window holds one customer's snapshots, one row per date.
    """
    compared = ("ltv", "projected_ltv", "churn_probability")
    df = read_snapshots(spark, path, since, until, version).withColumn("_asked", F.lit(True))
    if since:
        earlier = read_snapshots(spark, path, None, None, version).where(F.col("snapshot_date") < F.lit(since).cast("date"))
        last = earlier.groupBy("customer_id", "pipeline_version").agg(
            F.max(F.struct("snapshot_date", *compared)).alias("_last")).select("customer_id", "pipeline_version", "_last.*")
        df = df.unionByName(last.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy("customer_id", "pipeline_version").orderBy("snapshot_date")
    out = df.withColumn("previous_snapshot", F.lag("snapshot_date").over(w))
    for m in compared:
        out = out.withColumn(f"{m}_change", F.col(m) - F.lag(m).over(w))
    return out.where("_asked").drop("_asked")
