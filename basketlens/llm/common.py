"""Spark-side helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from basketlens.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint storage of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to shared storage and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside send Python ``rows`` rows in a batch; the session's own setting is restored.

    For wide rows: a batch lies in memory whole, in the JVM and in the Python worker.
    """
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def null_safe(left: DataFrame, right: DataFrame, key: str) -> Column:
    return left[key].eqNullSafe(right[key])


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): (node, root), root the smallest node.

    Alternates large-star and small-star steps; every round is one written
    table, and the loop ends when the edge set no longer changes (a failure to
    settle raises, it never returns partial components).
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = saved(e, "edges")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = saved(small, "edges")
        mark = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(mark) == last:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return nodes.unionByName(roots)
        last = tuple(mark)
    raise RuntimeError("connected components did not settle")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, out: str, xor: bool = False) -> DataFrame:
    """Sum (or XOR) of ``value`` over the rows before each row of its group, without a task per group.

    ``bucket`` is an ordinal column that agrees with ``order`` and splits the
    group; totals per bucket (one row each) give the offsets, and the row
    window runs inside a bucket.
    """
    total = F.bit_xor if xor else F.sum
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, bucket).agg(total(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"__{g}") for g in [*group, bucket]],
                       F.coalesce(total("__sum").over(before), F.lit(0)).alias("__before"))
    cond = None
    for g in [*group, bucket]:
        c = F.col(g).eqNullSafe(F.col(f"__{g}"))
        cond = c if cond is None else cond & c
    own = df.withColumn("__own", F.coalesce(total(value).over(inside), F.lit(0)))
    both = F.col("__before").bitwiseXOR(F.col("__own")) if xor else F.col("__before") + F.col("__own")
    return own.join(sums, cond).withColumn(out, both).drop("__before", "__own", *[f"__{g}" for g in [*group, bucket]])


def running_totals(df: DataFrame, group: list[str], bucket: str, order: list, totals: dict[str, tuple[Column, bool]]) -> DataFrame:
    """Several running totals over the rows before each row of its group, by one window and one table of buckets.

    ``totals`` maps an output column to (value, whether XOR instead of sum);
    ``bucket`` is as in ``running_total``.
    """
    def total(xor: bool, c: Column) -> Column:
        return F.bit_xor(c) if xor else F.sum(c)

    keys = [*group, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(*[total(x, v).alias(f"__sum_{o}") for o, (v, x) in totals.items()])
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys],
                       *[F.coalesce(total(x, F.col(f"__sum_{o}")).over(earlier), F.lit(0)).alias(f"__before_{o}") for o, (v, x) in totals.items()])
    own = df.select("*", *[F.coalesce(total(x, v).over(inside), F.lit(0)).alias(f"__own_{o}") for o, (v, x) in totals.items()])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    both = {o: F.col(f"__before_{o}").bitwiseXOR(F.col(f"__own_{o}")) if x else F.col(f"__before_{o}") + F.col(f"__own_{o}")
            for o, (v, x) in totals.items()}
    return own.join(sums, same).select(*df.columns, *[c.cast("long").alias(o) for o, c in both.items()])


def new_names(taken: list[str], wanted: list[str]) -> list[str]:
    """Column names like ``wanted`` that no column of ``taken`` has, in any case of letters."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def shielded(fn):
    """For operators that return ``docs``' columns: columns named ``__...`` pass through under other names."""
    @wraps(fn)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        marked = [c for c in docs.columns if c.startswith("__")]
        fresh = new_names(docs.columns, [f"shield{c}" for c in marked])
        out = fn(docs.withColumnsRenamed(dict(zip(marked, fresh))), *args, **kwargs)
        return out.withColumnsRenamed(dict(zip(fresh, marked)))

    return run
