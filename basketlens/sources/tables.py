"""Scans, ingestion and exports.

Reads are declared, never inferred; every scan is a plain Parquet/CSV relation
so Catalyst pushes filters and prunes columns into it.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.core import numeric_text


def table_path(base_dir: str, name: str) -> str:
    return f"{base_dir.rstrip('/')}/{name}.parquet"


def load_table(spark: SparkSession, name: str, base_dir: str | None = None) -> DataFrame:
    """``SELECT * FROM name``: a catalog table, or ``<base_dir>/<name>.parquet``."""
    if base_dir is None:
        return spark.table(name)
    return spark.read.parquet(table_path(base_dir, name))


def register_tables(spark: SparkSession, base_dir: str, names: Iterable[str]) -> None:
    """Expose Parquet tables as temp views so ``sql`` can reference them."""
    for n in names:
        load_table(spark, n, base_dir).createOrReplaceTempView(n)


def sql(spark: SparkSession, text: str) -> DataFrame:
    """Run a SQL string over registered views (S3)."""
    return spark.sql(text)


def load_projected(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Explicit projection (S4); reaches the scan as ``ReadSchema``."""
    return df.select(*columns)


# Numeric types by width, and how one type is written in a cast.
_WIDTH = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both: equal types, the wider number, the later kind of time, or text."""
    if a == b:
        return a
    x, y = a.simpleString(), b.simpleString()
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if x in _WIDTH and y in _WIDTH:
        top = max(x, y, key=_WIDTH.index)
        # A float cannot hold every 32-bit or longer integer.
        return T.DoubleType() if top == "float" and min(x, y, key=_WIDTH.index) in ("int", "bigint") else {"tinyint": a, "float": T.FloatType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType()}[top]
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        whole = max(a.precision - a.scale, b.precision - b.scale)
        scale = max(a.scale, b.scale)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        other, dec = (b, a) if isinstance(a, T.DecimalType) else (a, b)
        digits = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}.get(other.simpleString())
        if digits is not None and max(dec.precision - dec.scale, digits) + dec.scale <= 38:
            return T.DecimalType(max(dec.precision - dec.scale, digits) + dec.scale, dec.scale)
        return T.DoubleType() if other.simpleString() in _WIDTH else T.StringType()
    times = ["date", "timestamp_ntz", "timestamp"]
    if x in times and y in times:
        return a if times.index(x) > times.index(y) else b
    return T.StringType()


def reconcile(schemas: Sequence[T.StructType]) -> T.StructType:
    """Union of the columns by name (case ignored, in order of first appearance), each of the widest type."""
    names: dict[str, str] = {}
    types: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            k = f.name.lower()
            names.setdefault(k, f.name)
            types[k] = wider(types[k], f.dataType) if k in types else f.dataType
    return T.StructType([T.StructField(names[k], types[k], True) for k in names])


def load_parts(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """Multi-part input as one relation.

    With a declared ``schema``, or for parts that agree, one reader takes all
    paths and the splits follow ``spark.sql.files.maxPartitionBytes``. Parts
    that differ are described by their own footers: columns are united by name,
    a column missing from a part is NULL there, and a column of several types
    takes the widest. Parts of equal schema share one scan. An unreadable part
    is an error.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).load(list(paths))
    alike: dict[str, tuple[T.StructType, list[str]]] = {}
    for p in paths:
        own = reader.load(p).schema
        alike.setdefault(own.json(), (own, []))[1].append(p)
    if len(alike) == 1:
        return reader.load(list(paths))
    whole = reconcile([own for own, _ in alike.values()])
    frames = []
    for own, group in alike.values():
        have = {f.name.lower(): f.name for f in own.fields}
        part = reader.schema(own).load(group)
        frames.append(part.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
                                    for f in whole.fields]))
    return reduce(DataFrame.unionByName, frames)


def coerce_numeric(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    """Text to number, unparsable to NULL, only for columns present."""
    present = set(df.columns)
    exprs = {c: numeric_text(c).cast(dtype) for c in columns if c in present}
    return df.withColumns(exprs) if exprs else df


def ingest_tables(spark: SparkSession, src_dir: str, dst_dir: str,
                  schemas: dict[str, T.StructType], fmt: str = "csv") -> DataFrame:
    """Load raw files with declared schemas and replace Parquet tables.

    Returns ``(table, status, rows)``; missing inputs are reported, not raised.
    Row counts come from the written Parquet footers (no second pass over
    the data).
    """
    out = []
    for name, schema in schemas.items():
        src = f"{src_dir.rstrip('/')}/{name}.{fmt}"
        if not _exists(spark, src):
            out.append((name, "missing", None))
            continue
        reader = spark.read.schema(schema)
        df = (reader.option("header", True).option("mode", "PERMISSIVE").csv(src)
              if fmt == "csv" else reader.format(fmt).load(src))
        dst = table_path(dst_dir, name)
        df.write.mode("overwrite").parquet(dst)
        out.append((name, "loaded", spark.read.parquet(dst).count()))
    return spark.createDataFrame(out, "table string, status string, rows bigint")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jsc = spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(jsc.hadoopConfiguration()).exists(p)


def export_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv",
                  mode: str = "overwrite") -> list[str]:
    """One output directory per table (S7 CSV, S8 Parquet for BI tools)."""
    paths = []
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        w = df.write.mode(mode)
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(path)
        paths.append(path)
    return paths


def export_snapshot(detail: DataFrame, aggregates: DataFrame, out_dir: str, run_ts: str,
                    detail_columns: Sequence[str] | None = None, dimension: str = "dimension") -> str:
    """Detail rows and one output per dimension under ``run_ts=<ts>/``, by one write.

    ``aggregates`` is long, with the dimension's name in a column. Detail and
    aggregates are one frame whose ``output`` column becomes the folder
    (``output=detail``, ``output=by_<dimension>``): a single job, committed as a
    whole. ``read_export`` gives an output back with its own columns.
    """
    base = os.path.join(out_dir, f"run_ts={run_ts}")
    d = (detail.select(*detail_columns) if detail_columns else detail).withColumn("output", F.lit("detail"))
    a = aggregates.withColumn("output", F.concat(F.lit("by_"), F.col(dimension))).drop(dimension)
    d.unionByName(a, allowMissingColumns=True).write.mode("overwrite").partitionBy("output").parquet(base)
    return base


def read_export(spark: SparkSession, base: str, output: str, columns: Sequence[str]) -> DataFrame:
    """One output of ``export_snapshot``; only its folder is read."""
    return spark.read.parquet(base).where(F.col("output") == output).select(*columns)
