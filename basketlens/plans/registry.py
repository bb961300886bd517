"""Registered queries: each operator bound to the retail views of the driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
over the same parquet files) form the correctness gate. Output columns are
aliased identically on both sides and carry engine-neutral types (double,
bigint, int, string, boolean, date).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.plans.oracle import with_views
from basketlens.sources import retail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return deco


def dbl(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]

