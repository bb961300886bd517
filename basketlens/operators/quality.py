"""Data-quality checks.

Every check of a table comes from one scan and one narrow shuffle. A row is
reduced to a 128-bit digest (two 64-bit hashes with different seeds and column
orders) and a few long bit masks: one bit per column for NULL, one per text
column for the empty string and one for text that parses as a number. Rows of
equal digest and masks are counted, partially before the shuffle, so neither
texts nor vectors are ever moved and a row repeated a billion times is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.core import numeric_text, pround


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


MASK_BITS = 62


def _digest(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of the values; nested values as JSON, so that NULLs inside them count."""
    def plain(c: str) -> Column:
        nested = isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))
        return F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if nested else F.col(f"`{c}`")

    values = [plain(c) for c in cols]
    return [F.xxhash64(*values).alias("_d1"), F.xxhash64(F.lit(0x5DEECE66D), *reversed(values), F.lit(11)).alias("_d2")]


def _masks(flags: Sequence[Column]) -> list[Column]:
    """The flags as long bit masks, MASK_BITS to a mask."""
    parts = [list(flags[i:i + MASK_BITS]) for i in range(0, len(flags), MASK_BITS)] or [[]]
    return [reduce(Column.bitwiseOR, [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(p)], F.lit(0).cast("long")).alias(f"_f{n}")
            for n, p in enumerate(parts)]


def distinct_rows(df: DataFrame, cols: Sequence[str], flags: Sequence[Column]) -> DataFrame:
    """(_d1, _d2, _f0.., _bl_m): each distinct row by digest and flags, with its multiplicity; the flags must tell NULLs."""
    masks = _masks(flags)
    g = df.select(*_digest(df, cols), *masks)
    return g.groupBy(*g.columns).agg(F.count(F.lit(1)).alias("_bl_m"))


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first occurrence (A22); NULLs compare equal, as pandas."""
    cols = list(subset) if subset else df.columns
    g = distinct_rows(df, cols, [F.col(f"`{c}`").isNull() for c in cols])
    return g.select((F.col("_bl_m") - 1).alias("_x")).agg(F.coalesce(F.sum("_x"), F.lit(0)).cast("bigint").alias("duplicates"))


def profile_row(df: DataFrame) -> DataFrame:
    """Every per-table count as one row: _n rows, _c<i> non-nulls, _e<j> empty and _k<j> numeric texts, duplicates."""
    cols, strings = df.columns, _strings(df)
    flags = [F.col(f"`{c}`").isNull() for c in cols]
    flags += [F.coalesce(F.col(f"`{c}`") == "", F.lit(False)) for c in strings]
    flags += [numeric_text(F.col(f"`{c}`")).isNotNull() for c in strings]
    g = distinct_rows(df, cols, flags)

    def wsum(bit: int, on: bool) -> Column:
        is_on = F.col(f"_f{bit // MASK_BITS}").bitwiseAND(F.lit(1 << (bit % MASK_BITS)).cast("long")) != 0
        return F.coalesce(F.sum(F.when(is_on if on else ~is_on, F.col("_bl_m"))), F.lit(0)).cast("bigint")

    n, k = len(cols), len(strings)
    aggs = [F.coalesce(F.sum("_bl_m"), F.lit(0)).cast("bigint").alias("_n"), F.count(F.lit(1)).alias("_d")]
    aggs += [wsum(i, False).alias(f"_c{i}") for i in range(n)]
    aggs += [wsum(n + j, True).alias(f"_e{j}") for j in range(k)]
    aggs += [wsum(n + k + j, True).alias(f"_k{j}") for j in range(k)]
    return g.agg(*aggs).withColumn("duplicates", F.col("_n") - F.col("_d"))


def table_quality(df: DataFrame, table: str, row: DataFrame | None = None) -> DataFrame:
    """Per column: dtype, null count, null %, table duplicates, rows."""
    cols = df.columns
    row = row if row is not None else profile_row(df)
    dtypes = dict(df.dtypes)
    parts = [F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                      (F.col("_n") - F.col(f"_c{i}")).alias("null_count"),
                      pround(F.try_divide((F.col("_n") - F.col(f"_c{i}")) * 100.0, F.col("_n").cast("double")),
                             2).alias("null_pct"),
                      F.col("duplicates").alias("duplicates"), F.col("_n").alias("row_count"))
             for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def empty_string_check(df: DataFrame, table: str, row: DataFrame | None = None) -> DataFrame:
    """Text columns containing '' with count and % of rows."""
    strings = _strings(df)
    schema = "table string, column string, empty_strings bigint, pct double"
    if not strings:
        return df.sparkSession.createDataFrame([], schema)
    row = row if row is not None else profile_row(df)
    parts = [F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.col(f"_e{j}").alias("empty_strings"),
                      pround(F.try_divide(F.col(f"_e{j}") * 100.0, F.col("_n").cast("double")), 2).alias("pct"))
             for j, c in enumerate(strings)]
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*").filter(F.col("empty_strings") > 0)


def numeric_text_check(df: DataFrame, table: str, min_rate: float = 0.8, row: DataFrame | None = None) -> DataFrame:
    """Text columns whose non-null values mostly parse as numbers."""
    cols, strings = df.columns, _strings(df)
    schema = "table string, column string, dtype string, numeric_pct double, flag string"
    if not strings:
        return df.sparkSession.createDataFrame([], schema)
    row = row if row is not None else profile_row(df)
    parts = [F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit("string").alias("dtype"),
                      F.col(f"_c{cols.index(c)}").alias("_nn"), F.col(f"_k{j}").alias("_ok"))
             for j, c in enumerate(strings)]
    s = row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    rate = F.col("_ok") / F.col("_nn")
    return (s.filter((F.col("_nn") > 0) & (F.col("_ok") > 0) & (rate > min_rate))
             .select("table", "column", "dtype", pround(rate * 100, 1).alias("numeric_pct"),
                     F.lit("Likely numeric stored as text").alias("flag")))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Distinct child keys without a parent row (J2, U4); NULL child keys are not counted.

    The parent side is reduced to its distinct keys first (the category
    check joins many-to-many otherwise), then a left-anti join.
    """
    pk = parent_key or child_key
    keys = parent.select(F.col(pk).alias(child_key)).distinct()
    missing = child.select(child_key).join(keys, child_key, "left_anti")
    return missing.agg(F.count_distinct(child_key).alias("orphaned"))


def _table_checks(df: DataFrame, table: str, min_rate: float = 0.8) -> DataFrame:
    """All checks of one table, exploded from its one profile row."""
    cols, strings = df.columns, _strings(df)

    def check(name: str, column: str | None, value: Column, status: Column, when: Column | None = None) -> Column:
        s = F.struct(F.lit(name).alias("check"), F.lit(table).alias("table"), F.lit(column).cast("string").alias("column"),
                     value.cast("double").alias("value"), status.alias("status"))
        return s if when is None else F.when(when, s)

    def passed(c: Column) -> Column:
        return F.when(c == 0, "PASS").otherwise("FAIL")

    nulls = [F.col("_n") - F.col(f"_c{i}") for i in range(len(cols))]
    rate = [F.try_divide(F.col(f"_k{j}").cast("double"), F.col(f"_c{cols.index(c)}").cast("double")) for j, c in enumerate(strings)]
    parts = [check("nulls", c, x, passed(x)) for c, x in zip(cols, nulls)]
    parts += [check("duplicates", None, F.col("duplicates"), passed(F.col("duplicates")))]
    parts += [check("empty_strings", c, F.col(f"_e{j}"), F.lit("FAIL"), F.col(f"_e{j}") > 0) for j, c in enumerate(strings)]
    parts += [check("numeric_text", c, pround(rate[j] * 100, 1), F.lit("WARN"), (F.col(f"_k{j}") > 0) & (rate[j] > min_rate)) for j, c in enumerate(strings)]
    return profile_row(df).select(F.inline(F.filter(F.array(*parts), lambda x: x.isNotNull())))


def validate_all(tables: dict[str, DataFrame], relations: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """Every check as ``(check, table, column, value, status)`` rows.

    ``relations`` are ``(child_table, child_key, parent_table, parent_key)``.
    """
    frames = [_table_checks(df, name) for name, df in tables.items()]
    for child, ck, parent, pk in relations:
        o = orphans(tables[child], tables[parent], ck, pk)
        frames.append(o.select(F.lit(f"orphans:{parent}.{pk}").alias("check"), F.lit(child).alias("table"),
                               F.lit(ck).alias("column"), F.col("orphaned").cast("double").alias("value"),
                               F.when(F.col("orphaned") == 0, "PASS").otherwise("FAIL").alias("status")))
    return reduce(lambda a, b: a.unionByName(b), frames)
