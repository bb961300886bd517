"""Column-expression helpers shared by all operators.

All helpers return JVM-side ``Column`` expressions (whole-stage codegen), never
Python UDFs. They encode the null / rounding contract the operators follow:

* rounding is numpy's: scale, round half to even, unscale (``pround``);
* division by zero gives NULL instead of an ANSI error (``safe_div``);
* a comparison against NULL is a false flag, not NULL (``flag``);
* means are ``sum / count`` so exact decimal sums stay exact until the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pround(c: str | Column, digits: int = 2) -> Column:
    """Round like pandas/numpy ``round``: ``rint(x * 10**d) / 10**d``.

    ``bround`` is half-even on the exact value of the scaled double, so the
    result equals numpy's for every input (1.005 -> 1.0, 0.125 -> 0.12).
    Decimals are converted to double first so the output type is stable.
    """
    scale = float(10 ** digits)
    return F.bround(col(c).cast("double") * F.lit(scale), 0) / F.lit(scale)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as double; NULL when ``den`` is 0 or NULL (no ANSI error)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def mean(c: str | Column) -> Column:
    """Mean of non-null values as ``sum / count`` (NULL for an empty group).

    With decimal input the sum is exact, so the result is the same double in
    any engine regardless of partitioning.
    """
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)).cast("double"))


MICRO_SUFFIX = "_micro"


_LIMB = 24


def micro_limbs(micro: str | Column) -> tuple[Column, Column]:
    """An integer micro-unit column as two longs, its low ``_LIMB`` bits and the rest: (high, low)."""
    c = col(micro)
    return F.shiftright(c, _LIMB), c.bitwiseAND(F.lit((1 << _LIMB) - 1).cast("long"))


def limbs_sum(high: str | Column, low: str | Column) -> Column:
    """Exact sum as the decimal value (scale 6) of micro units held as two longs, or of sums of such."""
    high = F.sum(high).cast("decimal(20,0)") * F.lit(1 << _LIMB).cast("decimal(10,0)")
    return (high + F.sum(low).cast("decimal(20,0)")).cast("decimal(38,0)") / F.lit(1000000)


def micro_sum(micro: str | Column) -> Column:
    """Exact sum of an integer micro-unit column as the decimal value (scale 6).

    The value is summed as two longs (its low ``_LIMB`` bits and the rest), so
    rows stay on Spark's primitive path and a group of 2^38 lines cannot
    overflow; the two sums are joined as one decimal per group.
    """
    return limbs_sum(*micro_limbs(micro))


def micro_mean(micro: str | Column) -> Column:
    """``mean`` of the value behind an integer micro-unit column (sum / count)."""
    return F.try_divide(micro_sum(micro).cast("double"), F.count(col(micro)).cast("double"))


def total(c: str | Column) -> Column:
    """Sum of non-null values with pandas semantics: empty -> 0."""
    return F.coalesce(F.sum(col(c)).cast("double"), F.lit(0.0))


def flag(pred: Column) -> Column:
    """NULL-safe boolean: a comparison with a missing value is False."""
    return F.coalesce(pred, F.lit(False))


def bool_int(c: str | Column) -> Column:
    return col(c).cast("int")


def bin_expr(c: str | Column, edges: Sequence[float], labels: Sequence[str],
             right: bool = True, include_lowest: bool = False) -> Column:
    """Label of the interval containing ``c`` (``pd.cut`` semantics).

    Intervals are ``(e[i], e[i+1]]`` when ``right`` (else ``[e[i], e[i+1])``).
    Values outside every interval and NULLs give NULL; there is no otherwise.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    x = col(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        if right:
            lower = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
            cond = lower & (x <= F.lit(hi))
        else:
            upper = (x <= F.lit(hi)) if (include_lowest and i == len(labels) - 1) else (x < F.lit(hi))
            cond = (x >= F.lit(lo)) & upper
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def bin_ordinal(c: str | Column, edges: Sequence[float], right: bool = True,
                include_lowest: bool = False) -> Column:
    """0-based interval index for ``bin_expr`` (the ``*_ord`` column)."""
    labels = [str(i) for i in range(len(edges) - 1)]
    return bin_expr(c, edges, labels, right, include_lowest).cast("int")


def first_match(conditions: Sequence[Column], labels: Sequence[str],
                default: str | None = None) -> Column:
    """Ordered multi-condition label (``np.select``): first true condition wins."""
    expr = None
    for cond, label in zip(conditions, labels):
        expr = F.when(flag(cond), F.lit(label)) if expr is None else expr.when(flag(cond), F.lit(label))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def recode(c: str | Column, mapping: dict) -> Column:
    """Map values through ``mapping``; unmapped values become NULL."""
    x = col(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(x == F.lit(k), F.lit(v)) if expr is None else expr.when(x == F.lit(k), F.lit(v))
    return expr


def numeric_text(c: str | Column) -> Column:
    """Parse text as a number like ``pd.to_numeric(errors='coerce')``.

    Accepts optional surrounding blanks, sign, digits, decimal point and
    exponent. Rejects '', 'NaN', 'inf' and Java-style suffixes such as '1d'
    that a bare ``try_cast`` would accept.
    """
    s = F.trim(col(c).cast("string"))
    ok = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(ok, s.try_cast("double"))


def with_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.withColumns(exprs)


def ordered_domain(spark, key: str, values: Iterable, ord_col: str | None = None) -> DataFrame:
    """Literal ordered domain frame ``(key, key_ord)`` for reindexing."""
    rows = [(v, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{key} string, {ord_col or key + '_ord'} int")
