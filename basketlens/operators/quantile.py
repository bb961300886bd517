"""Exact quantiles by radix selection (medians, baselines, bins, thresholds, markers).

Spark's exact ``percentile`` keeps every distinct value of a group in one
reduce task. Selection by digits needs a bounded histogram instead, and the
plan is the same at every input size:

1. a double becomes a 64-bit integer of the same order (``order_code``,
   arithmetic only);
2. three rounds look at 22, 21 and 21 bits of it. A round counts rows per
   (group, leading bits), finds the bins that hold the wanted ranks by a running
   sum over the bins (at most 2^22 a bin of the round before), and only values
   inside these bins reach the next round;
3. the first round counts the rows where they are. Rows outside its wanted bins
   are left out before anything else is moved (``_marked``); the others collapse
   to ``(group, value, count)``, so a value on a third of all rows is one row;
4. after the last round a bin is one value; the order statistics at floor and
   ceil of ``(n - 1) q`` are interpolated (as pandas, Spark and DuckDB do).

The wanted bins (at most two per group and quantile) meet the values by an
equi-join on group, bits and a salt, so a bin that holds most of a group's
values is spread over tasks; without groups they are a handful of rows and
broadcast. The collapsed values are one exchange that the later rounds reuse;
the source is read twice, its own exchanges once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHIFTS = (42, 21, 0)
SALTS = 16
MARKS = 1 << 16  # bits that mark the wanted bins of the first round (8 KB)
HOLDS = "({r} >= _before AND {r} < _before + _c)"  # a bin holds the rank r


def _guess(a: str) -> str:
    return f"CASE WHEN {a} < double('infinity') THEN floor(log2({a})) END"


def _exponent(a: str, guess: str) -> str:
    return f"({guess} + CASE WHEN {a} < pow(2D, {guess}) THEN -1 WHEN {a} >= pow(2D, {guess}) * 2 THEN 1 ELSE 0 END)"


def _code(x: str, a: str, exponent: str) -> str:
    normal = f"CAST({exponent} + 1023 AS LONG) * {1 << 52}L + CAST(({a} / pow(2D, {exponent}) - 1) * {1 << 52}D AS LONG)"
    tiny = f"CAST({a} * pow(2D, 537) * pow(2D, 537) AS LONG)"
    top = 2047 << 52
    size = (f"CASE WHEN isnan(`{x}`) THEN {top + 1}L WHEN {a} = double('infinity') THEN {top}L "
            f"WHEN {a} < pow(2D, -1022) THEN {tiny} ELSE {normal} END")
    return f"coalesce(CASE WHEN `{x}` < 0 THEN -1L ELSE 1L END * {size}, 0L)"


def order_code(x: str) -> Column:
    """A long that orders like the double column ``x``: -0.0 as 0.0, NaN above infinity, NULL as 0.

    The value of the sign, exponent and mantissa bits, from comparisons and
    exact divisions by powers of two.
    """
    a = f"abs(`{x}`)"
    return F.expr(_code(x, a, _exponent(a, f"({_guess(a)})")))


def with_order_code(df: DataFrame, x: str, out: str) -> DataFrame:
    """``order_code(x)`` as the column ``out``, with each logarithm and power computed once a row."""
    parts = df.withColumn("_a", F.abs(x)).withColumn("_g", F.expr(_guess("_a"))).withColumn("_e", F.expr(_exponent("_a", "_g")))
    return parts.withColumn(out, F.expr(_code(x, "_a", "_e"))).drop("_a", "_g", "_e")


def quantile_frame(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), out: str = "_q") -> DataFrame:
    """``(by..., out)`` where ``out`` is the array of exact quantiles of ``value``.

    NULL values are ignored; without ``by`` there is always one row (NULLs if
    no value is left), with ``by`` groups without values have no row.
    """
    keys = list(by)
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    src = df.select(group.alias("_k"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    values = with_order_code(src, "_v", "_code")

    # The 0-based ranks wanted in a group of _n values.
    low = [f"CAST(floor((_n - 1) * {float(p)!r}D) AS LONG)" for p in probs]
    high = [f"CAST(ceil((_n - 1) * {float(p)!r}D) AS LONG)" for p in probs]
    wanted = _select(values, low + high, bool(keys))
    one = []
    for p, lo, hi in zip(probs, low, high):
        lower = f"max(CASE WHEN {HOLDS.format(r=lo)} THEN _v END)"
        above = f"max(CASE WHEN {HOLDS.format(r=hi)} THEN _v END)"
        one.append(f"{lower} + ({above} - {lower}) * max((_n - 1) * {float(p)!r}D - {lo})")
    res = F.expr(f"array({', '.join(one)})").alias(out)
    if not keys:
        return wanted.agg(res)
    return wanted.groupBy("_k").agg(res).select(*[F.col("_k")[k].alias(k) for k in keys], out)


def kth_smallest(df: DataFrame, by: str, code: str, rank: str) -> DataFrame:
    """(by, code, before): per group the value of the long ``code`` at the group's 0-based ``rank``, and the rows below it.

    Every row of a group carries the group's ``rank``; groups whose rank lies outside have no row.
    """
    values = df.selectExpr(f"struct(`{by}`) AS _k", f"CAST(`{code}` AS LONG) AS _v", f"CAST(`{code}` AS LONG) AS _code", f"CAST(`{rank}` AS LONG) AS _n")
    found = _select(values, ["_n"], True, sized=True)
    return found.select(F.col("_k")[by].alias(by), F.col("_v").alias(code), F.col("_before").alias("before"))


def _select(values: DataFrame, ranks: Sequence[str], grouped: bool, sized: bool = False) -> DataFrame:
    """The rounds: (_k, _bin, _v, _c, _before, _n) of the single values of the rows ``values(_k, _code, _v)`` that hold a rank.

    ``ranks`` are SQL over ``_n``, the number of values of the group, or what the rows carry as ``_n`` if ``sized``.
    """
    wanted, upper = None, None
    for shift in SHIFTS:
        if wanted is None:
            rows = values.selectExpr("_k", "0L AS _parent", f"shiftright(_code, {shift}) AS _bin", "1L AS _c", "_v", "0L AS _base", "_n" if sized else "0L AS _n")
        else:
            if upper == SHIFTS[0]:
                values = _marked(values, wanted, upper).groupBy("_k", "_v", "_code").agg(F.count(F.lit(1)).alias("_c"))
            inside = _inside(values, wanted, upper, grouped)
            rows = inside.selectExpr("_k", "_lead AS _parent", f"shiftright(_code, {shift}) AS _bin", "_c", "_v", "_base", "_n")
        bins = rows.groupBy("_k", "_parent", "_bin").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_v"), F.min("_base").alias("_base"), F.min("_n").alias("_n"))
        run = "OVER (PARTITION BY _k, _parent ORDER BY _bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        size = "sum(_c) OVER (PARTITION BY _k, _parent)" if wanted is None and not sized else "_n"
        bins = bins.selectExpr("_k", "_bin", "_v", "_c", f"_base + sum(_c) {run} - _c AS _before", f"{size} AS _n")
        wanted = bins.where(" OR ".join(HOLDS.format(r=r) for r in dict.fromkeys(ranks)))
        upper = shift
    return wanted


def _marked(values: DataFrame, wanted: DataFrame, shift: int) -> DataFrame:
    """Rows whose group and leading bits hash to a place that a wanted bin marks: all rows of these bins and few others.

    The marks are one row of MARKS bits whatever the number of groups, so the
    rows meet them where they are, and only what is left is moved.
    """
    place = f"CAST(xxhash64(_k, {{}}) & {MARKS - 1}L AS INT)"
    spots = wanted.selectExpr(f"{place.format('_bin')} AS _at")
    words = spots.selectExpr("_at DIV 64 AS _word", "shiftleft(1L, _at % 64) AS _bits").groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    one = words.agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_set"))
    marks = one.select(F.expr(f"transform(sequence(0L, {MARKS // 64 - 1}L), w -> coalesce(try_element_at(_set, w), 0L)) AS _marks"))
    own = values.withColumn("_at", F.expr(place.format(f"shiftright(_code, {shift})")))
    hit = F.expr("shiftright(_marks[_at DIV 64], _at % 64) & 1L") == 1
    return own.crossJoin(F.broadcast(marks)).where(hit).select(*values.columns)


def _inside(values: DataFrame, wanted: DataFrame, shift: int, grouped: bool) -> DataFrame:
    """Values whose leading bits are those of a wanted bin of their group, with the bin's start and the group's size."""
    own = values.withColumn("_lead", F.expr(f"shiftright(_code, {shift})"))
    bins = wanted.selectExpr("_k", "_bin AS _lead", "_before AS _base", "_n")
    if not grouped:  # two rows a quantile
        return own.join(F.broadcast(bins), ["_k", "_lead"])
    own = own.withColumn("_salt", F.expr(f"CAST(xxhash64(_code) & {SALTS - 1}L AS INT)"))
    return own.join(bins.withColumn("_salt", F.expr(f"explode(sequence(0, {SALTS - 1}))")), ["_k", "_lead", "_salt"])
