"""Ordered analytics: average ranks, running totals, ABC classes.

A window without ``partitionBy`` sends every row to one task, and one with a
key sends a hot group to one. Here every global or grouped order is cut into
buckets, by one plan at every input size:

* *Splitters* are quantiles of the leading order column, four for each shuffle
  partition (one aggregated row). A row is located by a binary search (Spark's
  ``Bucketizer``), so its cost grows with the logarithm of their number, and the
  plan holds the same few expressions however many there are.
* Values equal to a splitter have buckets of their own. A value that several
  splitters repeat is *hot*: its rows are cut further, into as many pieces, by
  splitters of the tie-breaking column, so one value on a third of all rows
  spreads over a third of the buckets. NULLs are treated as one such value.
* Totals per bucket (at most three per splitter and group) become offsets, and
  the row window runs inside a bucket. Sums over the buckets before plus the sum
  inside are the running total, exact for integers and decimals.

Ranks collapse the input to ``(value, count)`` first; rows get their rank back
by a join in which the values that hold more than their share are salted.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basketlens.session import saved

_B, _P = "_bl_bucket", "_bl_piece"
SPLITTERS_PER_PARTITION = 4
SALTS = 16


def default_buckets(df: DataFrame) -> int:
    """Splitters of an order: four for each shuffle partition of the session."""
    return SPLITTERS_PER_PARTITION * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _number(df: DataFrame, c: str) -> Column:
    """A double that never orders two values of ``c`` the wrong way round (equal for close ones)."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        lead = F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 6)), 12, "0")
        return F.conv(lead, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return F.col(c).cast("double")


def splitters(x: Column, buckets: int) -> Column:
    """Aggregate: sorted array of ``buckets - 1`` quantiles of ``x``, with repeats."""
    probs = [i / buckets for i in range(1, buckets)] or [0.5]
    return F.coalesce(F.percentile_approx(x, probs, max(10_000, 10 * buckets)), F.array().cast("array<double>"))


def _located(df: DataFrame, x: str, cuts: Sequence[float]) -> tuple[DataFrame, Column, Column]:
    """Where the double column ``x`` falls among the sorted ``cuts``: (frame, cuts at or below it, cuts equal to it).

    Every cut has an interval of its own, up to the next double; a binary
    search finds a row's interval. NULL stays NULL, NaN lies above infinity.
    """
    numbers = [c for c in cuts if not math.isnan(c)]
    inner = {b + 0.0 for c in numbers for b in (c, math.nextafter(c, math.inf)) if math.isfinite(b)} or {0.0}
    starts = [-math.inf, *sorted(inner)]
    found = Bucketizer(splits=[*starts, math.inf], inputCol=x, outputCol=f"{x}_at", handleInvalid="keep").transform(df)
    # Infinity shares the last interval of the search, NaN has none: one more of each.
    at = (F.when(F.isnan(x), len(starts) + 1).when(F.col(x) == math.inf, len(starts))
           .otherwise(F.col(f"{x}_at").cast("int")))
    found = found.withColumn(f"{x}_at", F.when(F.col(x).isNotNull(), at))
    upto = [bisect_right(numbers, b) for b in [*starts, math.inf]] + [len(cuts)]
    below = [bisect_left(numbers, b) for b in [*starts, math.inf]] + [len(numbers)]
    place = F.col(f"{x}_at")
    return found, F.get(F.lit(upto), place), F.get(F.lit([u - w for u, w in zip(upto, below)]), place)


def add_range_bucket(df: DataFrame, order: Sequence[tuple[str, bool]], buckets: int) -> DataFrame:
    """Attach (bucket, piece), which rise with ``order`` ((column, descending) pairs): see the module docstring.

    NULLs of the first column come last in descending order and first in
    ascending order, as Spark sorts them. The splitters (one number each) are
    computed at once.
    """
    lead, lead_desc = order[0]
    ties = [c for c in order[1:2]]
    # Adding 0.0 turns -0.0, which a binary search would put below 0.0, into it.
    b = df.withColumn("_bl_x", _number(df, lead) + F.lit(0.0))
    aggs = [splitters(F.col("_bl_x"), buckets)]
    if ties:
        b = b.withColumn("_bl_t", _number(df, ties[0][0]) + F.lit(0.0))
        aggs.append(splitters(F.col("_bl_t"), buckets))
    cut = b.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).first()
    sign = -1 if lead_desc else 1
    here = F.col("_bl_x")
    b, upto, repeats = _located(b, "_bl_x", cut[0])
    bucket = F.when(here.isNull(), F.lit(-1)).when(repeats > 0, 2 * upto - 1).otherwise(2 * upto)
    piece, tie_sign = F.lit(0), 1
    if ties:
        # Rows of a value that holds r splitters are cut into about r pieces of the tie-breaker.
        b, rank, _ = _located(b, "_bl_t", cut[1])
        share = F.when(here.isNull(), F.lit(buckets)).otherwise(repeats)
        piece = F.when(share > 1, F.floor(F.coalesce(rank + 1, F.lit(0)) * share / buckets)).otherwise(0)
        tie_sign = -1 if ties[0][1] else 1
    return (b.withColumn(_B, (bucket * sign).cast("long")).withColumn(_P, (piece * tie_sign).cast("long"))
            .drop("_bl_x", "_bl_t", "_bl_x_at", "_bl_t_at"))


def _order_exprs(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]


def running_sum(df: DataFrame, order: Sequence[tuple[str, bool]], value: str, out: str,
                partition_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Running total of ``value`` in ``order`` ((col, descending) pairs), per ``partition_by`` group if given.

    ``order`` must end with a unique tie-breaker for a deterministic result.
    ``buckets`` is the number of splitters (four per shuffle partition by default).
    ``df`` is written to shared storage first: splitters, totals and windows read it.
    """
    return _running_sum(saved(df, "ordered"), order, value, out, partition_by, buckets)


def _running_sum(df: DataFrame, order: Sequence[tuple[str, bool]], value: str, out: str,
                 partition_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    b = add_range_bucket(df, order, buckets or default_buckets(df))
    keys = list(partition_by)
    cell = [*keys, _B, _P]
    totals = b.groupBy(*cell).agg(F.sum(value).alias("_bl_tot"))
    before = Window.partitionBy(*keys).orderBy(_B, _P).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_bl_k{i}") for i, c in enumerate(cell)], F.coalesce(F.sum("_bl_tot").over(before), F.lit(0)).alias("_bl_off"))
    offsets = offsets if keys else F.broadcast(offsets)  # without groups at most three rows a splitter
    same = F.lit(True)
    for i, c in enumerate(cell):
        same = same & (F.col(c).eqNullSafe(F.col(f"_bl_k{i}")) if c in keys else F.col(c) == F.col(f"_bl_k{i}"))
    inside = Window.partitionBy(*cell).orderBy(*_order_exprs(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = b.withColumn("_bl_own", F.sum(value).over(inside))
    return own.join(offsets, same).select(*df.columns, (F.col("_bl_off") + F.col("_bl_own")).alias(out))


def tied_ranks(df: DataFrame, value: str, weight: str, rank: str, ties: str, buckets: int | None = None) -> DataFrame:
    """Average rank of rows that stand for ``weight`` equal rows each, and the weight of all rows with their value.

    Rows of one value need not be collapsed: they share a bucket, and the two
    windows are over peers in one sort. ``df`` is read twice (write it first).
    """
    b = add_range_bucket(df, [(value, False)], buckets or default_buckets(df))
    cells = b.groupBy(_B).agg(F.sum(weight).alias("_bl_tot"))
    before = Window.orderBy("_bl_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(F.col(_B).alias("_bl_at"), "_bl_tot").select("_bl_at", F.coalesce(F.sum("_bl_tot").over(before), F.lit(0)).alias("_bl_off"))
    order = Window.partitionBy(_B).orderBy(value)
    own = (b.withColumn("_bl_cum", F.sum(weight).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
            .withColumn(ties, F.sum(weight).over(order.rangeBetween(Window.currentRow, Window.currentRow))))
    placed = own.join(F.broadcast(offsets), F.col(_B) == F.col("_bl_at"))  # at most three rows a splitter
    below = F.col("_bl_off") + F.col("_bl_cum") - F.col(ties)
    return placed.select(*df.columns, ties, (below + (F.col(ties) + 1) / 2.0).alias(rank))


def with_hot_keys_salted(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, share: int) -> DataFrame:
    """Left join of ``rows`` to the unique keys of ``table``, keys with more than a ``share``-th of all ``weight`` salted.

    There are fewer than ``share`` such keys at any size, so they are broadcast
    to mark the rows; their table rows are repeated once per salt.
    """
    keys = list(keys)
    total = table.agg(F.sum(weight).alias("_bl_all"))
    sized = table.crossJoin(F.broadcast(total)).withColumn("_bl_hot", F.col(weight) * share > F.col("_bl_all")).drop("_bl_all")
    hot = sized.where("_bl_hot").select(*keys, F.lit(True).alias("_bl_marked"))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int")
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_bl_salt", F.when(F.col("_bl_marked"), spread).otherwise(0))
    salts = F.when(F.col("_bl_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = sized.withColumn("_bl_salt", F.explode(salts)).drop("_bl_hot", weight)
    return marked.join(salted, [*keys, "_bl_salt"], "left").drop("_bl_salt", "_bl_marked")


def average_rank(df: DataFrame, value: str, out: str, descending: bool = True,
                 partition_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Rank with ties averaged (pandas ``rank(method='average')``), NULL stays NULL.

    Works on the distinct ``(partition, value, count)`` rows, then joins the
    rank back on the value. ``df`` is written to shared storage first, as the
    counts and the join both read it.
    """
    keys = list(partition_by)
    df = saved(df, "ranked")
    counts = (df.filter(F.col(value).isNotNull())
                .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_bl_n")))
    buckets = buckets or default_buckets(df)
    cum = running_sum(counts, [(value, descending)], "_bl_n", "_bl_cum", partition_by=keys, buckets=buckets)
    ranks = saved(cum.select(*keys, value, "_bl_n",
                             (F.col("_bl_cum") - F.col("_bl_n") + (F.col("_bl_n") + 1) / 2.0).alias(out)), "ranks")
    return with_hot_keys_salted(df, ranks, [*keys, value], "_bl_n", buckets).select(*df.columns, out)


def share_of_total(df: DataFrame, value: str, out: str, partition_by: Sequence[str] = (),
                   scale: float = 100.0) -> DataFrame:
    """``value / sum(value) * scale``.

    Without keys the total is one row (broadcast); with keys the per-key
    totals are joined normally (AQE broadcasts them only if they turn out
    small).
    """
    keys = list(partition_by)
    tot = df.groupBy(*keys).agg(F.sum(value).cast("double").alias("_bl_total"))
    joined = df.join(tot, keys) if keys else df.crossJoin(F.broadcast(tot))
    return (joined.withColumn(out, F.try_divide(F.col(value).cast("double") * F.lit(scale),
                                                F.col("_bl_total")))
                  .drop("_bl_total"))


def abc_classification(df: DataFrame, value: str, key: str, cuts: tuple[float, float] = (80.0, 95.0),
                       labels: tuple[str, str, str] = ("A", "B", "C"), buckets: int | None = None) -> DataFrame:
    """Cumulative-share classes (W4): share <= cuts[0] -> A, <= cuts[1] -> B, else C.

    Descending by ``value`` with ``key`` as the tie-breaker; adds ``cum_pct``
    and ``abc_class``.
    """
    df = saved(df, "abc")
    run = _running_sum(df, [(value, True), (key, False)], value, "_bl_run", buckets=buckets)
    tot = df.agg(F.sum(value).cast("double").alias("_bl_grand"))
    cum = F.col("_bl_run").cast("double") / F.col("_bl_grand") * 100
    return (run.crossJoin(F.broadcast(tot))
               .withColumn("cum_pct", cum)
               .withColumn("abc_class", F.when(F.col("cum_pct") <= cuts[0], labels[0])
                                         .when(F.col("cum_pct") <= cuts[1], labels[1])
                                         .otherwise(labels[2]))
               .drop("_bl_run", "_bl_grand"))


def rank_gap(df: DataFrame, count_col: str, value_col: str, buckets: int | None = None) -> DataFrame:
    """Rank divergence (W2): |rank(count) - rank(value)|, flagged above mean + std.

    Adds ``orders_rank``, ``revenue_rank``, ``rank_gap``, ``gap_threshold``
    and ``flagged``. The threshold is a one-row aggregate joined by broadcast.
    """
    r = average_rank(df, count_col, "orders_rank", buckets=buckets)
    r = average_rank(r, value_col, "revenue_rank", buckets=buckets)
    r = r.withColumn("rank_gap", F.abs(F.col("orders_rank") - F.col("revenue_rank")))
    thr = r.agg((F.avg("rank_gap") + F.stddev_samp("rank_gap")).alias("gap_threshold"))
    return (r.crossJoin(F.broadcast(thr))
             .withColumn("flagged", F.coalesce(F.col("rank_gap") > F.col("gap_threshold"), F.lit(False))))


def index_to_row_max(df: DataFrame, row_key: Sequence[str] | str, value: str, out: str,
                     scale: float = 100.0) -> DataFrame:
    """Row-max normalisation (W6): ``value / max(value) per row_key * scale``."""
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    mx = df.groupBy(*keys).agg(F.max(value).cast("double").alias("_bl_max"))
    return (df.join(mx, keys)
              .withColumn(out, F.try_divide(F.col(value).cast("double") * F.lit(scale), F.col("_bl_max")))
              .drop("_bl_max"))
