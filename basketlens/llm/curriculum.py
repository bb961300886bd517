"""Mixing sources to target weights by a time-varying curriculum (operator 5).

Targets: source s gets ``min(2 * size_s, level * weight_s)`` words, with the
level that makes all targets add up to 150 % of the corpus (or every source
full). The level comes from one sort of the sources by cap over weight.

Positions: source s has a demand rate that changes over training time t in
[0, 1], ``1 + slope_s * (1 - 2 t)``, whose integral is ``t + slope_s * (t - t^2)``.
A document whose words start at cumulative word c of its source's target T is
placed where that integral equals c / T. Inverting the integral is a quadratic,
so positions are plain column arithmetic, and the training order is a range
sort by position.

Within a source, documents are ordered by a hash of the id, and cumulative
demand is a two-level sum (hash bucket, then rows of the bucket), so a source
with a third of all rows is not one task. A target of q whole passes and a
rest gives every document q copies, and one copy more to each document whose
span starts before the rest is used up; as no target passes twice its source,
no document is taken more than twice.

NULL text has size 0 and is taken 0 words; NULL source is a source of its own,
last in order; an empty table gives no rows; repeated rows get their own spans
(ties in the hash order are settled by id and text). Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from basketlens.llm.common import WORD, running_total, shielded

WEIGHTS = (5, 2, 1)       # repeating, by source in code-point order, NULL last
SLOPES = (0.5, 0.0, -0.5)  # schedule of each weight: falling, level, rising demand
SHARE_PCT = 150
MAX_PASSES = 2
BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: (src, source_size, weight, slope, target)."""
    by_source = Window.orderBy(F.col("src").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("k", F.row_number().over(by_source) - 1).withColumn("weight", _pick(WEIGHTS, F.col("k")).cast("long"))
    s = s.withColumn("slope", _pick(SLOPES, F.col("k"))).withColumn("cap", MAX_PASSES * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = (s.withColumn("goal2", F.sum("source_size").over(every) * (2 * SHARE_PCT // 100))
         .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("open_weight", F.sum("weight").over(after)))
    # a source is below its cap when the level, with all earlier sources full, does not reach it
    s = s.withColumn("below", (F.col("goal2") - 2 * F.col("full")) * F.col("weight") < 2 * F.col("cap") * F.col("open_weight"))
    place = F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("k").alias("k"))
    s = s.withColumn("first", F.min(F.when(F.col("below"), F.struct(place.alias("place"), "goal2", "full", "open_weight"))).over(every))
    level = (((F.col("first.goal2") - 2 * F.col("first.full")) * F.col("weight")).cast("double")
             / (2 * F.col("first.open_weight")).cast("double"))
    capped = F.col("first").isNull() | (place < F.col("first.place"))
    return s.select("src", "source_size", "weight", "slope", F.when(capped, F.col("cap").cast("double")).otherwise(level).alias("target"))


def _invert(share: Column, slope: Column) -> Column:
    """t with t + slope * (t - t^2) = share."""
    b = 1 + slope
    return F.when(slope == 0, share).otherwise((b - F.sqrt(F.greatest(b * b - 4 * slope * share, F.lit(0.0)))) / (2 * slope))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: (id, tie, src, size, source_size, target, start, copies, taken, position,
    position_2).

    ``position`` and ``position_2`` are the training positions (0 to 1) of the
    first and second copy, NULL for a copy that is not taken.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), n_words(F.col(text_col)).alias("size"),
                        F.md5(F.concat_ws(":", F.lit("mix"), F.col(id_col).cast("string"))).alias("h"),
                        F.xxhash64(F.col(text_col)).alias("tie"))
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("int") / (65536 // BUCKETS)))
    t = source_targets(sized).withColumnRenamed("src", "s2")
    r = running_total(sized, ["src"], "bucket", [F.col("h"), F.col("id"), F.col("tie")], F.col("size"), "start")
    r = r.join(t, F.col("src").eqNullSafe(F.col("s2"))).drop("s2")
    passes = F.floor(F.col("target") / F.col("source_size"))
    r = r.withColumn("passes", F.when(F.col("source_size") > 0, passes).otherwise(0))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    # the document whose span covers the end of the rest goes in when most of it lies before that end
    extra = (F.col("size") > 0) & (F.col("start") + F.col("size") / 2 <= rest)
    r = r.withColumn("copies", F.when(F.col("size") > 0, F.least(F.lit(MAX_PASSES), F.col("passes") + extra.cast("long"))).otherwise(F.lit(0)).cast("long"))

    def at(copy: int) -> Column:
        share = F.least(F.lit(1.0), (F.col("start") + (copy - 1) * F.col("source_size")) / F.col("target"))
        return F.when(F.col("copies") >= copy, _invert(share, F.col("slope")))

    return r.select("id", "tie", "src", "size", "source_size", "target", "start", "copies", (F.col("copies") * F.col("size")).alias("taken"),
                    at(1).alias("position"), at(2).alias("position_2"))


@shielded
def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The training stream: the input's columns, one row per copy taken, range-sorted by position.

    Rows that repeat both id and text follow the plan of the first of them.
    """
    p = plan(docs, id_col, text_col, source_col).where("copies > 0")
    p = p.groupBy("id", "tie").agg(F.min(F.struct("start", F.array_compact(F.array("position", "position_2")).alias("at"))).alias("__plan"))
    p = p.select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("__plan.at").alias("__at"))
    out = docs.join(p, F.col(id_col).eqNullSafe(F.col("__id")) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col("__tie")))
    out = out.select(*[docs[c] for c in docs.columns], "__id", F.explode("__at").alias("__at"))
    return out.orderBy("__at", "__id").drop("__at", "__id")
