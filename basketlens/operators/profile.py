"""Segment profiles: named aggregations by keys, and the reports built on them.

``segment_profile`` is the one shape behind every report: ``groupBy(keys)``
with named measures, pandas-style null handling (null keys dropped, counts of
non-null values, empty sums 0) and numpy rounding. All measures are
distributive or algebraic (partial aggregation before the shuffle) except
``median``, which goes through radix selection (``operators/quantile.py``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.core import MICRO_SUFFIX, bin_expr, mean, micro_mean, micro_sum, pround, recode, safe_div, total

# The reference's age bins (right-closed) and labels.
AGE_EDGES = [17, 24, 31, 38, 45, 52, 59, 100]
AGE_LABELS = ["18-24", "25-31", "32-38", "39-45", "46-52", "53-59", "60+"]
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TIER_ORDER = ["Free", "Silver", "Gold", "Platinum"]
QUARTILE_LABELS = ["Q1_low", "Q2", "Q3", "Q4_high"]


def measure(fn: str, c: str | Column | None = None) -> Column:
    """Aggregate expression by pandas name."""
    x = F.col(c) if isinstance(c, str) else c
    if fn == "size":
        return F.count(F.lit(1))
    if fn == "count":
        return F.count(x)
    if fn == "sum":
        return total(x)
    if fn == "mean":
        return mean(x)
    if fn == "std":
        return F.stddev_samp(x.cast("double"))
    if fn == "min":
        return F.min(x)
    if fn == "max":
        return F.max(x)
    if fn == "nunique":
        return F.count_distinct(x)
    raise ValueError(f"unknown aggregate {fn}")


def segment_profile(df: DataFrame, keys: Sequence[str], measures: Sequence[tuple[str, str, str | None]],
                    digits: int | None = 2, dropna: bool = True) -> DataFrame:
    """``groupBy(keys)`` with ``(out, fn, column)`` measures (A0).

    Null keys are dropped like pandas when ``dropna``; float measures are
    rounded with numpy semantics when ``digits`` is set (counts stay exact).
    Medians come from one ``quantile_frame`` over all median columns (exact, and
    never a whole group in one task), joined on the keys.
    """
    from basketlens.operators.quantile import quantile_frame

    if dropna and keys:
        df = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    exprs, medians = [], []
    for out, fn, c in measures:
        if fn == "median":
            medians.append((out, c))
            continue
        micro = f"{c}{MICRO_SUFFIX}" if isinstance(c, str) else None
        if fn in ("sum", "mean") and micro in df.columns:  # exact integer twin: long sums
            e = F.coalesce(micro_sum(micro).cast("double"), F.lit(0.0)) if fn == "sum" else micro_mean(micro)
        else:
            e = measure(fn, c)
        if digits is not None and fn not in ("size", "count", "nunique", "min", "max"):
            e = pround(e, digits)
        exprs.append(e.alias(out))
    res = df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)
    if medians:
        long = df.select(*keys, *[F.col(c).cast("double").alias(f"_m{i}") for i, (_, c) in enumerate(medians)]).unpivot(
            list(keys), [f"_m{i}" for i in range(len(medians))], "_measure", "_x")
        q = quantile_frame(long, "_x", [0.5], [*keys, "_measure"])
        m = pround(F.col("_q")[0], digits) if digits is not None else F.col("_q")[0]
        one = [F.max(F.when(F.col("_measure") == f"_m{i}", m)).alias(out) for i, (out, _) in enumerate(medians)]
        if keys:
            q = q.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(*one)
            res = res.join(q, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]), "left")
        else:
            res = res.crossJoin(F.broadcast(q.agg(*one)))
    return res.select(*keys, *[out for out, _, _ in measures])


def reindex_domain(df: DataFrame, key: str, values: Sequence, mode: str = "all",
                   ord_col: str | None = None) -> DataFrame:
    """Fixed presentation order for ``key``.

    ``mode='all'``: one row per domain value, absent ones as NULL rows, unknown
    keys dropped; ``mode='present'``: only domain values present. Adds an
    ``<key>_ord`` column for ordering. The domain is a literal of bounded size.
    """
    spark = df.sparkSession
    ord_col = ord_col or f"{key}_ord"
    dom = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{key} string, {ord_col} int")
    how = "left" if mode == "all" else "inner"
    return F.broadcast(dom).join(df, key, how) if mode == "all" else df.join(F.broadcast(dom), key, how)


def dense_grid(df: DataFrame, domains: dict[str, Sequence], fill: dict[str, float]) -> DataFrame:
    """Zero-filled grid of literal domains left-joined to ``df`` (P9 dense grid).

    The grid is generated from literal arrays (``inline`` of structs), so it
    is a constant relation whose size is the product of the domain sizes.
    """
    spark = df.sparkSession
    names = list(domains)
    import itertools
    combos = list(itertools.product(*[list(enumerate(domains[k])) for k in names]))
    rows = [tuple(v for _, v in c) + tuple(i for i, _ in c) for c in combos]
    schema = ", ".join([f"{k} string" for k in names] + [f"{k}_ord int" for k in names])
    grid = spark.createDataFrame(rows, schema)
    return F.broadcast(grid).join(df, names, "left").fillna(fill)


def min_group_size(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keep rows of groups with more than ``n`` rows."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_bl_n")).filter(F.col("_bl_n") > n)
    return df.join(sizes.select(key), key, "left_semi")


def dense_features(df: DataFrame, columns: Sequence[str], min_share: float = 0.5) -> list[str]:
    """Columns with more than ``min_share`` non-null values (P15): one aggregate row."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > row["_n"] * min_share]


def add_age_group(df: DataFrame, age: str = "age", out: str = "age_group") -> DataFrame:
    """Right-closed age bins (P1); out-of-range and NULL ages get NULL."""
    return df.withColumn(out, bin_expr(age, AGE_EDGES, AGE_LABELS))


def add_cohort(df: DataFrame, date_col: str = "registration_date", floor_year: int = 2020,
               out: str = "cohort") -> DataFrame:
    """Registration-year cohort (P8): years before ``floor_year`` pooled as ``pre_<year>``."""
    y = F.year(F.to_date(date_col))
    return df.withColumn(out, F.when(y < floor_year, F.lit(f"pre_{floor_year}")).otherwise(y.cast("string")))


# ---------------------------------------------------------------- customers

def profile_overview(customers: DataFrame) -> DataFrame:
    """Headline metrics (A1) in one global aggregate."""
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_distinct("country").alias("countries"),
        pround(mean("age"), 1).alias("avg_age"),
        pround(mean("total_orders"), 1).alias("avg_orders"),
        pround(mean("total_spend_usd"), 2).alias("avg_spend"),
        pround(mean("avg_order_value_usd"), 2).alias("avg_order_value"),
        pround(mean("days_since_last_purchase"), 1).alias("avg_recency_days"),
        pround(F.try_divide(total("churned") * 100, F.count(F.lit(1)).cast("double")), 1).alias("churn_rate_pct"))


def churn_by_cohort(customers: DataFrame, floor_year: int = 2020) -> DataFrame:
    """Cohort -> customers, churned, avg spend / recency, churn % (A2)."""
    res = segment_profile(add_cohort(customers, floor_year=floor_year), ["cohort"], [
        ("total_customers", "count", "customer_id"),
        ("churned", "sum", "churned"),
        ("avg_spend", "mean", "total_spend_usd"),
        ("avg_recency_days", "mean", "days_since_last_purchase")])
    return res.withColumn("churn_rate_pct",
                          pround(safe_div(F.col("churned") * 100, "total_customers"), 1))


def membership_tier_profile(customers: DataFrame, tier: str = "membership_tier",
                            tiers: Sequence[str] = TIER_ORDER) -> DataFrame:
    """Tier metrics, share of customers, churn %, value/retention ratio (A3).

    Ratios use the rounded columns as the reference does; a zero churn rate
    gives a NULL ratio instead of infinity.
    """
    res = segment_profile(customers, [tier], [
        ("customer_count", "count", "customer_id"),
        ("avg_spend", "mean", "total_spend_usd"),
        ("avg_order_value", "mean", "avg_order_value_usd"),
        ("avg_recency_days", "mean", "days_since_last_purchase"),
        ("churned", "sum", "churned")])
    tot = res.agg(F.sum("customer_count").cast("double").alias("_bl_all"))
    res = (res.crossJoin(F.broadcast(tot))
              .withColumn("pct_of_total", pround(F.col("customer_count") / F.col("_bl_all") * 100, 1))
              .withColumn("churn_rate_pct", pround(safe_div(F.col("churned"), "customer_count") * 100, 1))
              .withColumn("value_retention_ratio", pround(safe_div("avg_spend", "churn_rate_pct"), 0))
              .drop("_bl_all"))
    return reindex_domain(res, tier, tiers, mode="all")


def churn_reduction_scenarios(tiers: DataFrame, tier: str = "Gold",
                              targets: Sequence[tuple[str, float]] | None = None,
                              tier_col: str = "membership_tier") -> DataFrame:
    """Recoverable revenue if one tier's churn fell to each target."""
    # The reference's scenario labels and target churn rates.
    targets = targets or [("Conservative", 9.0), ("Moderate", 8.0), ("Aggressive", 7.1), ("Best case", 6.0)]
    spark = tiers.sparkSession
    sc = spark.createDataFrame([(lbl, float(t), i) for i, (lbl, t) in enumerate(targets)],
                               "scenario string, target_churn double, scenario_ord int")
    row = tiers.filter(F.col(tier_col) == tier).select("customer_count", "churn_rate_pct", "avg_spend")
    saved = F.col("customer_count") * (F.col("churn_rate_pct") - F.col("target_churn")) / 100
    return (row.crossJoin(F.broadcast(sc))
               .select("scenario", "target_churn",
                       pround(saved * F.col("avg_spend"), 2).alias("recoverable_revenue"), "scenario_ord"))


def audience_conversion(customers: DataFrame) -> DataFrame:
    """Country x age group x gender spend (A4), sorted by total spend."""
    res = segment_profile(add_age_group(customers), ["country", "age_group", "gender"], [
        ("customer_count", "count", "customer_id"),
        ("avg_spend", "mean", "total_spend_usd"),
        ("avg_order_value", "mean", "avg_order_value_usd"),
        ("total_spend", "sum", "total_spend_usd")])
    return res.orderBy(F.col("total_spend").desc(), "country", "age_group", "gender")


def country_summary(conversion: DataFrame, weighted: bool = False) -> DataFrame:
    """Roll A4 up to countries (A5): sums, and mean of segment means.

    ``weighted=True`` gives customer-weighted means instead.
    """
    # Inputs are already rounded to cents: sum them as exact decimals so the
    # mean does not depend on summation order (ties at the third decimal).
    cents = {c: F.col(c).cast("decimal(24,2)") for c in ("avg_spend", "avg_order_value", "total_spend")}
    if weighted:
        avg_spend = pround(F.sum(cents["avg_spend"] * F.col("customer_count")).cast("double")
                           / F.sum("customer_count"), 2)
        aov = pround(F.sum(cents["avg_order_value"] * F.col("customer_count")).cast("double")
                     / F.sum("customer_count"), 2)
    else:
        avg_spend, aov = pround(mean(cents["avg_spend"]), 2), pround(mean(cents["avg_order_value"]), 2)
    return (conversion.filter(F.col("country").isNotNull()).groupBy("country").agg(
        F.sum("customer_count").alias("total_customers"),
        pround(total(cents["total_spend"]), 2).alias("total_revenue"),
        avg_spend.alias("avg_spend"), aov.alias("avg_order_value"))
        .orderBy(F.col("total_revenue").desc(), "country"))


def long_by_dimension(df: DataFrame, dims: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (input row, dimension): ``(dimension, segment, *keep)``.

    The same Expand that GROUPING SETS plans, written as ``unpivot`` so a
    single ``groupBy(dimension, segment)`` (with partial aggregation) serves
    every dimension in one pass over the data. Null segments are dropped.
    """
    cast = df.select(*keep, *[F.col(d).cast("string").alias(d) for d in dims])
    return (cast.unpivot(list(keep), list(dims), "dimension", "segment")
                .filter(F.col("segment").isNotNull()))


def satisfaction_by(customers: DataFrame, dims: Sequence[str],
                    metrics: Sequence[str] = ("reviews_given", "avg_review_score", "returns_made"),
                    digits: int = 3) -> DataFrame:
    """Mean satisfaction metrics per value of each dimension, one pass.

    Long output ``(dimension, segment, *metrics)``.
    """
    long = long_by_dimension(customers, dims, metrics)
    return long.groupBy("dimension", "segment").agg(*[pround(mean(m), digits).alias(m) for m in metrics])


def acquisition_channel_profile(customers: DataFrame, channel: str = "acquisition_channel") -> DataFrame:
    """Channel profile (A7); churn rate rounded to 2 dp, then x100 to 1 dp, as the reference."""
    res = segment_profile(customers, [channel], [
        ("customer_count", "count", "customer_id"),
        ("avg_spend", "mean", "total_spend_usd"),
        ("avg_order_value", "mean", "avg_order_value_usd"),
        ("avg_orders", "mean", "total_orders"),
        ("avg_recency", "mean", "days_since_last_purchase"),
        ("churn_rate", "mean", "churned")])
    return (res.withColumn("churn_rate", pround(F.col("churn_rate") * 100, 1))
               .orderBy(F.col("avg_spend").desc(), channel))


# ------------------------------------------------------------------- orders

def temporal_day_of_week(orders: DataFrame, amount: str = "total_amount_usd",
                         order_id: str = "order_id") -> DataFrame:
    """Day of week -> orders, revenue, mean, median (A9), Monday..Sunday (present only)."""
    res = segment_profile(orders, ["day_of_week"], [
        ("total_orders", "count", order_id), ("total_revenue", "sum", amount),
        ("avg_revenue", "mean", amount), ("median_revenue", "median", amount)])
    return reindex_domain(res, "day_of_week", DAY_ORDER, mode="present").orderBy("day_of_week_ord")


def temporal_by(orders: DataFrame, keys: Sequence[str], amount: str = "total_amount_usd",
                order_id: str = "order_id") -> DataFrame:
    """(year, month) or (year, quarter) -> orders, revenue, mean."""
    return segment_profile(orders, keys, [
        ("total_orders", "count", order_id), ("total_revenue", "sum", amount),
        ("avg_revenue", "mean", amount)]).orderBy(*keys)


def shipping_burden(orders: DataFrame, by: str = "category", fee: str = "shipping_fee_usd",
                    subtotal: str = "subtotal_usd") -> tuple[DataFrame, DataFrame]:
    """Shipping as % of subtotal (A12): per row, overall, and per ``by`` value."""
    # Per-row percentage rounded to cents as the reference does, kept as an
    # exact decimal so the later means do not depend on summation order.
    rows = orders.withColumn("shipping_pct_of_subtotal",
                             pround(safe_div(F.col(fee) * 100, subtotal), 2).cast("decimal(20,2)"))
    overall = segment_profile(rows, [], [("avg_shipping_fee", "mean", fee),
                                         ("avg_shipping_pct", "mean", "shipping_pct_of_subtotal"),
                                         ("median_shipping_pct", "median", "shipping_pct_of_subtotal")])
    per = segment_profile(rows, [by], [
        ("avg_shipping_fee", "mean", fee), ("avg_shipping_pct", "mean", "shipping_pct_of_subtotal"),
        ("avg_subtotal", "mean", subtotal)]).orderBy(F.col("avg_shipping_pct").desc(), by)
    return overall, per


def delivery_performance(orders: DataFrame, by: str = "category", days: str = "delivery_days",
                         order_id: str = "order_id") -> tuple[DataFrame, DataFrame]:
    """Delivery days overall (mean/median/std) and per ``by`` sorted by median."""
    overall = segment_profile(orders, [], [("mean_delivery", "mean", days), ("median_delivery", "median", days),
                                           ("std_delivery", "std", days)])
    per = segment_profile(orders, [by], [
        ("avg_delivery", "mean", days), ("median_delivery", "median", days),
        ("std_delivery", "std", days), ("total_orders", "count", order_id)]
    ).orderBy(F.col("median_delivery").desc(), by)
    return overall, per


def customer_behavior_rollup(orders: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Customer-level behaviour means (A14), rounded to 3 dp as the reference."""
    return segment_profile(orders, [customer], [
        ("avg_order_value", "mean", "total_amount_usd"),
        ("avg_session_duration", "mean", "session_duration_minutes"),
        ("avg_pages_viewed", "mean", "pages_viewed_before_purchase"),
        ("avg_customer_rating", "mean", "customer_rating"),
        ("total_orders", "count", "order_id")], digits=3)


def add_quantile_bin(df: DataFrame, value: str, q: int, labels: Sequence[str], out: str) -> DataFrame:
    """Quantile bins (P4, ``pd.qcut``): exact interpolated edges, right-closed, lowest included.

    Edges are one aggregate row broadcast to every task; ties at an edge stay
    in the lower bin (not equal-count like ``ntile``).
    """
    from basketlens.operators.quantile import quantile_frame

    probs = [i / q for i in range(q + 1)]
    edges = quantile_frame(df, value, probs, out="_bl_edges")
    x = F.col(value).cast("double")
    e = F.col("_bl_edges")
    expr = None
    for i, lbl in enumerate(labels):
        lower = (x >= e[0]) if i == 0 else (x > e[i])
        cond = lower & (x <= e[i + 1])
        expr = F.when(cond, F.lit(lbl)) if expr is None else expr.when(cond, F.lit(lbl))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, expr).drop("_bl_edges")


def quartile_profile(rollup: DataFrame, value: str = "avg_order_value",
                     metrics: Sequence[str] = ("avg_session_duration", "avg_pages_viewed", "avg_customer_rating"),
                     q: int = 4, labels: Sequence[str] = QUARTILE_LABELS) -> DataFrame:
    """Behaviour by value quartile (A15): two-level aggregation over A14."""
    binned = add_quantile_bin(rollup, value, q, labels, "value_quartile")
    # A14 output is rounded to 3 dp: average it as exact decimals.
    binned = binned.withColumns({m: F.col(m).cast("decimal(24,3)") for m in metrics})
    return segment_profile(binned, ["value_quartile"], [(m, "mean", m) for m in metrics], digits=3)


def new_vs_returning(orders: DataFrame, flag_col: str = "is_repeat_customer",
                     amount: str = "total_amount_usd") -> DataFrame:
    """New vs returning customers (A16) with revenue share (W3) and return %."""
    typed = orders.withColumn("customer_type", recode(flag_col, {0: "New", 1: "Returning"}))
    res = segment_profile(typed, ["customer_type"], [
        ("order_count", "count", "order_id"), ("total_revenue", "sum", amount),
        ("avg_order_value", "mean", amount), ("median_order", "median", amount),
        ("avg_discount", "mean", "discount_pct"), ("return_rate", "mean", "returned")])
    tot = res.agg(F.sum(F.col("total_revenue").cast("decimal(24,2)")).cast("double").alias("_bl_all"))
    return (res.crossJoin(F.broadcast(tot))
               .withColumn("revenue_share_pct", pround(F.col("total_revenue") / F.col("_bl_all") * 100, 1))
               .withColumn("return_rate", pround(F.col("return_rate") * 100, 1))
               .drop("_bl_all"))


def _with_share(res: DataFrame, count_col: str, out: str) -> DataFrame:
    tot = res.agg(F.sum(count_col).cast("double").alias("_bl_all"))
    return (res.crossJoin(F.broadcast(tot))
               .withColumn(out, pround(F.col(count_col) / F.col("_bl_all") * 100, 1))
               .drop("_bl_all"))


def payment_profile(orders: DataFrame, key: str = "payment_method", amount: str = "total_amount_usd") -> DataFrame:
    """Payment method profile (A17) sorted by average order value."""
    res = segment_profile(orders, [key], [
        ("order_count", "count", "order_id"), ("avg_order_value", "mean", amount),
        ("avg_discount", "mean", "discount_pct"), ("return_rate", "mean", "returned")])
    res = _with_share(res, "order_count", "order_share_pct")
    return (res.withColumn("return_rate", pround(F.col("return_rate") * 100, 1))
               .orderBy(F.col("avg_order_value").desc(), key))


def device_profile(orders: DataFrame, key: str = "device_used", amount: str = "total_amount_usd") -> DataFrame:
    """Device profile (A17) sorted by average order value."""
    res = segment_profile(orders, [key], [
        ("order_count", "count", "order_id"), ("avg_order_value", "mean", amount),
        ("avg_session", "mean", "session_duration_minutes"),
        ("avg_pages", "mean", "pages_viewed_before_purchase"), ("return_rate", "mean", "returned")])
    res = _with_share(res, "order_count", "order_share_pct")
    return (res.withColumn("return_rate", pround(F.col("return_rate") * 100, 1))
               .orderBy(F.col("avg_order_value").desc(), key))


def return_rate_by(orders: DataFrame, dims: Sequence[str], returned: str = "returned") -> DataFrame:
    """Return rate per value of each dimension in one pass.

    Long output ``(dimension, segment, return_rate, returns, total_orders)``;
    rate rounded to 4 dp then x100 to 2 dp, as the reference.
    """
    long = long_by_dimension(orders, dims, [returned])
    res = long.groupBy("dimension", "segment").agg(
        pround(mean(returned), 4).alias("return_rate"), total(returned).cast("bigint").alias("returns"),
        F.count(returned).alias("total_orders"))
    return res.withColumn("return_rate", pround(F.col("return_rate") * 100, 2))


def crosstab(df: DataFrame, dim: str, outcome: str) -> DataFrame:
    """Long contingency counts ``(dim, outcome, n)`` (A26); null cells dropped."""
    return (df.filter(F.col(dim).isNotNull() & F.col(outcome).isNotNull())
              .groupBy(dim, outcome).agg(F.count(F.lit(1)).alias("n")))


def label_counts(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """Value counts in label order (A31), absent labels dropped."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return reindex_domain(counts, label, order, mode="present").orderBy(f"{label}_ord")
