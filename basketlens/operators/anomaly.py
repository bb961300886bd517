"""Three-method anomaly detection over customer order profiles.

Plan shape: one ``groupBy(customer)`` aggregate (partial aggregation, the two
distinct counts via Catalyst's Expand), joined to customer attributes after
aggregating; one statistics aggregate over an ``unpivot`` of the metrics (one
row per metric); flags are projections against those statistics joined by
broadcast (at most a handful of rows). Nothing is collected except the
isolation-forest model (bounded: trees x nodes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.core import bin_expr, flag, mean, pround
from basketlens.session import saved

# History depth bins (right-closed) and consensus tiers.
HISTORY_EDGES = [0, 2, 5, 15, float("inf")]
HISTORY_LABELS = ["thin (<3)", "low (3-5)", "medium (6-15)", "deep (16+)"]
CONSENSUS_EDGES = [-1, 0, 1, 2, 3]
CONSENSUS_LABELS = ["Clean", "Low", "Medium", "High"]

BASELINE_METRICS = ["return_rate", "wardrobing_index", "refund_velocity", "order_velocity", "avg_order_value",
                    "payment_methods_used", "payment_velocity", "return_value_ratio"]
ELIGIBLE_ONLY = {"return_rate", "wardrobing_index", "return_value_ratio"}
SPC_EXCLUDE = {"payment_methods_used"}
FOREST_FEATURES = ["return_rate", "avg_order_value", "order_velocity", "avg_discount_pct",
                   "payment_methods_used", "return_value_ratio", "total_orders"]
FLAGGED_COLUMNS = ["customer_id", "country", "membership_tier", "history_depth", "total_orders", "total_returns",
                   "return_rate", "avg_order_value", "order_velocity", "refund_velocity", "payment_velocity",
                   "rule_flag_count", "spc_flag_count", "iso_flagged", "methods_flagged", "consensus_tier",
                   "iso_anomaly_score"]


def customer_order_profile(orders: DataFrame, customers: DataFrame, customer: str = "customer_id",
                           amount: str = "total_amount_usd", attributes: Sequence[str] = (
                               "membership_tier", "country", "churned")) -> DataFrame:
    """Per-customer order behaviour (A19 + J1).

    Aggregate first, then inner-join the customer attributes (they depend
    functionally on the key, N15), so the join sees one row per customer.
    """
    from basketlens.functions.core import MICRO_SUFFIX, micro_mean, micro_sum

    ret = F.col("returned") == 1
    amt = F.col(amount)
    if f"{amount}{MICRO_SUFFIX}" in orders.columns:  # exact integer twin: long sums
        mic = F.col(f"{amount}{MICRO_SUFFIX}")
        avg_v, sum_v, ret_v = micro_mean(mic), micro_sum(mic), micro_mean(F.when(ret, mic))
    else:
        avg_v, sum_v, ret_v = mean(amt), F.sum(amt), mean(F.when(ret, amt))
    prof = orders.groupBy(customer).agg(
        F.count("order_id").alias("total_orders"),
        F.sum(F.when(ret, 1).otherwise(0)).alias("total_returns"),
        pround(avg_v, 2).alias("avg_order_value"),
        pround(sum_v, 2).alias("total_spend"),
        pround(ret_v, 2).alias("avg_returned_value"),
        pround(mean("discount_pct"), 2).alias("avg_discount_pct"),
        F.count_distinct("payment_method").alias("payment_methods_used"),
        F.count_distinct("device_used").alias("devices_used"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"))
    return prof.join(customers.select(customer, *attributes), customer, "inner")


def anomaly_features(profile: DataFrame, min_orders: int = 3) -> DataFrame:
    """Behavioural features (D9) with history gates; NULL means 'not enough history'."""
    age = F.datediff(F.col("last_order_date"), F.col("first_order_date"))
    age = F.when(age.isNotNull(), F.greatest(age, F.lit(1)))
    n, r = F.col("total_orders"), F.col("total_returns")
    eligible = n >= min_orders
    arv = F.coalesce(F.col("avg_returned_value"), F.lit(0.0))
    return (profile
            .withColumn("account_age_days", age)
            .withColumn("return_rate", F.when(eligible, r / n))
            .withColumn("refund_velocity", F.when(r >= 2, F.try_divide(r.cast("double"), F.col("account_age_days") / 30))
                                            .otherwise(F.lit(0.0)))
            .withColumn("wardrobing_index", F.when(eligible, F.col("return_rate") * arv))
            .withColumn("order_velocity", pround(F.try_divide(n.cast("double"), F.col("account_age_days") / 30), 4))
            .withColumn("payment_velocity", pround(F.try_divide(F.col("payment_methods_used").cast("double"),
                                                                F.log1p(n.cast("double"))), 4))
            .withColumn("return_value_ratio", pround(F.try_divide(arv, F.col("avg_order_value")), 4))
            .withColumn("history_depth", bin_expr("total_orders", HISTORY_EDGES, HISTORY_LABELS))
            .withColumn("history_depth_ord", F.array_position(F.array(*[F.lit(x) for x in HISTORY_LABELS]),
                                                              F.col("history_depth")).cast("int") - 1))


def metric_long(features: DataFrame, metrics: Sequence[str] = BASELINE_METRICS,
                eligible_only: set[str] = ELIGIBLE_ONLY) -> DataFrame:
    """``(metric, value)`` rows, non-null values only; return-type metrics on eligible rows."""
    elig = F.col("return_rate").isNotNull()
    cols = [F.when(elig, F.col(m)).cast("double").alias(m) if m in eligible_only else F.col(m).cast("double").alias(m)
            for m in metrics]
    return (features.select(*cols).unpivot([], list(metrics), "metric", "value")
                    .filter(F.col("value").isNotNull()))


def baselines(features: DataFrame, metrics: Sequence[str] = BASELINE_METRICS) -> DataFrame:
    """Per-metric n, mean, median, std, p75, p90, p95, p99, iqr."""
    from basketlens.operators.quantile import quantile_frame

    long = saved(metric_long(features, metrics), "metrics")  # read by the moments and the quantiles
    probs = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    stats = [F.count(F.lit(1)).alias("n"), mean("value").alias("mean"), F.stddev_samp("value").alias("std")]
    agg = long.groupBy("metric").agg(*stats).join(quantile_frame(long, "value", probs, ["metric"]), "metric")
    return agg.select("metric", "n", "mean", F.col("_q")[1].alias("median"), "std",
                      F.col("_q")[2].alias("p75"), F.col("_q")[3].alias("p90"), F.col("_q")[4].alias("p95"),
                      F.col("_q")[5].alias("p99"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))


def _stat(b: Column, metric: str, stat: str) -> Column:
    return F.max(F.when(F.col("metric") == metric, F.col(stat)))


# Fallbacks used when a metric has no baseline row (reference defaults).
_FALLBACK = {
    "loose": {"rr": ("return_rate", "p90", 0.333), "rv": ("refund_velocity", "p90", 1.0),
              "ov": ("order_velocity", "p95", 30.0), "wi": ("wardrobing_index", "p90", 50.0)},
    "strict": {"rr": ("return_rate", "p95", 0.5), "rv": ("refund_velocity", "p95", 2.0),
               "ov": ("order_velocity", "p99", 30.0), "wi": ("wardrobing_index", "p95", 100.0)},
    "moderate": {"rr": ("return_rate", "p90", 0.333, 0.1), "rv": ("refund_velocity", "p90", 1.0, 0.5),
                 "ov": ("order_velocity", "p90", 20.0, 5.0), "wi": ("wardrobing_index", "p90", 50.0, 20.0)},
}


def rule_thresholds(base: DataFrame, strictness: str = "moderate") -> DataFrame:
    """One-row thresholds (R1): loose p90s, strict p95/p99, moderate p90 + 1.5 iqr.

    Payment cycling always uses payment_velocity p90.
    """
    spec = _FALLBACK[strictness]
    exprs = []
    for name, s in spec.items():
        metric, stat, fb = s[0], s[1], s[2]
        v = F.coalesce(_stat(None, metric, stat), F.lit(fb))
        if strictness == "moderate":
            v = v + 1.5 * F.coalesce(_stat(None, metric, "iqr"), F.lit(s[3]))
        exprs.append(v.alias(f"{name}_threshold"))
    exprs.append(_stat(None, "payment_velocity", "p90").alias("pv_threshold"))
    return base.agg(*exprs)


def rule_flags(features: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Five behavioural rule flags, their count and any-flag (R2)."""
    flags = {
        "flag_wardrobing": flag(F.col("return_rate") > F.col("rr_threshold")),
        "flag_high_value_returns": flag(F.col("wardrobing_index") > F.col("wi_threshold")),
        "flag_refund_velocity": flag(F.col("refund_velocity") > F.col("rv_threshold")),
        "flag_order_velocity": flag(F.col("order_velocity") > F.col("ov_threshold")),
        "flag_payment_cycling": flag(F.col("payment_velocity") > F.col("pv_threshold")),
    }
    out = features.crossJoin(F.broadcast(thresholds)).withColumns(flags)
    cnt = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    return (out.withColumn("rule_flag_count", cnt)
               .withColumn("rule_flagged", F.col("rule_flag_count") > 0)
               .drop("rr_threshold", "wi_threshold", "rv_threshold", "ov_threshold", "pv_threshold"))


def spc_flags(features: DataFrame, base: DataFrame, z_threshold: float = 2.5, fence: float = 3.0,
              z_round: int | None = 3, metrics: Sequence[str] = BASELINE_METRICS) -> DataFrame:
    """Upper-tail z-score and Tukey fence flags per metric.

    z = (x - mean) / std, rounded to ``z_round`` dp before the comparison as
    the reference does (``None`` compares unrounded); std = 0 gives no z flag.
    """
    cols = [m for m in metrics if m not in SPC_EXCLUDE and m in features.columns]
    stats = base.agg(*[F.struct(_stat(None, m, "mean").alias("mean"), _stat(None, m, "std").alias("std"),
                                 (_stat(None, m, "p75") + fence * _stat(None, m, "iqr")).alias("fence"))
                       .alias(f"_bl_{m}") for m in cols])
    out = features.crossJoin(F.broadcast(stats))
    new = {}
    for m in cols:
        s = F.col(f"_bl_{m}")
        z = F.try_divide(F.col(m) - s["mean"], s["std"])
        z = pround(z, z_round) if z_round is not None else z
        new[f"z_{m}"] = z
        new[f"zscore_flag_{m}"] = flag(z > z_threshold)
        new[f"iqr_flag_{m}"] = flag(F.col(m) > s["fence"])
    out = out.withColumns(new).drop(*[f"_bl_{m}" for m in cols])
    flag_cols = [f"zscore_flag_{m}" for m in cols] + [f"iqr_flag_{m}" for m in cols]
    cnt = sum((F.col(c).cast("int") for c in flag_cols), F.lit(0))
    return out.withColumn("spc_flag_count", cnt).withColumn("spc_flagged", F.col("spc_flag_count") > 0)


def consensus(df: DataFrame) -> DataFrame:
    """Methods agreeing (0-3) and the consensus tier."""
    m = F.col("rule_flagged").cast("int") + F.col("spc_flagged").cast("int") + F.col("iso_flagged").cast("int")
    return (df.withColumn("methods_flagged", m)
              .withColumn("consensus_tier", bin_expr("methods_flagged", CONSENSUS_EDGES, CONSENSUS_LABELS))
              .withColumn("consensus_tier_ord", F.col("methods_flagged")))


def flagged_customers(df: DataFrame, min_methods: int = 2) -> DataFrame:
    """Review list (R6): at least ``min_methods`` methods, most agreement and lowest score first."""
    return (df.filter(F.col("methods_flagged") >= min_methods).select(*FLAGGED_COLUMNS)
              .orderBy(F.col("methods_flagged").desc(), F.col("iso_anomaly_score").asc(), F.col("customer_id")))


def tradeoff_table(features: DataFrame, base: DataFrame, metric: str = "return_rate") -> DataFrame:
    """Flag volume and severity at five cut-offs in one aggregate pass.

    The row labelled 'Very strict (p99)' uses p95 + 2 std, as the reference.
    """
    # The reference's threshold labels, strictest first.
    labels = ["Very strict (p99)", "Strict (p95)", "Moderate (p90+IQR)", "Loose (p90)", "Very loose (p75)"]
    cut = base.agg(F.array(_stat(None, metric, "p95") + 2 * _stat(None, metric, "std"),
                           _stat(None, metric, "p95"),
                           _stat(None, metric, "p90") + 1.5 * _stat(None, metric, "iqr"),
                           _stat(None, metric, "p90"), _stat(None, metric, "p75")).alias("_bl_cut"))
    x = F.col(metric)
    j = features.select(metric).crossJoin(F.broadcast(cut))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i in range(5):
        hit = x > F.col("_bl_cut")[i]
        aggs += [F.count(F.when(hit, 1)).alias(f"c{i}"), F.sum(F.when(hit, x)).alias(f"s{i}"),
                 F.first(F.col("_bl_cut")[i]).alias(f"k{i}")]
    row = j.agg(*aggs)
    parts = [F.struct(F.lit(lbl).alias("threshold_level"), F.lit(i).alias("level_ord"),
                      F.col(f"k{i}").alias("cutoff"), F.col(f"c{i}").alias("flagged"),
                      (F.col(f"c{i}") * 100.0 / F.col("_n")).alias("flag_pct"),
                      F.coalesce(F.try_divide(F.col(f"s{i}"), F.col(f"c{i}").cast("double")),
                                 F.lit(0.0)).alias("avg_flagged"))
             for i, lbl in enumerate(labels)]
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def flag_summary(df: DataFrame, flag_cols: Sequence[str], count: str | None = None) -> DataFrame:
    """Count and share of every flag column in one aggregate.

    With ``count``, the column that counts a row's flags, two rows follow: any
    flag and two or more.
    """
    named = {c: F.col(c) for c in flag_cols}
    if count:
        named.update({"any": F.col(count) > 0, "two_or_more": F.col(count) >= 2})
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(k) for k, c in named.items()])
    parts = [F.struct(F.lit(k).alias("flag"), F.col(k).cast("bigint").alias("flagged"),
                      F.try_divide(F.col(k) * 100.0, F.col("_n")).alias("flag_pct")) for k in named]
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def spc_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows flagged per metric by z-score and by fence, and the flagged rows in all (A29), in one aggregate."""
    def hits(c: str) -> Column:
        return F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("bigint")

    row = df.agg(*[F.struct(F.lit(m).alias("metric"), hits(f"zscore_flag_{m}").alias("z_flagged"), hits(f"iqr_flag_{m}").alias("fence_flagged")).alias(f"_{m}")
                   for m in metrics], hits("spc_flagged").alias("spc_flagged"))
    return row.select("spc_flagged", F.explode(F.array(*[F.col(f"_{m}") for m in metrics])).alias("s")).select("s.*", "spc_flagged")


def forest_summary(df: DataFrame) -> DataFrame:
    """Rows the forest flags, their share, and the range of scores."""
    return df.agg(F.sum(F.col("iso_flagged").cast("int")).alias("flagged"), F.count(F.lit(1)).alias("n"),
                  F.min("iso_anomaly_score").alias("lowest"), F.max("iso_anomaly_score").alias("highest")).withColumn(
        "flag_pct", F.try_divide(F.col("flagged") * 100.0, F.col("n")))


def high_confidence_profile(df: DataFrame, metrics: Sequence[str] = (
        "return_rate", "avg_order_value", "order_velocity", "churned"), level: int = 3) -> DataFrame:
    """Mean metrics of rows flagged by ``level`` methods vs the population."""
    hi = F.col("methods_flagged") == level
    row = df.agg(*[mean(F.when(hi, F.col(m))).alias(f"h_{m}") for m in metrics],
                 *[mean(m).alias(f"p_{m}") for m in metrics],
                 F.count(F.when(hi, 1)).alias("high_n"))
    parts = [F.struct(F.lit(m).alias("metric"), F.col(f"h_{m}").alias("high_confidence"),
                      F.col(f"p_{m}").alias("population"), F.col("high_n").alias("high_n")) for m in metrics]
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
