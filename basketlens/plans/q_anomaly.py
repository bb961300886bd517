"""Anomaly-detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlens.functions.core import pround
from basketlens.operators import anomaly, charts, forest, profile
from basketlens.plans.oracle import mean, rnd
from basketlens.plans.registry import register
from basketlens.session import saved
from basketlens.sources import retail

MIN_ORDERS = 3

_PROFILE = f"""
prof AS (SELECT customer_id, count(order_id) AS total_orders,
                sum(CASE WHEN returned = 1 THEN 1 ELSE 0 END) AS total_returns,
                {rnd(mean('total_amount_usd'))} AS avg_order_value, {rnd('sum(total_amount_usd)')} AS total_spend,
                {rnd(mean('CASE WHEN returned = 1 THEN total_amount_usd END'))} AS avg_returned_value,
                {rnd(mean('discount_pct'))} AS avg_discount_pct,
                count(DISTINCT payment_method) AS payment_methods_used, count(DISTINCT device_used) AS devices_used,
                min(order_date) AS first_order_date, max(order_date) AS last_order_date
         FROM v_lines GROUP BY customer_id),
p AS (SELECT prof.*, c.membership_tier, c.country, c.churned FROM prof JOIN v_customers c
      ON prof.customer_id = c.customer_id),
f0 AS (SELECT *, CASE WHEN date_diff('day', first_order_date, last_order_date) IS NOT NULL
                      THEN greatest(date_diff('day', first_order_date, last_order_date), 1) END AS account_age_days
       FROM p),
f1 AS (SELECT *, CASE WHEN total_orders >= {MIN_ORDERS} THEN CAST(total_returns AS DOUBLE) / total_orders END
                 AS return_rate FROM f0),
feat AS (SELECT *,
   CASE WHEN total_returns >= 2 THEN CAST(total_returns AS DOUBLE) / (CAST(account_age_days AS DOUBLE) / 30)
        ELSE 0.0 END AS refund_velocity,
   CASE WHEN total_orders >= {MIN_ORDERS} THEN return_rate * coalesce(avg_returned_value, 0.0) END AS wardrobing_index,
   {rnd('CAST(total_orders AS DOUBLE) / (CAST(account_age_days AS DOUBLE) / 30)', 4)} AS order_velocity,
   {rnd('CAST(payment_methods_used AS DOUBLE) / ln(1 + CAST(total_orders AS DOUBLE))', 4)} AS payment_velocity,
   {rnd('coalesce(avg_returned_value, 0.0) / avg_order_value', 4)} AS return_value_ratio,
   CASE WHEN total_orders > 0 AND total_orders <= 2 THEN 'thin (<3)'
        WHEN total_orders > 2 AND total_orders <= 5 THEN 'low (3-5)'
        WHEN total_orders > 5 AND total_orders <= 15 THEN 'medium (6-15)'
        WHEN total_orders > 15 THEN 'deep (16+)' END AS history_depth
   FROM f1)"""

_METRICS = anomaly.BASELINE_METRICS
_LONG = "\nUNION ALL\n".join(
    (f"SELECT '{m}' AS metric, CAST(CASE WHEN return_rate IS NOT NULL THEN {m} END AS DOUBLE) AS value FROM feat"
     if m in anomaly.ELIGIBLE_ONLY else f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM feat")
    for m in _METRICS)

_BASE = f"""
lng AS ({_LONG}),
b0 AS (SELECT metric, count(*) AS n, {mean('value')} AS mean, stddev_samp(value) AS std,
              quantile_cont(value, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q
       FROM lng WHERE value IS NOT NULL GROUP BY metric),
base AS (SELECT metric, n, mean, q[2] AS median, std, q[3] AS p75, q[4] AS p90, q[5] AS p95, q[6] AS p99,
                q[3] - q[1] AS iqr FROM b0)"""


def _st(metric: str, stat: str) -> str:
    return f"max(CASE WHEN metric = '{metric}' THEN {stat} END)"


_THR = f"""
thr AS (SELECT coalesce({_st('return_rate', 'p90')}, 0.333) + 1.5 * coalesce({_st('return_rate', 'iqr')}, 0.1) AS rr_threshold,
               coalesce({_st('refund_velocity', 'p90')}, 1.0) + 1.5 * coalesce({_st('refund_velocity', 'iqr')}, 0.5) AS rv_threshold,
               coalesce({_st('order_velocity', 'p90')}, 20.0) + 1.5 * coalesce({_st('order_velocity', 'iqr')}, 5.0) AS ov_threshold,
               coalesce({_st('wardrobing_index', 'p90')}, 50.0) + 1.5 * coalesce({_st('wardrobing_index', 'iqr')}, 20.0) AS wi_threshold,
               {_st('payment_velocity', 'p90')} AS pv_threshold
        FROM base)"""


# Percentile and default of each threshold when none is measured.
_PLAIN = {"loose": {"rr": ("return_rate", "p90", 0.333), "rv": ("refund_velocity", "p90", 1.0),
                    "ov": ("order_velocity", "p95", 30.0), "wi": ("wardrobing_index", "p90", 50.0)},
          "strict": {"rr": ("return_rate", "p95", 0.5), "rv": ("refund_velocity", "p95", 2.0),
                     "ov": ("order_velocity", "p99", 30.0), "wi": ("wardrobing_index", "p95", 100.0)}}


def _thr_sql(strictness: str) -> str:
    if strictness == "moderate":
        return _THR
    cols = ", ".join(f"coalesce({_st(m, p)}, {d}) AS {k}_threshold" for k, (m, p, d) in _PLAIN[strictness].items())
    return f"thr AS (SELECT {cols}, {_st('payment_velocity', 'p90')} AS pv_threshold FROM base)"


def _features(spark, base):
    prof = anomaly.customer_order_profile(retail.lines(spark, base), retail.customer_attributes(spark, base))
    return anomaly.anomaly_features(prof, MIN_ORDERS)


@register("a19_customer_order_profile", f"""
WITH {_PROFILE}
SELECT customer_id, total_orders, CAST(total_returns AS BIGINT) AS total_returns, avg_order_value, total_spend,
       avg_returned_value, avg_discount_pct, payment_methods_used, devices_used, first_order_date, last_order_date,
       membership_tier, country, churned FROM p""")
def a19_customer_order_profile(spark, base):
    return anomaly.customer_order_profile(retail.lines(spark, base), retail.customer_attributes(spark, base))


@register("d9_anomaly_features", f"""
WITH {_PROFILE}
SELECT customer_id, account_age_days, return_rate, refund_velocity, wardrobing_index, order_velocity,
       payment_velocity, return_value_ratio, history_depth FROM feat""")
def d9_anomaly_features(spark, base):
    return _features(spark, base).select("customer_id", "account_age_days", "return_rate", "refund_velocity",
                                         "wardrobing_index", "order_velocity", "payment_velocity",
                                         "return_value_ratio", "history_depth")


_STATS6 = ["mean", "median", "std", "p75", "p90", "p95", "p99", "iqr"]


@register("a20_baselines", f"""
WITH {_PROFILE}, {_BASE}
SELECT metric, n, {', '.join(f"{rnd(s, 6)} AS {s}" for s in _STATS6)} FROM base""")
def a20_baselines(spark, base):
    b = anomaly.baselines(_features(spark, base))
    return b.select("metric", "n", *[pround(s, 6).alias(s) for s in _STATS6])


@register("r1_rule_thresholds", f"""
WITH {_PROFILE}, {_BASE}, {_THR}
SELECT {', '.join(f"{rnd(c, 6)} AS {c}" for c in ('rr_threshold', 'rv_threshold', 'ov_threshold', 'wi_threshold', 'pv_threshold'))}
FROM thr""")
def r1_rule_thresholds(spark, base):
    t = anomaly.rule_thresholds(anomaly.baselines(_features(spark, base)), "moderate")
    return t.select(*[pround(c, 6).alias(c) for c in t.columns])


_RULES = ["flag_wardrobing", "flag_high_value_returns", "flag_refund_velocity", "flag_order_velocity",
          "flag_payment_cycling"]

_RULE_SQL = f"""
rules AS (SELECT customer_id,
   coalesce(return_rate > rr_threshold, false) AS flag_wardrobing,
   coalesce(wardrobing_index > wi_threshold, false) AS flag_high_value_returns,
   coalesce(refund_velocity > rv_threshold, false) AS flag_refund_velocity,
   coalesce(order_velocity > ov_threshold, false) AS flag_order_velocity,
   coalesce(payment_velocity > pv_threshold, false) AS flag_payment_cycling
 FROM feat, thr),
rc AS (SELECT *, {' + '.join(f'CAST({c} AS INTEGER)' for c in _RULES)} AS rule_flag_count FROM rules)"""


def _rules(spark, base):
    f = _features(spark, base)
    return anomaly.rule_flags(f, anomaly.rule_thresholds(anomaly.baselines(f), "moderate"))


@register("r2_rule_flags", f"""
WITH {_PROFILE}, {_BASE}, {_THR}, {_RULE_SQL}
SELECT *, rule_flag_count > 0 AS rule_flagged FROM rc""")
def r2_rule_flags(spark, base):
    return _rules(spark, base).select("customer_id", *_RULES, "rule_flag_count", "rule_flagged")


@register("a29_rule_flag_summary", f"""
WITH {_PROFILE}, {_BASE}, {_THR}, {_RULE_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS flag, CAST(sum(CAST({c} AS INTEGER)) AS BIGINT) AS flagged, "
                    f"sum(CAST({c} AS INTEGER)) * CAST(100 AS DOUBLE) / count(*) AS flag_pct FROM rc" for c in _RULES)}""")
def a29_rule_flag_summary(spark, base):
    return anomaly.flag_summary(_rules(spark, base), _RULES)


def _rules_at(spark, base, strictness):
    f = saved(_features(spark, base), "features")
    return anomaly.rule_flags(f, anomaly.rule_thresholds(anomaly.baselines(f), strictness))


def _summary_sql(flags, count: str) -> str:
    named = [*[(c, f"CAST({c} AS INTEGER)") for c in flags], ("any", f"CAST({count} > 0 AS INTEGER)"), ("two_or_more", f"CAST({count} >= 2 AS INTEGER)")]
    return " UNION ALL ".join(f"SELECT '{n}' AS flag, CAST(sum({e}) AS BIGINT) AS flagged, sum({e}) * CAST(100 AS DOUBLE) / count(*) AS flag_pct FROM rc" for n, e in named)


def _register_strictness(strictness: str) -> None:
    head = f"WITH {_PROFILE}, {_BASE}, {_thr_sql(strictness)}"
    names = ("rr_threshold", "rv_threshold", "ov_threshold", "wi_threshold", "pv_threshold")

    @register(f"r1_rule_thresholds_{strictness}", f"{head} SELECT {', '.join(f'{rnd(c, 6)} AS {c}' for c in names)} FROM thr")
    def thresholds(spark, base):
        t = anomaly.rule_thresholds(anomaly.baselines(_features(spark, base)), strictness)
        return t.select(*[pround(c, 6).alias(c) for c in names])

    @register(f"r2_rule_flags_{strictness}", f"{head}, {_RULE_SQL} SELECT *, rule_flag_count > 0 AS rule_flagged FROM rc")
    def flags(spark, base):
        return _rules_at(spark, base, strictness).select("customer_id", *_RULES, "rule_flag_count", "rule_flagged")


_register_strictness("loose")
_register_strictness("strict")


def _register_summary(strictness: str) -> None:
    @register(f"a29_rule_summary_{strictness}", f"WITH {_PROFILE}, {_BASE}, {_thr_sql(strictness)}, {_RULE_SQL} {_summary_sql(_RULES, 'rule_flag_count')}")
    def summary(spark, base):
        """Every rule, any rule, and two or more of them."""
        return anomaly.flag_summary(_rules_at(spark, base, strictness), _RULES, "rule_flag_count")


for _level in ("loose", "moderate", "strict"):
    _register_summary(_level)


_SPC = [m for m in _METRICS if m not in anomaly.SPC_EXCLUDE]


def _spc_sql() -> str:
    zs, flags = [], []
    for m in _SPC:
        z = rnd(f"({m} - {_st(m, 'mean')}) / nullif({_st(m, 'std')}, 0)", 3)
        zs.append(f"{z} AS z_{m}")
        flags.append(f"{_st(m, 'p75')} + 3.0 * {_st(m, 'iqr')} AS fence_{m}")
    stat_cols = ", ".join([f"{_st(m, 'mean')} AS mean_{m}, {_st(m, 'std')} AS std_{m}" for m in _SPC] + flags)
    zexpr = ", ".join(f"{rnd(f'({m} - mean_{m}) / nullif(std_{m}, 0)', 3)} AS z_{m}" for m in _SPC)
    fl = " + ".join([f"CAST(coalesce(z_{m} > 2.5, false) AS INTEGER)" for m in _SPC]
                    + [f"CAST(coalesce({m} > fence_{m}, false) AS INTEGER)" for m in _SPC])
    return f"""
st AS (SELECT {stat_cols} FROM base),
z AS (SELECT feat.*, st.*, {zexpr} FROM feat, st)
SELECT customer_id, {', '.join(f'z_{m}' for m in _SPC)}, {fl} AS spc_flag_count, ({fl}) > 0 AS spc_flagged FROM z"""


@register("r3_spc_flags", f"WITH {_PROFILE}, {_BASE},{_spc_sql()}")
def r3_spc_flags(spark, base):
    f = _features(spark, base)
    s = anomaly.spc_flags(f, anomaly.baselines(f))
    return s.select("customer_id", *[f"z_{m}" for m in _SPC], "spc_flag_count", "spc_flagged")


@register("a28_tradeoff_table", f"""
WITH {_PROFILE}, {_BASE},
cut AS (SELECT {_st('return_rate', 'p95')} + 2 * {_st('return_rate', 'std')} AS c0, {_st('return_rate', 'p95')} AS c1,
               {_st('return_rate', 'p90')} + 1.5 * {_st('return_rate', 'iqr')} AS c2, {_st('return_rate', 'p90')} AS c3,
               {_st('return_rate', 'p75')} AS c4 FROM base),
lv AS (SELECT * FROM (VALUES ('Very strict (p99)', 0), ('Strict (p95)', 1), ('Moderate (p90+IQR)', 2),
                             ('Loose (p90)', 3), ('Very loose (p75)', 4)) v(threshold_level, level_ord)),
k AS (SELECT lv.*, CASE level_ord WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END AS cutoff
      FROM lv, cut)
SELECT threshold_level, level_ord, {rnd('cutoff', 6)} AS cutoff,
       count(CASE WHEN f.return_rate > k.cutoff THEN 1 END) AS flagged,
       {rnd('count(CASE WHEN f.return_rate > k.cutoff THEN 1 END) * CAST(100 AS DOUBLE) / count(*)', 6)} AS flag_pct,
       {rnd('coalesce(sum(CASE WHEN f.return_rate > k.cutoff THEN f.return_rate END) / CAST(nullif(count(CASE WHEN f.return_rate > k.cutoff THEN 1 END), 0) AS DOUBLE), 0.0)', 6)} AS avg_flagged
FROM k, feat f GROUP BY threshold_level, level_ord, cutoff""")
def a28_tradeoff_table(spark, base):
    f = _features(spark, base)
    t = anomaly.tradeoff_table(f, anomaly.baselines(f))
    return t.select("threshold_level", "level_ord", pround("cutoff", 6).alias("cutoff"), "flagged",
                    pround("flag_pct", 6).alias("flag_pct"), pround("avg_flagged", 6).alias("avg_flagged"))


@register("a31_history_depth_counts", f"""
WITH {_PROFILE}
SELECT f.history_depth, count(*) AS n, d.history_depth_ord FROM feat f
JOIN (VALUES ('thin (<3)', 0), ('low (3-5)', 1), ('medium (6-15)', 2), ('deep (16+)', 3)) d(history_depth, history_depth_ord)
  ON f.history_depth = d.history_depth
GROUP BY f.history_depth, d.history_depth_ord""")
def a31_history_depth_counts(spark, base):
    return profile.label_counts(_features(spark, base), "history_depth", anomaly.HISTORY_LABELS)


def _spc_summary_sql() -> str:
    stat = ", ".join(f"{_st(m, 'mean')} AS mean_{m}, {_st(m, 'std')} AS std_{m}, {_st(m, 'p75')} + 3.0 * {_st(m, 'iqr')} AS fence_{m}" for m in _SPC)
    z = {m: f"coalesce({rnd(f'({m} - mean_{m}) / nullif(std_{m}, 0)', 3)} > 2.5, false)" for m in _SPC}
    fence = {m: f"coalesce({m} > fence_{m}, false)" for m in _SPC}
    any_flag = " OR ".join([*z.values(), *fence.values()])
    return f"WITH {_PROFILE}, {_BASE}, st AS (SELECT {stat} FROM base) " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count(CASE WHEN {z[m]} THEN 1 END) AS z_flagged, count(CASE WHEN {fence[m]} THEN 1 END) AS fence_flagged, "
        f"count(CASE WHEN {any_flag} THEN 1 END) AS spc_flagged FROM feat, st" for m in _SPC)


@register("a29_spc_summary", _spc_summary_sql())
def a29_spc_summary(spark, base):
    """Flags per metric by z-score and by fence."""
    f = saved(_features(spark, base), "features")
    return anomaly.spc_summary(anomaly.spc_flags(f, anomaly.baselines(f)), _SPC)


# ---------------------------------------------------------------- forest-dependent (rows-only)

def _full(spark, base, strictness="moderate", z=2.5, contamination=0.05):
    from basketlens.plans.reports import anomaly_pipeline
    return anomaly_pipeline(retail.lines(spark, base), retail.customer_attributes(spark, base), strictness=strictness,
                            z_threshold=z, contamination=contamination, min_orders=MIN_ORDERS)


@register("m4_isolation_forest")
def m4_isolation_forest(spark, base):
    f = saved(_features(spark, base), "features")  # read by the density check, the fit and the join back
    feats = profile.dense_features(f, anomaly.FOREST_FEATURES)
    return forest.isolation_forest(f, feats, "customer_id").select("customer_id", "iso_flagged", "iso_anomaly_score")


@register("a29_forest_summary")
def a29_forest_summary(spark, base):
    f = saved(_features(spark, base), "features")
    feats = profile.dense_features(f, anomaly.FOREST_FEATURES)
    return anomaly.forest_summary(forest.isolation_forest(f, feats, "customer_id"))


@register("r5_consensus")
def r5_consensus(spark, base):
    df, _ = _full(spark, base)
    return df.select("customer_id", "rule_flagged", "spc_flagged", "iso_flagged", "methods_flagged",
                     "consensus_tier")


@register("r6_flagged_customers")
def r6_flagged_customers(spark, base):
    return _full(spark, base)[1]


@register("a30_high_confidence_profile")
def a30_high_confidence_profile(spark, base):
    df, _ = _full(spark, base)
    return anomaly.high_confidence_profile(df)


@register("a31_consensus_tier_counts")
def a31_consensus_tier_counts(spark, base):
    df, _ = _full(spark, base)
    return profile.label_counts(df, "consensus_tier", anomaly.CONSENSUS_LABELS)


@register("v4_box_summary_flagged_vs_clean")
def v4_box_summary_flagged_vs_clean(spark, base):
    df, _ = _full(spark, base)
    grp = F.when(F.col("methods_flagged") == 3, "High-flag").when(F.col("methods_flagged") == 0, "Clean")
    return charts.box_summary(df.withColumn("group", grp), ["return_rate", "avg_order_value", "order_velocity",
                                                          "avg_discount_pct"], "group")


@register("v6_method_agreement")
def v6_method_agreement(spark, base):
    df, _ = _full(spark, base)
    return charts.method_agreement(df)


_BOX = ["return_rate", "avg_order_value", "order_velocity", "avg_discount_pct"]


def _box_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT CAST(rule_flagged AS VARCHAR) AS grp, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM rf"
        for m in _BOX)
    return f"""
WITH {_PROFILE}, {_BASE}, {_THR}, {_RULE_SQL},
rf AS (SELECT feat.*, rc.rule_flag_count > 0 AS rule_flagged FROM feat JOIN rc USING (customer_id)),
l AS (SELECT * FROM ({long}) WHERE value IS NOT NULL),
q AS (SELECT grp, metric, count(*) AS n, quantile_cont(value, [0.25, 0.5, 0.75]) AS qs FROM l GROUP BY grp, metric),
f AS (SELECT *, qs[1] - 1.5 * (qs[3] - qs[1]) AS lo, qs[3] + 1.5 * (qs[3] - qs[1]) AS hi FROM q)
SELECT f.grp AS "group", f.metric, f.n, {rnd('f.qs[1]', 6)} AS q1, {rnd('f.qs[2]', 6)} AS median, {rnd('f.qs[3]', 6)} AS q3,
       min(CASE WHEN l.value >= f.lo AND l.value <= f.hi THEN l.value END) AS whisker_low,
       max(CASE WHEN l.value >= f.lo AND l.value <= f.hi THEN l.value END) AS whisker_high,
       count(CASE WHEN NOT (l.value >= f.lo AND l.value <= f.hi) THEN 1 END) AS outliers
FROM f JOIN l ON f.grp = l.grp AND f.metric = l.metric
GROUP BY f.grp, f.metric, f.n, f.qs"""


@register("v4_box_summary_rule_flagged", _box_sql())
def v4_box_summary_rule_flagged(spark, base):
    df = _rules(spark, base).withColumn("group", F.col("rule_flagged").cast("string"))
    b = charts.box_summary(df, _BOX, "group")
    return b.select("group", "metric", "n", *[pround(c, 6).alias(c) for c in ("q1", "median", "q3")],
                    "whisker_low", "whisker_high", "outliers")
