"""Order (transaction) queries: temporal, shipping, delivery, behaviour, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlens.operators import profile, stats
from basketlens.plans.oracle import mean, rnd
from basketlens.plans.registry import register
from basketlens.sources import retail

AMT = "total_amount_usd"
DIMS = ["category", "device_used", "payment_method", "day_of_week"]


def _sum(expr: str) -> str:
    return f"coalesce(CAST(sum({expr}) AS DOUBLE), 0)"


def _median(expr: str) -> str:
    return f"quantile_cont(CAST({expr} AS DOUBLE), 0.5)"


def _lines(spark, base):
    return retail.lines(spark, base)


# ------------------------------------------------------------ temporal

@register("a9_temporal_day_of_week", f"""
SELECT d.day_of_week, d.day_of_week_ord, g.total_orders, g.total_revenue, g.avg_revenue, g.median_revenue
FROM (SELECT day_of_week, count(order_id) AS total_orders, {rnd(_sum(AMT))} AS total_revenue,
             {rnd(mean(AMT))} AS avg_revenue, {rnd(_median(AMT))} AS median_revenue
      FROM v_lines WHERE day_of_week IS NOT NULL GROUP BY day_of_week) g
JOIN (VALUES ('Monday', 0), ('Tuesday', 1), ('Wednesday', 2), ('Thursday', 3), ('Friday', 4),
             ('Saturday', 5), ('Sunday', 6)) d(day_of_week, day_of_week_ord) ON g.day_of_week = d.day_of_week""")
def a9_temporal_day_of_week(spark, base):
    return profile.temporal_day_of_week(_lines(spark, base))


def _temporal_sql(k: str) -> str:
    return f"""SELECT year, {k}, count(order_id) AS total_orders, {rnd(_sum(AMT))} AS total_revenue,
       {rnd(mean(AMT))} AS avg_revenue
FROM v_lines WHERE year IS NOT NULL AND {k} IS NOT NULL GROUP BY year, {k}"""


@register("a10_temporal_month", _temporal_sql("month"))
def a10_temporal_month(spark, base):
    return profile.temporal_by(_lines(spark, base), ["year", "month"])


@register("a11_temporal_quarter", _temporal_sql("quarter"))
def a11_temporal_quarter(spark, base):
    return profile.temporal_by(_lines(spark, base), ["year", "quarter"])


# ------------------------------------------------------------ shipping / delivery

_SHIP = f"""s AS (SELECT *, CAST({rnd('CAST(shipping_fee_usd * 100 AS DOUBLE) / CAST(subtotal_usd AS DOUBLE)')}
                           AS DECIMAL(20,2)) AS shipping_pct_of_subtotal FROM v_lines)"""


@register("a12_shipping_burden_overall", f"""
WITH {_SHIP}
SELECT {rnd(mean('shipping_fee_usd'))} AS avg_shipping_fee, {rnd(mean('shipping_pct_of_subtotal'))} AS avg_shipping_pct,
       {rnd(_median('shipping_pct_of_subtotal'))} AS median_shipping_pct FROM s""")
def a12_shipping_burden_overall(spark, base):
    return profile.shipping_burden(_lines(spark, base))[0]


@register("a12_shipping_burden_by_category", f"""
WITH {_SHIP}
SELECT category, {rnd(mean('shipping_fee_usd'))} AS avg_shipping_fee,
       {rnd(mean('shipping_pct_of_subtotal'))} AS avg_shipping_pct, {rnd(mean('subtotal_usd'))} AS avg_subtotal
FROM s WHERE category IS NOT NULL GROUP BY category""")
def a12_shipping_burden_by_category(spark, base):
    return profile.shipping_burden(_lines(spark, base))[1]


@register("a13_delivery_overall", f"""
SELECT {rnd(mean('delivery_days'))} AS mean_delivery, {rnd(_median('delivery_days'))} AS median_delivery,
       {rnd('stddev_samp(CAST(delivery_days AS DOUBLE))')} AS std_delivery FROM v_lines""")
def a13_delivery_overall(spark, base):
    return profile.delivery_performance(_lines(spark, base))[0]


@register("a13_delivery_by_category", f"""
SELECT category, {rnd(mean('delivery_days'))} AS avg_delivery, {rnd(_median('delivery_days'))} AS median_delivery,
       {rnd('stddev_samp(CAST(delivery_days AS DOUBLE))')} AS std_delivery, count(order_id) AS total_orders
FROM v_lines WHERE category IS NOT NULL GROUP BY category""")
def a13_delivery_by_category(spark, base):
    return profile.delivery_performance(_lines(spark, base))[1]


# ------------------------------------------------------------ customer behaviour

_ROLLUP = f"""ro AS (SELECT customer_id, {rnd(mean(AMT), 3)} AS avg_order_value,
       {rnd(mean('session_duration_minutes'), 3)} AS avg_session_duration,
       {rnd(mean('pages_viewed_before_purchase'), 3)} AS avg_pages_viewed,
       {rnd(mean('customer_rating'), 3)} AS avg_customer_rating, count(order_id) AS total_orders
FROM v_lines WHERE customer_id IS NOT NULL GROUP BY customer_id)"""


@register("a14_customer_behavior_rollup", f"WITH {_ROLLUP} SELECT * FROM ro")
def a14_customer_behavior_rollup(spark, base):
    return profile.customer_behavior_rollup(_lines(spark, base))


@register("a15_quartile_profile", f"""
WITH {_ROLLUP},
e AS (SELECT quantile_cont(avg_order_value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM ro),
b AS (SELECT ro.*, CASE WHEN avg_order_value >= q[1] AND avg_order_value <= q[2] THEN 'Q1_low'
                        WHEN avg_order_value > q[2] AND avg_order_value <= q[3] THEN 'Q2'
                        WHEN avg_order_value > q[3] AND avg_order_value <= q[4] THEN 'Q3'
                        WHEN avg_order_value > q[4] AND avg_order_value <= q[5] THEN 'Q4_high' END AS value_quartile
      FROM ro, e)
SELECT value_quartile, {rnd(mean('CAST(avg_session_duration AS DECIMAL(24,3))'), 3)} AS avg_session_duration,
       {rnd(mean('CAST(avg_pages_viewed AS DECIMAL(24,3))'), 3)} AS avg_pages_viewed,
       {rnd(mean('CAST(avg_customer_rating AS DECIMAL(24,3))'), 3)} AS avg_customer_rating
FROM b WHERE value_quartile IS NOT NULL GROUP BY value_quartile""")
def a15_quartile_profile(spark, base):
    return profile.quartile_profile(profile.customer_behavior_rollup(_lines(spark, base)))


_BEHAV = ["avg_session_duration", "avg_pages_viewed", "avg_customer_rating"]


def _pair_sql(src: str, pairs, with_t=True) -> str:
    parts = []
    for a, b in pairs:
        r = f"covar_samp({a}, {b}) / sqrt(var_samp({a}) * var_samp({b}))"
        t = f"({r}) * sqrt(CAST(count(*) - 2 AS DOUBLE) / (1 - ({r}) * ({r})))"
        extra = f", {rnd(t, 6)} AS t, count(*) - 2 AS dof" if with_t else ""
        parts.append(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, {rnd(r, 6)} AS r{extra} FROM {src}"
                     f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return "\nUNION ALL\n".join(parts)


@register("h2_behavior_value_grid_stats", f"WITH {_ROLLUP}\n" + _pair_sql("ro", [(c, "avg_order_value") for c in _BEHAV]))
def h2_behavior_value_grid_stats(spark, base):
    ro = profile.customer_behavior_rollup(_lines(spark, base))
    return stats.correlation_grid(ro, _BEHAV, ["avg_order_value"]).drop("p", "significant")


@register("h2_behavior_value_grid")
def h2_behavior_value_grid(spark, base):
    ro = profile.customer_behavior_rollup(_lines(spark, base))
    return stats.correlation_grid(ro, _BEHAV, ["avg_order_value"])


# ------------------------------------------------------------ segments

_NVR = f"""nvr AS (SELECT customer_type, count(order_id) AS order_count, {rnd(_sum(AMT))} AS total_revenue,
       {rnd(mean(AMT))} AS avg_order_value, {rnd(_median(AMT))} AS median_order,
       {rnd(mean('discount_pct'))} AS avg_discount, {rnd(mean('returned'))} AS return_rate
FROM (SELECT *, CASE WHEN is_repeat_customer = 0 THEN 'New' WHEN is_repeat_customer = 1 THEN 'Returning' END
              AS customer_type FROM v_lines)
WHERE customer_type IS NOT NULL GROUP BY customer_type)"""


@register("a16_new_vs_returning", f"""
WITH {_NVR}
SELECT customer_type, order_count, total_revenue, avg_order_value, median_order, avg_discount,
       {rnd('return_rate * 100', 1)} AS return_rate,
       {rnd('total_revenue / CAST(sum(CAST(total_revenue AS DECIMAL(24,2))) OVER () AS DOUBLE) * 100', 1)}
         AS revenue_share_pct
FROM nvr""")
def a16_new_vs_returning(spark, base):
    return profile.new_vs_returning(retail.lines(spark, base, with_repeat=True))


def _share_profile_sql(key: str, extra: str) -> str:
    return f"""WITH g AS (SELECT {key}, count(order_id) AS order_count, {rnd(mean(AMT))} AS avg_order_value,
       {extra}, {rnd(mean('returned'))} AS return_rate
FROM v_lines WHERE {key} IS NOT NULL GROUP BY {key})
SELECT * REPLACE ({rnd('return_rate * 100', 1)} AS return_rate),
       {rnd('order_count / CAST(sum(order_count) OVER () AS DOUBLE) * 100', 1)} AS order_share_pct
FROM g"""


@register("a17_payment_profile", _share_profile_sql("payment_method", f"{rnd(mean('discount_pct'))} AS avg_discount"))
def a17_payment_profile(spark, base):
    return profile.payment_profile(_lines(spark, base))


@register("a17_device_profile", _share_profile_sql(
    "device_used", f"{rnd(mean('session_duration_minutes'))} AS avg_session, "
                   f"{rnd(mean('pages_viewed_before_purchase'))} AS avg_pages"))
def a17_device_profile(spark, base):
    return profile.device_profile(_lines(spark, base))


def _long_sql(dims, keep: str, src: str = "v_lines") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, {keep} FROM {src} WHERE {d} IS NOT NULL"
        for d in dims)


@register("a18_return_rate_by", f"""
WITH l AS ({_long_sql(DIMS, 'returned')})
SELECT dimension, segment, {rnd(rnd(mean('returned'), 4) + ' * 100', 2)} AS return_rate,
       CAST({_sum('returned')} AS BIGINT) AS returns, count(returned) AS total_orders
FROM l GROUP BY dimension, segment""")
def a18_return_rate_by(spark, base):
    return profile.return_rate_by(_lines(spark, base), DIMS)


@register("a26_crosstab_returns", """
SELECT category, returned, count(*) AS n FROM v_lines
WHERE category IS NOT NULL AND returned IS NOT NULL GROUP BY category, returned""")
def a26_crosstab_returns(spark, base):
    return profile.crosstab(_lines(spark, base), "category", "returned")


# ------------------------------------------------------------ tests

def _pearson_by_sql(x: str, y: str, by: str | None, min_rows: int | None) -> str:
    r = f"covar_samp({x}, {y}) / sqrt(var_samp({x}) * var_samp({y}))"
    t = f"({r}) * sqrt(CAST(count(*) - 2 AS DOUBLE) / (1 - ({r}) * ({r})))"
    key = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    having = f" HAVING count(*) > {min_rows}" if min_rows is not None else ""
    return f"""SELECT {key}'{x}' AS x, '{y}' AS y, count(*) AS rows, count(*) AS n, {rnd(r, 6)} AS r,
       {rnd(t, 6)} AS t, count(*) - 2 AS dof
FROM (SELECT {key}CAST({x} AS DOUBLE) AS {x}, CAST({y} AS DOUBLE) AS {y} FROM v_lines){grp}{having}"""


@register("h1_pearson_discount_subtotal_stats", _pearson_by_sql("discount_pct", "subtotal_usd", None, None))
def h1_pearson_discount_subtotal_stats(spark, base):
    return stats.pearson_test(_lines(spark, base), "discount_pct", "subtotal_usd").drop("p", "significant")


@register("h1_pearson_discount_subtotal_by_category_stats",
          _pearson_by_sql("discount_pct", "subtotal_usd", "category", 30))
def h1_pearson_discount_subtotal_by_category_stats(spark, base):
    return stats.pearson_test(_lines(spark, base), "discount_pct", "subtotal_usd", by=["category"],
                              min_rows=30).drop("p", "significant")


@register("h1_pearson_discount_subtotal_by_category")
def h1_pearson_discount_subtotal_by_category(spark, base):
    return stats.pearson_test(_lines(spark, base), "discount_pct", "subtotal_usd", by=["category"], min_rows=30)


@register("h1_pearson_subtotal_shipping")
def h1_pearson_subtotal_shipping(spark, base):
    return stats.pearson_test(_lines(spark, base), "subtotal_usd", "shipping_fee_usd")


@register("h1_pearson_delivery_rating")
def h1_pearson_delivery_rating(spark, base):
    return stats.pearson_test(_lines(spark, base), "delivery_days", "customer_rating")


def _chi_sql(dims, outcome: str) -> str:
    return f"""WITH l AS ({_long_sql(dims, outcome)}),
obs AS (SELECT dimension, segment, {outcome}, count(*) AS o FROM l WHERE {outcome} IS NOT NULL
        GROUP BY dimension, segment, {outcome}),
rt AS (SELECT dimension, segment, sum(o) AS rt FROM obs GROUP BY dimension, segment),
ct AS (SELECT dimension, {outcome}, sum(o) AS ct FROM obs GROUP BY dimension, {outcome}),
tot AS (SELECT dimension, sum(o) AS n, count(DISTINCT segment) AS nr, count(DISTINCT {outcome}) AS nc
        FROM obs GROUP BY dimension),
g AS (SELECT r.dimension, t.n, CAST(coalesce(b.o, 0) AS DOUBLE) AS o, CAST(r.rt AS DOUBLE) * c.ct / t.n AS e,
             (t.nr - 1) * (t.nc - 1) AS dof
      FROM rt r JOIN ct c ON r.dimension = c.dimension
      LEFT JOIN obs b ON b.dimension = r.dimension AND b.segment = r.segment AND b.{outcome} = c.{outcome}
      JOIN tot t ON t.dimension = r.dimension),
a AS (SELECT *, CASE WHEN dof = 1 THEN o + least(0.5, abs(e - o)) * sign(e - o) ELSE o END AS adj FROM g)
SELECT dimension, CAST(n AS BIGINT) AS n, {rnd('sum((adj - e) * (adj - e) / e)', 6)} AS chi2, dof
FROM a GROUP BY dimension, n, dof"""


@register("h3_chi_square_returns_stats", _chi_sql(DIMS + ["line_status"], "returned"))
def h3_chi_square_returns_stats(spark, base):
    return stats.chi_square(_lines(spark, base), DIMS + ["line_status"], "returned").drop("p", "significant")


@register("h3_chi_square_returns")
def h3_chi_square_returns(spark, base):
    return stats.chi_square(_lines(spark, base), DIMS + ["line_status"], "returned")


_MW = f"""
WITH d AS (SELECT CAST({AMT} AS DOUBLE) AS v, CASE WHEN is_repeat_customer = 0 THEN 1 ELSE 0 END AS g1
           FROM v_lines WHERE {AMT} IS NOT NULL AND is_repeat_customer IN (0, 1)),
r AS (SELECT g1, CAST(rank() OVER (ORDER BY v) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY v) AS DOUBLE) - 1) / 2
             AS rk FROM d),
s AS (SELECT sum(g1 * rk) AS r1, CAST(sum(g1) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n FROM r),
tt AS (SELECT sum(t * t * t - t) AS tie FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM d GROUP BY v)),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, n - n1 AS n2 FROM s, tt)
SELECT 'New' AS group_1, 'Returning' AS group_2, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u1 AS u,
       {rnd('(greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1))))', 6)} AS z
FROM u"""


def _typed(spark, base):
    from basketlens.functions.core import recode
    return retail.lines(spark, base, with_repeat=True).withColumn(
        "customer_type", recode("is_repeat_customer", {0: "New", 1: "Returning"}))


@register("h4_mann_whitney_new_returning_stats", _MW)
def h4_mann_whitney_new_returning_stats(spark, base):
    return stats.mann_whitney(_typed(spark, base), AMT, "customer_type", "New", "Returning").drop("p", "significant")


@register("h4_mann_whitney_new_returning")
def h4_mann_whitney_new_returning(spark, base):
    return stats.mann_whitney(_typed(spark, base), AMT, "customer_type", "New", "Returning")


def _kw_sql(value: str, group: str, src: str = "v_lines") -> str:
    return f"""
WITH d AS (SELECT CAST({value} AS DOUBLE) AS v, {group} AS g FROM {src} WHERE {value} IS NOT NULL AND {group} IS NOT NULL),
r AS (SELECT g, CAST(rank() OVER (ORDER BY v) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY v) AS DOUBLE) - 1) / 2
             AS rk FROM d),
pg AS (SELECT g, sum(rk) AS rsum, CAST(count(*) AS DOUBLE) AS ng FROM r GROUP BY g),
tt AS (SELECT sum(t * t * t - t) AS tie, sum(t) AS n FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM d GROUP BY v)),
s AS (SELECT sum(rsum * rsum / ng) AS ssum, count(*) AS k FROM pg)
SELECT '{value}' AS value, '{group}' AS "group", CAST(n AS BIGINT) AS n, k,
       {rnd('(CAST(12.0 AS DOUBLE) / (n * (n + 1)) * ssum - 3 * (n + 1)) / (1 - tie / (n * n * n - n))', 6)} AS h,
       k - 1 AS dof
FROM s, tt"""


@register("h5_kruskal_payment_stats", _kw_sql(AMT, "payment_method"))
def h5_kruskal_payment_stats(spark, base):
    return stats.kruskal_wallis(_lines(spark, base), AMT, "payment_method").drop("p", "significant")


@register("h5_kruskal_payment")
def h5_kruskal_payment(spark, base):
    return stats.kruskal_wallis(_lines(spark, base), AMT, "payment_method")


@register("h5_kruskal_device_stats", _kw_sql(AMT, "device_used"))
def h5_kruskal_device_stats(spark, base):
    return stats.kruskal_wallis(_lines(spark, base), AMT, "device_used").drop("p", "significant")


@register("h5_kruskal_device")
def h5_kruskal_device(spark, base):
    return stats.kruskal_wallis(_lines(spark, base), AMT, "device_used")
