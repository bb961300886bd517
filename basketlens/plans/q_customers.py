"""Customer queries (A1-A7, D4, P1, P8, P9) over the customer view."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlens.operators import profile
from basketlens.plans.oracle import mean, rnd
from basketlens.plans.registry import register
from basketlens.sources import retail

COHORT_FLOOR = 1997  # driver orders span 1995-2001; the reference pools years < 2020

_AGE = """CASE WHEN age > 17 AND age <= 24 THEN '18-24' WHEN age > 24 AND age <= 31 THEN '25-31'
  WHEN age > 31 AND age <= 38 THEN '32-38' WHEN age > 38 AND age <= 45 THEN '39-45'
  WHEN age > 45 AND age <= 52 THEN '46-52' WHEN age > 52 AND age <= 59 THEN '53-59'
  WHEN age > 59 AND age <= 100 THEN '60+' END"""


def _sum(expr: str) -> str:
    return f"coalesce(CAST(sum({expr}) AS DOUBLE), 0)"


@register("a1_profile_overview", f"""
SELECT count(*) AS total_customers, count(DISTINCT country) AS countries,
       {rnd(mean('age'), 1)} AS avg_age, {rnd(mean('total_orders'), 1)} AS avg_orders,
       {rnd(mean('total_spend_usd'))} AS avg_spend, {rnd(mean('avg_order_value_usd'))} AS avg_order_value,
       {rnd(mean('days_since_last_purchase'), 1)} AS avg_recency_days,
       {rnd(_sum('churned') + ' * 100 / CAST(count(*) AS DOUBLE)', 1)} AS churn_rate_pct
FROM v_customers""")
def a1_profile_overview(spark, base):
    return profile.profile_overview(retail.customers(spark, base))


@register("a2_churn_by_cohort", f"""
WITH c AS (SELECT *, CASE WHEN year(registration_date) < {COHORT_FLOOR} THEN 'pre_{COHORT_FLOOR}'
                          ELSE CAST(year(registration_date) AS VARCHAR) END AS cohort FROM v_customers),
g AS (SELECT cohort, count(customer_id) AS total_customers, {rnd(_sum('churned'))} AS churned,
             {rnd(mean('total_spend_usd'))} AS avg_spend, {rnd(mean('days_since_last_purchase'))} AS avg_recency_days
      FROM c WHERE cohort IS NOT NULL GROUP BY cohort)
SELECT *, {rnd('churned * 100 / CAST(total_customers AS DOUBLE)', 1)} AS churn_rate_pct FROM g""")
def a2_churn_by_cohort(spark, base):
    return profile.churn_by_cohort(retail.customers(spark, base), floor_year=COHORT_FLOOR)


_TIERS = f"""
t AS (SELECT membership_tier, count(customer_id) AS customer_count,
             {rnd(mean('total_spend_usd'))} AS avg_spend, {rnd(mean('avg_order_value_usd'))} AS avg_order_value,
             {rnd(mean('days_since_last_purchase'))} AS avg_recency_days, {rnd(_sum('churned'))} AS churned
      FROM v_customers WHERE membership_tier IS NOT NULL GROUP BY membership_tier),
u AS (SELECT *, {rnd('customer_count / CAST(sum(customer_count) OVER () AS DOUBLE) * 100', 1)} AS pct_of_total,
             {rnd('churned / CAST(customer_count AS DOUBLE) * 100', 1)} AS churn_rate_pct FROM t),
tiers AS (SELECT d.membership_tier, d.membership_tier_ord, u.customer_count, u.avg_spend, u.avg_order_value,
                 u.avg_recency_days, u.churned, u.pct_of_total, u.churn_rate_pct,
                 {rnd('u.avg_spend / nullif(u.churn_rate_pct, 0)', 0)} AS value_retention_ratio
          FROM (VALUES ('Free', 0), ('Silver', 1), ('Gold', 2), ('Platinum', 3)) d(membership_tier, membership_tier_ord)
          LEFT JOIN u ON d.membership_tier = u.membership_tier)"""


@register("a3_membership_tier_profile", f"WITH {_TIERS} SELECT * FROM tiers")
def a3_membership_tier_profile(spark, base):
    return profile.membership_tier_profile(retail.customers(spark, base))


@register("d4_churn_reduction_scenarios", f"""
WITH {_TIERS}
SELECT s.scenario, s.target_churn,
       {rnd('t.customer_count * (t.churn_rate_pct - s.target_churn) / 100 * t.avg_spend')} AS recoverable_revenue,
       s.scenario_ord
FROM tiers t, (VALUES ('Conservative', 9.0::DOUBLE, 0), ('Moderate', 8.0::DOUBLE, 1),
                      ('Aggressive', 7.1::DOUBLE, 2), ('Best case', 6.0::DOUBLE, 3)) s(scenario, target_churn, scenario_ord)
WHERE t.membership_tier = 'Gold'""")
def d4_churn_reduction_scenarios(spark, base):
    return profile.churn_reduction_scenarios(profile.membership_tier_profile(retail.customers(spark, base)), "Gold")


_CONV = f"""
conv AS (SELECT country, age_group, gender, count(customer_id) AS customer_count,
                {rnd(mean('total_spend_usd'))} AS avg_spend, {rnd(mean('avg_order_value_usd'))} AS avg_order_value,
                {rnd(_sum('total_spend_usd'))} AS total_spend
         FROM (SELECT *, {_AGE} AS age_group FROM v_customers)
         WHERE country IS NOT NULL AND age_group IS NOT NULL AND gender IS NOT NULL
         GROUP BY country, age_group, gender)"""


@register("a4_audience_conversion", f"WITH {_CONV} SELECT * FROM conv")
def a4_audience_conversion(spark, base):
    return profile.audience_conversion(retail.customers(spark, base))


@register("a5_country_summary", f"""
WITH {_CONV}
SELECT country, sum(customer_count) AS total_customers,
       {rnd(_sum('CAST(total_spend AS DECIMAL(24,2))'))} AS total_revenue,
       {rnd(mean('CAST(avg_spend AS DECIMAL(24,2))'))} AS avg_spend,
       {rnd(mean('CAST(avg_order_value AS DECIMAL(24,2))'))} AS avg_order_value
FROM conv GROUP BY country""")
def a5_country_summary(spark, base):
    return profile.country_summary(profile.audience_conversion(retail.customers(spark, base)))


def _sat(dim: str) -> str:
    return f"""SELECT '{dim}' AS dimension, CAST({dim} AS VARCHAR) AS segment,
       {rnd(mean('reviews_given'), 3)} AS reviews_given, {rnd(mean('avg_review_score'), 3)} AS avg_review_score,
       {rnd(mean('returns_made'), 3)} AS returns_made
FROM v_customers WHERE {dim} IS NOT NULL GROUP BY {dim}"""


@register("a6_satisfaction_by", "\nUNION ALL\n".join(
    _sat(d) for d in ("membership_tier", "preferred_category", "acquisition_channel")))
def a6_satisfaction_by(spark, base):
    return profile.satisfaction_by(retail.customers(spark, base),
                                   ["membership_tier", "preferred_category", "acquisition_channel"])


@register("a7_acquisition_channel_profile", f"""
SELECT acquisition_channel, count(customer_id) AS customer_count,
       {rnd(mean('total_spend_usd'))} AS avg_spend, {rnd(mean('avg_order_value_usd'))} AS avg_order_value,
       {rnd(mean('total_orders'))} AS avg_orders, {rnd(mean('days_since_last_purchase'))} AS avg_recency,
       {rnd(rnd(mean('churned')) + ' * 100', 1)} AS churn_rate
FROM v_customers WHERE acquisition_channel IS NOT NULL GROUP BY acquisition_channel""")
def a7_acquisition_channel_profile(spark, base):
    return profile.acquisition_channel_profile(retail.customers(spark, base))


@register("p1_age_group_bins", f"""
SELECT customer_id, age, {_AGE} AS age_group FROM v_customers""")
def p1_age_group_bins(spark, base):
    return profile.add_age_group(retail.customers(spark, base)).select("customer_id", "age", "age_group")


@register("s4_customer_projection", """
SELECT customer_id, country, age, gender, membership_tier, registration_date, total_orders,
       CAST(total_spend_usd AS DOUBLE) AS total_spend_usd, avg_order_value_usd, days_since_last_purchase, churned
FROM v_customers""")
def s4_customer_projection(spark, base):
    from basketlens.sources.tables import load_projected
    c = retail.customers(spark, base).withColumn("total_spend_usd", F.col("total_spend_usd").cast("double"))
    return load_projected(c, ["customer_id", "country", "age", "gender", "membership_tier", "registration_date",
                              "total_orders", "total_spend_usd", "avg_order_value_usd",
                              "days_since_last_purchase", "churned"])
