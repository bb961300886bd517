"""Lifetime-value queries."""

from __future__ import annotations

from basketlens.operators import ltv
from basketlens.plans.oracle import mean, rnd
from basketlens.plans.registry import register
from basketlens.sources import retail
from basketlens.sources.retail import AS_OF

YEARS = 3

_AGE = """CASE WHEN age > 17 AND age <= 24 THEN '18-24' WHEN age > 24 AND age <= 31 THEN '25-31'
  WHEN age > 31 AND age <= 38 THEN '32-38' WHEN age > 38 AND age <= 45 THEN '39-45'
  WHEN age > 45 AND age <= 52 THEN '46-52' WHEN age > 52 AND age <= 59 THEN '53-59'
  WHEN age > 59 AND age <= 100 THEN '60+' END"""

_LTV = f"""
ls0 AS (SELECT *, CASE WHEN churned = 1
                       THEN date_diff('day', registration_date, DATE '{AS_OF}' - CAST(days_since_last_purchase AS INTEGER))
                       ELSE date_diff('day', registration_date, DATE '{AS_OF}') END AS lifespan_days
        FROM v_customers),
ls AS (SELECT *, CASE WHEN lifespan_days IS NOT NULL
                      THEN {rnd('CAST(greatest(lifespan_days, 1) AS DOUBLE) / 365', 4)} END AS lifespan_years FROM ls0),
rq AS (SELECT quantile_cont(CAST(days_since_last_purchase AS DOUBLE), [0.5, 0.75, 0.9]) AS q
       FROM v_customers WHERE churned = 0),
cp AS (SELECT ls.*, CASE WHEN churned = 1 THEN CAST(1.0 AS DOUBLE)
                         WHEN days_since_last_purchase <= q[1] THEN CAST(0.05 AS DOUBLE)
                         WHEN days_since_last_purchase <= q[2] THEN CAST(0.25 AS DOUBLE)
                         WHEN days_since_last_purchase <= q[3] THEN CAST(0.60 AS DOUBLE)
                         ELSE CAST(0.90 AS DOUBLE) END AS churn_probability FROM ls, rq),
pl0 AS (SELECT *, {rnd('CAST(total_spend_usd AS DOUBLE)')} AS ltv, 1 - churn_probability AS survival_probability,
               {rnd('CAST(total_spend_usd AS DOUBLE) / nullif(lifespan_years, 0)')} AS annual_spend_rate FROM cp),
ltvd AS (SELECT *, {rnd(f'CASE WHEN churned = 0 THEN CAST(total_spend_usd AS DOUBLE) + annual_spend_rate * {YEARS} * survival_probability ELSE CAST(total_spend_usd AS DOUBLE) END')}
                AS projected_ltv, {_AGE} AS age_group FROM pl0)"""


def _detail(spark, base):
    return ltv.ltv_pipeline(retail.customers(spark, base), AS_OF, YEARS)


@register("d5_customer_lifespan", f"""
WITH {_LTV}
SELECT customer_id, lifespan_days, lifespan_years FROM ls""")
def d5_customer_lifespan(spark, base):
    c = retail.customers(spark, base).select(*ltv.LTV_COLUMNS)
    return ltv.customer_lifespan(c, AS_OF).select("customer_id", "lifespan_days", "lifespan_years")


@register("d6_churn_probability", f"""
WITH {_LTV}
SELECT customer_id, churn_probability, q[1] AS recency_p50, q[2] AS recency_p75, q[3] AS recency_p90 FROM cp, rq""")
def d6_churn_probability(spark, base):
    c = retail.customers(spark, base).select(*ltv.LTV_COLUMNS)
    return ltv.churn_probability(c).select("customer_id", "churn_probability", "recency_p50", "recency_p75",
                                           "recency_p90")


_DETAIL_COLS = ["customer_id", "country", "age_group", "gender", "membership_tier", "lifespan_years", "ltv",
                "annual_spend_rate", "churn_probability", "survival_probability", "projected_ltv"]


@register("d8_ltv_pipeline", f"""
WITH {_LTV}
SELECT {', '.join(_DETAIL_COLS)} FROM ltvd""")
def d8_ltv_pipeline(spark, base):
    return _detail(spark, base).select(*_DETAIL_COLS)


@register("d7_projected_ltv", f"""
WITH {_LTV}
SELECT customer_id, ltv, annual_spend_rate, survival_probability, projected_ltv FROM ltvd""")
def d7_projected_ltv(spark, base):
    return _detail(spark, base).select("customer_id", "ltv", "annual_spend_rate", "survival_probability",
                                       "projected_ltv")


def _dim(d: str) -> str:
    return (f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, customer_id, ltv, projected_ltv, "
            f"annual_spend_rate, churn_probability FROM ltvd WHERE {d} IS NOT NULL")


@register("a8_ltv_aggregate", f"""
WITH {_LTV},
l AS ({' UNION ALL '.join(_dim(d) for d in ('membership_tier', 'country', 'age_group'))})
SELECT dimension, segment, count(customer_id) AS customer_count,
       {rnd(mean('CAST(ltv AS DECIMAL(24,4))'))} AS avg_ltv, {rnd('quantile_cont(ltv, 0.5)')} AS median_ltv,
       {rnd(mean('CAST(projected_ltv AS DECIMAL(24,4))'))} AS avg_projected_ltv,
       {rnd(mean('CAST(annual_spend_rate AS DECIMAL(24,4))'))} AS avg_annual_rate,
       {rnd(mean('CAST(churn_probability AS DECIMAL(24,4))'))} AS avg_churn_prob,
       CASE WHEN dimension = 'membership_tier' THEN
            CASE segment WHEN 'Free' THEN 0 WHEN 'Silver' THEN 1 WHEN 'Gold' THEN 2 WHEN 'Platinum' THEN 3 END
       END AS segment_ord
FROM l GROUP BY dimension, segment""")
def a8_ltv_aggregate(spark, base):
    return ltv.ltv_aggregate(_detail(spark, base))
