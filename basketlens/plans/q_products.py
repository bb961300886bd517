"""Product queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlens.operators import ordered, products
from basketlens.plans.oracle import rnd
from basketlens.plans.registry import register
from basketlens.sources import retail

_CUM = """CAST(sum(total_revenue_usd) OVER (ORDER BY total_revenue_usd DESC, product_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
        / CAST(sum(total_revenue_usd) OVER () AS DOUBLE) * 100"""

_ABC = f"""
abc AS (SELECT *, {_CUM} AS cum_pct FROM v_products),
cls AS (SELECT *, CASE WHEN cum_pct <= 80.0 THEN 'A' WHEN cum_pct <= 95.0 THEN 'B' ELSE 'C' END AS abc_class FROM abc)"""

_VIAB = rnd("""(CAST(avg_rating AS DOUBLE) / CAST(5.0 AS DOUBLE)) * CAST(0.3 AS DOUBLE)
   + (1 - CAST(return_rate AS DOUBLE) / CAST(100.0 AS DOUBLE)) * CAST(0.3 AS DOUBLE)
   + (CAST(total_revenue_usd AS DOUBLE) / max(CAST(total_revenue_usd AS DOUBLE)) OVER ()) * CAST(0.25 AS DOUBLE)
   + (1 - CAST(avg_delivery_days AS DOUBLE) / max(CAST(avg_delivery_days AS DOUBLE)) OVER ()) * CAST(0.15 AS DOUBLE)""", 3)


def _abc(spark, base):
    p = retail.products(spark, base)
    return (ordered.abc_classification(p, "total_revenue_usd", "product_id")
            .select("product_id", "category", F.col("total_revenue_usd").cast("double").alias("total_revenue_usd"),
                    F.col("cum_pct"), "abc_class"))


@register("w4_abc_classification", f"""
WITH {_ABC}
SELECT product_id, category, CAST(total_revenue_usd AS DOUBLE) AS total_revenue_usd, cum_pct, abc_class FROM cls""")
def w4_abc_classification(spark, base):
    return _abc(spark, base)


@register("w5_abc_classification_bucketed", f"""
WITH {_ABC}
SELECT product_id, category, CAST(total_revenue_usd AS DOUBLE) AS total_revenue_usd, cum_pct, abc_class FROM cls""")
def w5_abc_classification_bucketed(spark, base):
    """The global order of W4 under its own name: splitters, offsets, windows inside buckets."""
    return _abc(spark, base)


@register("w1_avg_rank_revenue", """
SELECT product_id, CAST(total_revenue_usd AS DOUBLE) AS total_revenue_usd,
       CAST(rank() OVER (ORDER BY total_revenue_usd DESC) AS DOUBLE)
         + (CAST(count(*) OVER (PARTITION BY total_revenue_usd) AS DOUBLE) - 1) / 2 AS revenue_rank
FROM v_products""")
def w1_avg_rank_revenue(spark, base):
    p = retail.products(spark, base)
    r = ordered.average_rank(p, "total_revenue_usd", "revenue_rank")
    return r.select("product_id", F.col("total_revenue_usd").cast("double").alias("total_revenue_usd"),
                    "revenue_rank")


@register("w2_rank_gap", """
WITH r AS (
  SELECT product_id, total_orders, total_revenue_usd,
         CAST(rank() OVER (ORDER BY total_orders DESC) AS DOUBLE)
           + (CAST(count(*) OVER (PARTITION BY total_orders) AS DOUBLE) - 1) / 2 AS orders_rank,
         CAST(rank() OVER (ORDER BY total_revenue_usd DESC) AS DOUBLE)
           + (CAST(count(*) OVER (PARTITION BY total_revenue_usd) AS DOUBLE) - 1) / 2 AS revenue_rank
  FROM v_products),
g AS (SELECT *, abs(orders_rank - revenue_rank) AS rank_gap FROM r)
SELECT product_id, CAST(total_orders AS BIGINT) AS total_orders, orders_rank, revenue_rank, rank_gap,
       coalesce(rank_gap > avg(rank_gap) OVER () + stddev_samp(rank_gap) OVER (), false) AS flagged
FROM g""")
def w2_rank_gap(spark, base):
    p = retail.products(spark, base)
    return (ordered.rank_gap(p, "total_orders", "total_revenue_usd")
            .select("product_id", "total_orders", "orders_rank", "revenue_rank", "rank_gap", "flagged"))


@register("d1_viability_score", f"""
SELECT product_id, {_VIAB} AS viability_score FROM v_products""")
def d1_viability_score(spark, base):
    return products.viability_score(retail.products(spark, base)).select("product_id", "viability_score")


@register("d2_abc_viability_matrix", f"""
WITH {_ABC},
v AS (SELECT *, {_VIAB} AS viability_score FROM cls)
SELECT product_id, category, product_name, CAST(total_revenue_usd AS DOUBLE) AS total_revenue_usd,
       CAST(total_orders AS BIGINT) AS total_orders, avg_rating, return_rate, viability_score, abc_class,
       CASE WHEN abc_class = 'A' AND viability_score >= 0.7 THEN 'Protect'
            WHEN abc_class = 'A' AND viability_score < 0.7 THEN 'Investigate'
            WHEN abc_class = 'B' AND viability_score >= 0.6 THEN 'Grow'
            WHEN abc_class = 'B' AND viability_score < 0.6 THEN 'Monitor'
            WHEN abc_class = 'C' AND viability_score >= 0.6 THEN 'Nurture'
            ELSE 'Review for removal' END AS recommendation
FROM v""")
def d2_abc_viability_matrix(spark, base):
    return products.abc_viability_matrix(retail.products(spark, base))


@register("d3_discount_removal_scenario", f"""
WITH s AS (
  SELECT category, CAST(total_orders AS DOUBLE) AS o,
         CASE WHEN category = 'PROMO' THEN round_even(CAST(total_orders AS DOUBLE) * CAST(1.15 AS DOUBLE), 0)
              ELSE CAST(total_orders AS DOUBLE) END AS so,
         total_revenue_usd AS r,
         CASE WHEN category = 'PROMO' THEN CAST(total_revenue_usd AS DOUBLE) * CAST(1.15 AS DOUBLE)
              ELSE CAST(total_revenue_usd AS DOUBLE) END AS sr
  FROM v_products),
a AS (SELECT category, {rnd('sum(o)', 0)} AS actual_orders, {rnd('sum(so)', 0)} AS simulated_orders,
             {rnd('sum(r)', 0)} AS actual_revenue, {rnd('sum(sr)', 0)} AS simulated_revenue
      FROM s GROUP BY category)
SELECT *, simulated_revenue - actual_revenue AS revenue_delta FROM a
WHERE simulated_revenue - actual_revenue <> 0""")
def d3_discount_removal_scenario(spark, base):
    return products.discount_removal_scenario(retail.products(spark, base), "PROMO", 1.15)
