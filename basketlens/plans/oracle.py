"""Independent SQL (DuckDB dialect) for the correctness cross-check.

``VIEWS`` restates ``basketlens.sources.retail`` as SQL over the raw driver
tables; ``with_views`` prefixes a query with the CTEs it references. The
rounding helper ``rnd`` reproduces ``functions.pround`` (scale, round half to
even, unscale), which is numpy's rounding.
"""

from __future__ import annotations

import re

from basketlens.sources.retail import AS_OF

VIEWS: dict[str, str] = {}

VIEWS["v_lines"] = """
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_number,
       o.o_custkey AS customer_id, l.l_partkey AS product_id,
       p.p_name AS product_name, p.p_type AS category,
       CAST(o.o_orderdate AS DATE) AS order_date,
       year(CAST(o.o_orderdate AS DATE)) AS year,
       month(CAST(o.o_orderdate AS DATE)) AS month,
       quarter(CAST(o.o_orderdate AS DATE)) AS quarter,
       dayname(CAST(o.o_orderdate AS DATE)) AS day_of_week,
       o.o_orderpriority AS payment_method, o.o_orderstatus AS device_used,
       CAST(l.l_quantity AS INTEGER) AS quantity,
       CAST(p.p_retailprice AS DECIMAL(8,2)) AS unit_price_usd,
       CAST(l.l_extendedprice AS DECIMAL(8,2)) AS subtotal_usd,
       CAST(l.l_discount AS DECIMAL(3,2)) * 100 AS discount_pct,
       CAST(l.l_extendedprice AS DECIMAL(8,2)) * CAST(l.l_tax AS DECIMAL(3,2)) AS shipping_fee_usd,
       CAST(l.l_extendedprice AS DECIMAL(8,2)) * (1 - CAST(l.l_discount AS DECIMAL(3,2)))
           * (1 + CAST(l.l_tax AS DECIMAL(3,2))) AS total_amount_usd,
       CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS returned,
       l.l_linestatus AS line_status,
       abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))) % 30 AS delivery_days,
       1 + p.p_size % 5 AS customer_rating,
       l.l_quantity / 2 AS session_duration_minutes,
       l.l_linenumber + p.p_size % 7 AS pages_viewed_before_purchase,
       CASE WHEN CAST(o.o_orderdate AS DATE) > f.first_order_date THEN 1 ELSE 0 END AS is_repeat_customer
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_order_date
      FROM orders GROUP BY o_custkey) f ON o.o_custkey = f.o_custkey
"""

VIEWS["v_products"] = """
SELECT product_id, product_name, category,
       count(*) AS total_orders,
       sum(total_amount_usd) AS total_revenue_usd,
       CAST(sum(customer_rating) AS DOUBLE) / count(*) AS avg_rating,
       CAST(sum(returned) AS DOUBLE) * 100 / count(*) AS return_rate,
       CAST(sum(delivery_days) AS DOUBLE) / count(*) AS avg_delivery_days,
       CAST(sum(discount_pct) AS DOUBLE) / count(*) AS avg_discount_pct,
       CAST(sum(unit_price_usd) AS DOUBLE) / count(*) AS avg_price
FROM v_lines GROUP BY product_id, product_name, category
"""

VIEWS["v_customers"] = f"""
SELECT c.c_custkey AS customer_id, n.n_name AS country,
       CAST(15 + c.c_custkey % 90 AS INTEGER) AS age,
       CASE WHEN c.c_custkey % 3 = 0 THEN 'Female' WHEN c.c_custkey % 3 = 1 THEN 'Male' ELSE 'Other' END AS gender,
       CASE WHEN c.c_acctbal < 2500.0 THEN 'Free' WHEN c.c_acctbal < 5000.0 THEN 'Silver'
            WHEN c.c_acctbal < 7500.0 THEN 'Gold' ELSE 'Platinum' END AS membership_tier,
       pc.registration_date,
       coalesce(pc.total_orders, 0) AS total_orders,
       pc.total_spend_usd,
       CAST(pc.total_spend_usd AS DOUBLE) / pc.total_orders AS avg_order_value_usd,
       date_diff('day', pc.last_order_date, DATE '{AS_OF}') AS days_since_last_purchase,
       CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS churned,
       coalesce(e.reviews_given, 0) AS reviews_given,
       r.avg_review_score,
       coalesce(rm.returns_made, 0) AS returns_made,
       coalesce(e.wishlist_items, 0) AS wishlist_items,
       coalesce(e.newsletter_subscribed, 0) AS newsletter_subscribed,
       pf.preferred_category,
       c.c_mktsegment AS acquisition_channel
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey AS customer_id, min(CAST(o_orderdate AS DATE)) AS registration_date,
                  max(CAST(o_orderdate AS DATE)) AS last_order_date, count(*) AS total_orders,
                  sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total_spend_usd
           FROM orders GROUP BY o_custkey) pc ON c.c_custkey = pc.customer_id
LEFT JOIN (SELECT customer_id, sum(returned) AS returns_made FROM v_lines GROUP BY customer_id) rm
       ON c.c_custkey = rm.customer_id
LEFT JOIN (SELECT user_id,
                  count(CASE WHEN event_type = 'click' THEN 1 END) AS reviews_given,
                  count(CASE WHEN event_type = 'view' THEN 1 END) AS wishlist_items,
                  max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS newsletter_subscribed
           FROM events GROUP BY user_id) e ON c.c_custkey = e.user_id
LEFT JOIN (SELECT customer_id, CAST(sum(customer_rating) AS DOUBLE) / count(customer_rating) AS avg_review_score
           FROM v_lines GROUP BY customer_id) r ON c.c_custkey = r.customer_id
LEFT JOIN (SELECT customer_id, category AS preferred_category FROM (
               SELECT customer_id, category,
                      row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, category) AS rk
               FROM (SELECT customer_id, category, count(*) AS n FROM v_lines GROUP BY customer_id, category))
           WHERE rk = 1) pf ON c.c_custkey = pf.customer_id
"""

_ORDER = ["v_lines", "v_products", "v_customers"]


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of every view it (transitively) uses."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in _ORDER if n in needed)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def rnd(expr: str, digits: int = 2) -> str:
    """SQL twin of ``functions.pround``."""
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale})"


def mean(expr: str) -> str:
    """SQL twin of ``functions.mean`` (sum / count of non-null values)."""
    return f"(CAST(sum({expr}) AS DOUBLE) / count({expr}))"
