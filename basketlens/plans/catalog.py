"""All registered queries: importing the query modules registers them."""

from __future__ import annotations

from basketlens.plans import q_products, q_customers, q_orders, q_ltv, q_anomaly, q_misc  # noqa: F401
from basketlens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
