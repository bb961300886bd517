"""Retail views over the TPC-H-style tables.

The operators are generic over column names; these views give them a retail
schema (transactions, products, customers) derived from the driver
tables, so every query reads the real tables and grows with them. The same
definitions exist as SQL text in ``basketlens.plans.oracle`` for the DuckDB
cross-check; both must stay expression-for-expression identical.

Money is exact ``decimal`` so sums do not depend on partitioning. Per-entity
rollups are ``groupBy`` + equi-join (partial aggregation, AQE skew-join),
never windows partitioned by a possibly hot key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import closing

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.core import limbs_sum, micro_limbs
from basketlens.session import saved, saved_in_parts, scratch
from basketlens.sources.tables import load_table

AS_OF = "2001-08-02"  # day after the last order date of the driver data

# Membership tiers by account balance, in order.
TIER_ORDER = ["Free", "Silver", "Gold", "Platinum"]
TIER_UPPER_BOUNDS = [2500.0, 5000.0, 7500.0]
GENDERS = ["Female", "Male", "Other"]


def _t(spark: SparkSession, base: str, name: str) -> DataFrame:
    return load_table(spark, name, base)


# Money is exact decimal. Line prices are bounded by quantity x retail price
# (TPC-H: under 1e6), so decimal(8,2) x (4,2) x (4,2) = decimal(18,6) stays in
# Spark's long-backed decimal path; sums widen to (28,6) and only fall back
# to BigDecimal if they outgrow 18 digits.
LINE_MONEY = "decimal(8,2)"
ORDER_MONEY = "decimal(12,2)"
RATE = "decimal(3,2)"


def _line_amount_micro() -> Column:
    """Amount of a line as exact integer millionths: sums stay on long arithmetic."""
    return (F.rint(F.col("l_extendedprice") * 100).cast("long")
            * (100 - F.rint(F.col("l_discount") * 100).cast("long"))
            * (100 + F.rint(F.col("l_tax") * 100).cast("long")))


def _delivery_days(order_date: str | Column) -> Column:
    return F.abs(F.datediff(F.to_date("l_shipdate"), order_date)) % 30


def order_heads(spark: SparkSession, base: str, with_repeat: bool = False) -> DataFrame:
    """What lines take from their order; ``with_repeat`` as in ``lines``."""
    heads = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]
    o = _t(spark, base, "orders").select(*heads)
    if not with_repeat:
        return o
    odate = F.to_date("o_orderdate")
    first = (_t(spark, base, "orders").groupBy(F.col("o_custkey").alias("f_custkey"))
             .agg(F.min(odate).alias("first_order_date")))
    repeat = F.when(odate > F.col("first_order_date"), 1).otherwise(0).alias("is_repeat_customer")
    return o.join(first, F.col("o_custkey") == F.col("f_custkey")).select(*heads, repeat)


def lines(spark: SparkSession, base: str, with_repeat: bool = False, heads: DataFrame | None = None,
          part: tuple[int, int] | None = None) -> DataFrame:
    """Transaction grain (one product purchase per line), like a retail orders table.

    lineitem x orders x part. ``with_repeat`` adds ``is_repeat_customer``
    (order date after the customer's first order): a ``groupBy`` of orders
    joined to orders before the fan-out to lines, paid only by queries that
    use the flag. ``heads`` are the ``order_heads``, if they are stored; ``part``
    (i, n) gives the lines of the i-th of n slices of the order keys.
    """
    li = _t(spark, base, "lineitem")
    o = order_heads(spark, base, with_repeat) if heads is None else heads
    if part is not None:
        li, o = (df.where(F.pmod(F.xxhash64(k), F.lit(part[1])) == part[0]) for df, k in ((li, "l_orderkey"), (o, "o_orderkey")))
    p = _t(spark, base, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    odate = F.to_date("o_orderdate")
    extra = ["is_repeat_customer"] if with_repeat else []
    sub = F.col("l_extendedprice").cast(LINE_MONEY)
    disc = F.col("l_discount").cast(RATE)
    tax = F.col("l_tax").cast(RATE)
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey)
              .select(F.col("l_orderkey").alias("order_id"),
                      F.col("l_linenumber").alias("line_number"),
                      F.col("o_custkey").alias("customer_id"),
                      F.col("l_partkey").alias("product_id"),
                      F.col("p_name").alias("product_name"),
                      F.col("p_type").alias("category"),
                      odate.alias("order_date"),
                      F.year(odate).alias("year"),
                      F.month(odate).alias("month"),
                      F.quarter(odate).alias("quarter"),
                      F.date_format(odate, "EEEE").alias("day_of_week"),
                      F.col("o_orderpriority").alias("payment_method"),
                      F.col("o_orderstatus").alias("device_used"),
                      F.col("l_quantity").cast("int").alias("quantity"),
                      F.col("p_retailprice").cast(LINE_MONEY).alias("unit_price_usd"),
                      sub.alias("subtotal_usd"),
                      (disc * 100).alias("discount_pct"),
                      (sub * tax).alias("shipping_fee_usd"),
                      (sub * (1 - disc) * (1 + tax)).alias("total_amount_usd"),
                      _line_amount_micro().alias("total_amount_usd_micro"),
                      F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"),
                      F.col("l_linestatus").alias("line_status"),
                      _delivery_days(odate).alias("delivery_days"),
                      (1 + F.col("p_size") % 5).alias("customer_rating"),
                      (F.col("l_quantity") / 2).alias("session_duration_minutes"),
                      (F.col("l_linenumber") + F.col("p_size") % 7).alias("pages_viewed_before_purchase"),
                      *extra))


#: A slice of the stored lines holds about so many bytes of lineitem; a table has at most so many slices.
SLICE_BYTES = 256 << 20
SLICES = 16


def stored_lines(spark: SparkSession, base: str, drop: Sequence[str] = (), scope: int = -1) -> DataFrame:
    """``lines`` with the repeat flag, ``saved`` without the ``drop`` columns, a slice of the order keys at a time.

    Both joins of the lines move every line, some five times lineitem's bytes; in
    slices the disk holds a part of that (in a ``scratch`` block).
    """
    size = int(str(_t(spark, base, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(SLICES, -(-size // SLICE_BYTES))
    if n <= 1:
        return saved(lines(spark, base, with_repeat=True).drop(*drop), "lines", scope)

    def slices() -> Iterator[DataFrame]:
        with scratch(spark):
            heads = saved(order_heads(spark, base, with_repeat=True), "order_heads")
            for i in range(n):
                yield lines(spark, base, with_repeat=True, heads=heads, part=(i, n)).drop(*drop)

    with closing(slices()) as parts:
        return saved_in_parts(parts, "lines", scope)


def products(spark: SparkSession, base: str) -> DataFrame:
    """Product summary: one row per part with sales rollups of its ``lines``.

    Lines meet orders with the columns that are summed, and are summed per part
    key before they meet part: what a part row adds to each of its lines is
    weighted by their number, so part's texts never travel with lines.
    """
    o = _t(spark, base, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    li = _t(spark, base, "lineitem").where("l_partkey IS NOT NULL").select(
        "l_orderkey", "l_partkey", _line_amount_micro().alias("micro"),
        (F.col("l_discount").cast(RATE) * 100).alias("discount_pct"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"), F.to_date("l_shipdate").alias("l_shipdate"))
    high, low = micro_limbs("micro")
    per_key = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(high).alias("high"), F.sum(low).alias("low"),
        F.sum("returned").alias("returned"), F.sum(_delivery_days("order_date")).alias("delivery_days"),
        F.sum("discount_pct").alias("discount_pct"))
    p = _t(spark, base, "part").select("p_partkey", F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
                                       (1 + F.col("p_size") % 5).alias("rating"),
                                       F.col("p_retailprice").cast(LINE_MONEY).alias("price"))
    n = F.sum("n")
    return (per_key.join(p, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_partkey").alias("product_id"), "product_name", "category").agg(
                n.alias("total_orders"),
                limbs_sum("high", "low").alias("total_revenue_usd"),
                (F.sum(F.col("rating") * F.col("n")).cast("double") / n).alias("avg_rating"),
                (F.sum("returned").cast("double") * 100 / n).alias("return_rate"),
                (F.sum("delivery_days").cast("double") / n).alias("avg_delivery_days"),
                (F.sum("discount_pct").cast("double") / n).alias("avg_discount_pct"),
                (F.sum(F.col("price") * F.col("n")).cast("double") / n).alias("avg_price")))


def customer_attributes(spark: SparkSession, base: str) -> DataFrame:
    """Static customer attributes only (customer x nation): no order or event rollups.

    Operators that need tier / country / churn flag join this instead of the
    full profile; Spark cannot drop unused outer joins, so the distinction
    saves whole aggregation pipelines.
    """
    c = _t(spark, base, "customer")
    nat = _t(spark, base, "nation").select("n_nationkey", "n_name")
    bal = F.col("c_acctbal")
    tier = (F.when(bal < TIER_UPPER_BOUNDS[0], TIER_ORDER[0])
             .when(bal < TIER_UPPER_BOUNDS[1], TIER_ORDER[1])
             .when(bal < TIER_UPPER_BOUNDS[2], TIER_ORDER[2])
             .otherwise(TIER_ORDER[3]))
    k = F.col("c_custkey")
    gender = F.when(k % 3 == 0, GENDERS[0]).when(k % 3 == 1, GENDERS[1]).otherwise(GENDERS[2])
    return (c.join(nat, c.c_nationkey == nat.n_nationkey)
             .select(k.alias("customer_id"), F.col("n_name").alias("country"),
                     (15 + k % 90).cast("int").alias("age"), gender.alias("gender"),
                     tier.alias("membership_tier"), F.when(bal < 0, 1).otherwise(0).alias("churned"),
                     F.col("c_mktsegment").alias("acquisition_channel")))


def customers(spark: SparkSession, base: str, as_of: str = AS_OF, stored: DataFrame | None = None) -> DataFrame:
    """Customer profile: attributes, order rollups, engagement, preference.

    ``stored`` are the ``lines``, if they are stored (lines without a customer do not count).

    Line-level work is ONE ``groupBy(customer, category)`` pass; both the
    per-customer rollup and the preferred category derive from that small
    result (Spark reuses its exchange). Order rollups read the orders table
    directly. Every rollup is keyed by customer and left-joined once.
    """
    attrs = customer_attributes(spark, base)
    o = _t(spark, base, "orders")
    li = lines(spark, base) if stored is None else stored
    ev = _t(spark, base, "events")

    odate = F.to_date("o_orderdate")
    per_cust = o.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.min(odate).alias("registration_date"),
        F.max(odate).alias("last_order_date"),
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.col("o_totalprice").cast(ORDER_MONEY)).alias("total_spend_usd"))
    cat_n = li.groupBy("customer_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("customer_rating").alias("rating_sum"),
        F.sum("returned").alias("returned_sum"))
    per_line = cat_n.groupBy("customer_id").agg(
        (F.sum("rating_sum").cast("double") / F.sum("n")).alias("avg_review_score"),
        F.sum("returned_sum").alias("returns_made"))
    engagement = ev.groupBy(F.col("user_id").alias("customer_id")).agg(
        F.count(F.when(F.col("event_type") == "click", 1)).alias("reviews_given"),
        F.count(F.when(F.col("event_type") == "view", 1)).alias("wishlist_items"),
        F.max(F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("newsletter_subscribed"))
    # Mode of category per customer (ties by name). As an aggregate on the join
    # key this branch, and lineitem with it, is dropped where it is not used.
    pref = cat_n.where(F.col("category").isNotNull()).groupBy("customer_id").agg(
        F.min(F.struct((-F.col("n")).alias("less"), "category"))["category"].alias("preferred_category"))
    out = (attrs.join(per_cust, "customer_id", "left").join(engagement, "customer_id", "left")
                .join(per_line, "customer_id", "left").join(pref, "customer_id", "left"))
    return out.select(
        "customer_id", "country", "age", "gender", "membership_tier", "registration_date",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        "total_spend_usd",
        (F.col("total_spend_usd").cast("double") / F.col("total_orders")).alias("avg_order_value_usd"),
        F.datediff(F.lit(as_of).cast("date"), F.col("last_order_date")).alias("days_since_last_purchase"),
        "churned",
        F.coalesce("reviews_given", F.lit(0)).alias("reviews_given"),
        "avg_review_score",
        F.coalesce("returns_made", F.lit(0)).alias("returns_made"),
        F.coalesce("wishlist_items", F.lit(0)).alias("wishlist_items"),
        F.coalesce("newsletter_subscribed", F.lit(0)).alias("newsletter_subscribed"),
        "preferred_category", "acquisition_channel")
