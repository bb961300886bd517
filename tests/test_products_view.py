"""The product summary equals a rollup of the lines, and plans read the lines once."""
import datetime as dt

from pyspark.sql import functions as F

from basketlens.functions.core import micro_sum
from basketlens.operators import ordered, products
from basketlens.sources import retail


def _tables(spark, base):
    day = dt.datetime(2000, 1, 1)
    li = [(i % 7 if i % 11 else None, i % 5 if i % 13 else None, 1, i % 4, float(i % 9) * 101.25 if i % 6 else None, float(i % 17) * 1000.37 if i % 8 else None,
           (i % 10) / 100, None if i % 19 == 0 else (i % 8) / 100, "R" if i % 3 == 0 else None, "O", day + dt.timedelta(days=i % 50) if i % 7 else None) for i in range(400)]
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                              "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{base}/lineitem.parquet")
    # An order and a part twice, keys that are missing or NULL, a part key with two names.
    orders = [(1, 1), (1, 2), (2, 1), (3, None), (None, 1), (4, 5), (5, 5)]
    spark.createDataFrame([(k, c, "F", 1.0, day if i else None, "1-URGENT") for i, (k, c) in enumerate(orders)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{base}/orders.parquet")
    part = [(0, "a", "x", 3, 10.5), (1, "b", "x", 4, 2.25), (1, "b", "x", 8, 7.0), (2, "c", "y", None, None), (2, "d", None, 9, 1.0), (3, None, "y", 1, 4.0), (None, "e", "x", 2, 1.0)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double") \
        .withColumn("p_brand", F.lit("b")).write.parquet(f"{base}/part.parquet")


def _of_lines(spark, base):
    n = F.count(F.lit(1))
    return retail.lines(spark, base).groupBy("product_id", "product_name", "category").agg(
        n.alias("total_orders"), micro_sum("total_amount_usd_micro").alias("total_revenue_usd"),
        (F.sum("customer_rating").cast("double") / n).alias("avg_rating"),
        (F.sum("returned").cast("double") * 100 / n).alias("return_rate"),
        (F.sum("delivery_days").cast("double") / n).alias("avg_delivery_days"),
        (F.sum("discount_pct").cast("double") / n).alias("avg_discount_pct"),
        (F.sum("unit_price_usd").cast("double") / n).alias("avg_price"))


def test_products_equal_the_rollup_of_lines(spark, tmp_path):
    base = str(tmp_path)
    _tables(spark, base)
    got, want = retail.products(spark, base), _of_lines(spark, base)
    assert got.dtypes == want.dtypes
    rows = sorted(want.collect(), key=str)
    assert len(rows) == 5 and sorted(got.collect(), key=str) == rows


def test_part_texts_do_not_travel_with_lines(spark, tmp_path):
    base = str(tmp_path)
    _tables(spark, base)
    plan = retail.products(spark, base)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    names = next(i for i, x in enumerate(plan) if "p_name" in x and "Relation" in x)
    sums = [i for i, x in enumerate(plan) if x.lstrip(" :+-").startswith("Aggregate [l_partkey")]
    assert sums and sums[0] < next(i for i, x in enumerate(plan) if "l_extendedprice" in x and "Relation" in x)
    assert not any("p_name" in x for x in plan[sums[0]:names] if "l_" in x)


def test_score_and_rank_read_the_lines_once(spark, tmp_path):
    base = str(tmp_path)
    _tables(spark, base)
    p = retail.products(spark, base)
    for out in (products.viability_score(p), ordered.average_rank(p, "total_revenue_usd", "r"), ordered.rank_gap(p, "total_orders", "total_revenue_usd")):
        assert "l_extendedprice" not in out._jdf.queryExecution().optimizedPlan().toString()  # written before, not computed again
