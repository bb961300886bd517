"""One customer / one category holding a third of all rows: results stay whole and exact."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlens.operators import anomaly, profile, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    cust = np.where(np.arange(n) < n // 3, 1, rng.integers(2, 200, n))
    cat = np.where(np.arange(n) < n // 3, "HOT", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({
        "order_id": np.arange(n), "customer_id": cust, "category": cat,
        "total_amount_usd": np.round(rng.uniform(1, 500, n), 2), "returned": rng.integers(0, 2, n),
        "discount_pct": rng.integers(0, 11, n).astype(float),
        "payment_method": rng.choice(["p1", "p2", "p3"], n), "device_used": rng.choice(["d1", "d2"], n),
        "order_date": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="D")})
    df = spark.createDataFrame(pdf).withColumn("order_date", F.to_date("order_date")).repartition(6)
    return pdf, df


def test_hot_customer_profile_is_whole(spark, skewed):
    pdf, df = skewed
    cust = spark.createDataFrame(pd.DataFrame({"customer_id": np.arange(1, 200), "membership_tier": "Gold",
                                               "country": "X", "churned": 0}))
    got = {r.customer_id: r for r in anomaly.customer_order_profile(df, cust).collect()}
    hot = pdf[pdf.customer_id == 1]
    assert got[1].total_orders == len(hot)
    assert got[1].total_returns == int(hot.returned.sum())
    assert got[1].payment_methods_used == hot.payment_method.nunique()
    assert got[1].avg_order_value == pytest.approx(round(hot.total_amount_usd.mean(), 2), abs=0.006)
    assert sum(r.total_orders for r in got.values()) == len(pdf)


def test_hot_category_profile_and_rank_test(spark, skewed):
    pdf, df = skewed
    res = {r.category: r for r in profile.segment_profile(
        df, ["category"], [("n", "count", "order_id"), ("median", "median", "total_amount_usd")],
        digits=None).collect()}
    for c, g in pdf.groupby("category"):
        assert res[c].n == len(g) and res[c].median == pytest.approx(g.total_amount_usd.median(), abs=1e-9)
    kw = stats.kruskal_wallis(df, "total_amount_usd", "category", buckets=4, digits=None).first()
    assert kw.n == len(pdf) and kw.dof == 3
