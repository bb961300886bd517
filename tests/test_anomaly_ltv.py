import datetime as dt

from pyspark.sql import functions as F

from basketlens.operators import anomaly, forest, ltv


def _profile(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, total_orders long, total_returns long, "
                                       "avg_order_value double, avg_returned_value double, payment_methods_used long, "
                                       "first_order_date date, last_order_date date")


def test_history_bins_and_gates(spark):
    d0 = dt.date(2020, 1, 1)
    rows = [(i, n, 0, 10.0, None, 1, d0, d0 + dt.timedelta(days=60)) for i, n in enumerate([1, 2, 3, 5, 6, 15, 16])]
    rows.append((100, 4, 1, 10.0, 20.0, 2, d0, d0))          # one return: velocity gated to 0
    rows.append((101, 4, 2, 10.0, 20.0, 2, d0, d0))          # two returns same day: age clipped to 1 day
    f = {r.customer_id: r for r in anomaly.anomaly_features(_profile(spark, rows)).collect()}
    assert [f[i].history_depth for i in range(7)] == ["thin (<3)", "thin (<3)", "low (3-5)", "low (3-5)",
                                                     "medium (6-15)", "medium (6-15)", "deep (16+)"]
    assert f[0].return_rate is None and f[1].return_rate is None and f[2].return_rate == 0.0
    assert f[100].refund_velocity == 0.0 and f[100].account_age_days == 1
    assert f[101].refund_velocity == 2 / (1 / 30)


def test_isolation_forest_flag_share_and_determinism(spark):
    df = spark.range(0, 2000).select(
        F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("a"),
        F.when(F.col("id") % 97 == 0, 50.0).otherwise((F.col("id") % 5).cast("double")).alias("b"))
    r1 = forest.isolation_forest(df.repartition(3), ["a", "b"], "k", contamination=0.05, trees=50)
    r2 = forest.isolation_forest(df.repartition(5), ["a", "b"], "k", contamination=0.05, trees=50)
    a = dict(r1.select("k", "iso_anomaly_score").collect())
    b = dict(r2.select("k", "iso_anomaly_score").collect())
    assert a == b
    share = r1.agg(F.avg(F.col("iso_flagged").cast("double"))).first()[0]
    assert 0.03 <= share <= 0.06
    outliers = r1.filter(F.col("k") % 97 == 0).agg(F.avg(F.col("iso_flagged").cast("double"))).first()[0]
    assert outliers > 0.9


def test_ltv_branches(spark):
    rows = [(1, dt.date(2000, 1, 1), 10, 1, 100.0),     # churned: last purchase = as_of - 10
            (2, dt.date(2000, 1, 1), None, 0, 100.0),   # active, missing recency -> 0.90 (N20)
            (3, dt.date(2001, 8, 1), 5, None, 50.0)]    # churned unknown -> projection = spend (N21)
    df = spark.createDataFrame(rows, "customer_id long, registration_date date, days_since_last_purchase int, "
                                     "churned int, total_spend_usd double")
    out = {r.customer_id: r for r in ltv.projected_ltv(ltv.churn_probability(ltv.customer_lifespan(df, "2001-08-02")))
           .collect()}
    assert out[1].lifespan_days == (dt.date(2001, 8, 2) - dt.timedelta(days=10) - dt.date(2000, 1, 1)).days
    assert out[1].churn_probability == 1.0 and out[1].projected_ltv == 100.0
    assert out[2].churn_probability == 0.90
    assert out[3].lifespan_years == round(1 / 365, 4) and out[3].projected_ltv == 50.0
