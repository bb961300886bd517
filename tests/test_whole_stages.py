"""Stage pipelines run every stage and compute every column; high confidence is all three methods."""

import pytest
from pyspark.sql import functions as F

from basketlens.plans import q_anomaly, q_misc, reports

SF = "/root/testdata/sf0.001"


def test_outputs_are_computed_whole(spark):
    bad = spark.range(3).withColumn("x", F.raise_error(F.lit("computed")).cast("string"))
    with pytest.raises(Exception, match="computed"):
        reports.run_pipeline(spark, {"s": lambda: {"o": bad}})
    rows = reports.run_pipeline(spark, {"s": lambda: {"o": spark.range(3)}}).collect()
    assert [(r.stage, r.output, r.rows) for r in rows] == [("s", "o", 3)]


def test_high_confidence_is_three_methods(spark, monkeypatch):
    cols = ["return_rate", "avg_order_value", "order_velocity", "avg_discount_pct", "churned"]
    rows = [(m, *[float(10 * m)] * 4, 1) for m in (0, 2, 2, 3)]
    df = spark.createDataFrame(rows, ["methods_flagged", *cols])
    monkeypatch.setattr(q_anomaly, "_full", lambda *a: (df, df))
    assert {(r.high_confidence, r.high_n) for r in q_anomaly.a30_high_confidence_profile(spark, SF).collect()} == {(30.0, 1), (1.0, 1)}
    box = [r.asDict() for r in q_anomaly.v4_box_summary_flagged_vs_clean(spark, SF).collect()]
    assert box and all(20.0 not in r.values() for r in box)


def test_whole_pipeline_runs_every_stage(spark):
    got = {(r.stage, r.output): r.rows for r in q_misc.g6_run_pipeline(spark, SF).collect()}
    assert list(dict.fromkeys(s for s, _ in got)) == ["validate", "products", "customers", "customers_extended", "ltv", "orders",
                                                       "anomaly", "exports"]
    assert got["exports", "orders"] == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert all(got["exports", f"ltv_by_{d}"] for d in ("membership_tier", "country", "age_group"))


def test_stage_digests_equal_those_of_the_single_queries(spark):
    from basketlens.plans.catalog import QUERIES
    got = {r.output: (r.rows, r.digest) for r in q_misc.g5_order_analysis(spark, SF).collect()}
    for output, query in (("payment", "a17_payment_profile"), ("month", "a10_temporal_month"), ("new_vs_returning", "a16_new_vs_returning")):
        df = QUERIES[query](spark, SF)
        assert got[output] == tuple(df.agg(F.count(F.lit(1)), reports.digest(df)).first()), output


def test_digest_is_order_free_and_sees_every_change(spark):
    rows = [(1, 0.1 + 0.2, None, [1.0]), (2, -0.0, "x", None), (2, -0.0, "x", None)]
    schema = "a long, b double, c string, d array<double>"
    def of(r):
        df = spark.createDataFrame(r, schema)
        return df.agg(reports.digest(df)).first()[0]
    assert of(rows) == of(rows[::-1]) == of([(1, 0.3, None, [1.0]), *rows[1:]])
    others = [of(rows[:2]), of([(1, 0.3, "", [1.0]), *rows[1:]]), of([(1, 0.31, None, [1.0]), *rows[1:]]), of([(1, 0.3, None, [None]), *rows[1:]]), of([])]
    assert of(rows) not in others and len(set(others)) == len(others)


def test_product_stage_computes_replicates_and_ranks_once(spark):
    from basketlens.sources import retail
    out = reports.product_analysis(retail.products(spark, SF), "PROMO", reps=50)
    for name in ("ci", "uplift", "ranked", "rank_gap_histogram"):
        plan = out[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "percentile(" not in plan and "_bl_bucket" not in plan and "_bl_salt" not in plan, name


def test_stages_of_the_whole_pipeline_share_the_views(spark, monkeypatch):
    made = []
    def view(name):
        return lambda *a, **k: (made.append(name), spark.range(3).toDF("customer_id"))[1]
    for name in ("customers", "products", "lines"):
        monkeypatch.setattr(q_misc.retail, name, view(name))
    for name in ("product_analysis", "customer_analysis", "customer_analysis_extended", "ltv_analysis", "order_analysis"):
        monkeypatch.setattr(reports, name, lambda df, *a, **k: df.collect())
    monkeypatch.setattr(q_misc, "_exports", lambda *frames: [f.collect() for f in frames])
    stages = q_misc._stage(spark, SF, None)
    for name in ("products", "customers", "customers_extended", "ltv", "orders", "exports"):
        stages[name]()
    assert sorted(made) == ["customers", "lines", "products"]


def test_order_stage_writes_only_what_its_reports_read(spark):
    from basketlens.sources import retail
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(reports, "_shared", lambda df: seen.append(df.columns) or df.limit(0))
        m.setattr(reports.stats, "mann_whitney", lambda *a, **k: None)
        m.setattr(reports.stats, "kruskal_wallis", lambda *a, **k: None)
        reports.order_analysis(retail.lines(spark, SF, with_repeat=True))
    assert "total_amount_usd" in seen[0] and "product_name" not in seen[0]
