"""Disk of the stages: shuffles go with their query, frames with their block, lines are joined in slices, medians move few rows."""

import os
import time

import pytest
from pyspark.sql import functions as F

from basketlens import session
from basketlens.operators.quantile import quantile_frame
from basketlens.plans import q_misc, reports
from basketlens.session import is_saved, saved, scratch
from basketlens.sources import retail

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def own_folder(monkeypatch, tmp_path_factory):
    """A folder that no other session writes to."""
    path = str(tmp_path_factory.mktemp("kept"))
    for module in (session, reports):
        monkeypatch.setattr(module, "ensure_checkpoint_dir", lambda spark: path)


def _kept(spark):
    return set(os.listdir(session.ensure_checkpoint_dir(spark)))


def _shuffles(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}


def test_frames_of_a_block_last_as_long_as_it(spark):
    start = _kept(spark)
    with scratch(spark):
        run = saved(spark.range(3), "run")
        with scratch(spark):
            inner, outer, last = saved(spark.range(4), "inner"), saved(spark.range(5), "outer", scope=-2), saved(spark.range(6), "last", scope=0)
            assert is_saved(inner) and not is_saved(inner.drop("x")) and inner.count() == 4
        assert {n.split("-")[0] for n in _kept(spark) - start} == {"run", "outer", "last"}
        assert (run.count(), outer.count(), last.count()) == (3, 5, 6)
    assert _kept(spark) == start
    stays = saved(spark.range(2), "stays", scope=-2)
    assert stays.count() == 2 and len(_kept(spark) - start) == 1


def test_frames_go_when_a_stage_fails(spark):
    start = _kept(spark)
    def stage():
        saved(spark.range(3), "stage")
        raise ValueError("stage")
    with pytest.raises(ValueError, match="stage"):
        reports.run_pipeline(spark, {"s": stage})
    assert _kept(spark) - {"basketlens-out"} == start - {"basketlens-out"}


def test_shuffle_files_go_with_their_query(spark):
    start = _shuffles(spark)
    reports.run_pipeline(spark, {"s": lambda: {"o": spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()}})
    for _ in range(50):
        if not (left := _shuffles(spark) - start):
            break
        time.sleep(0.2)
    assert not left


def test_order_stage_leaves_only_its_outputs(spark):
    start = _kept(spark) | {"basketlens-out"}
    q_misc.g5_order_analysis(spark, SF)
    assert _kept(spark) == start


@pytest.fixture
def odd(spark, tmp_path):
    """Tables with NULL order, customer and part keys, and an order whose lines and heads come twice."""
    t = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("orders", "lineitem", "part", "customer", "nation", "events")}
    t["orders"] = t["orders"].withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END")).withColumn("o_orderkey", F.expr("CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey END"))
    t["orders"] = t["orders"].union(t["orders"].where("o_orderkey < 20"))
    t["lineitem"] = t["lineitem"].withColumn("l_orderkey", F.expr("CASE WHEN l_partkey % 11 > 0 THEN l_orderkey END")).withColumn("l_partkey", F.expr("CASE WHEN l_linenumber < 4 THEN l_partkey END"))
    t["lineitem"] = t["lineitem"].union(t["lineitem"].where("l_orderkey < 20"))
    for n, df in t.items():
        df.write.parquet(f"{tmp_path}/{n}.parquet")
    return str(tmp_path)


def _same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_lines_in_slices_are_all_lines(spark, odd, monkeypatch):
    monkeypatch.setattr(retail, "SLICE_BYTES", 1)
    start = _kept(spark)
    whole = retail.lines(spark, odd, with_repeat=True).drop("product_name")
    stored = retail.stored_lines(spark, odd, ["product_name"])
    assert is_saved(stored) and whole.count() > 0 and _same(whole, stored)
    assert {n.split("-")[0] for n in _kept(spark) - start} == {"lines"}
    with scratch(spark):
        retail.stored_lines(spark, odd, scope=0)
        assert len(_kept(spark) - start) == 2
    assert len(_kept(spark) - start) == 1


def test_customers_of_stored_lines(spark, odd):
    with scratch(spark):
        stored = retail.stored_lines(spark, odd)
        assert _same(retail.customers(spark, odd), retail.customers(spark, odd, stored=stored))


def _moved(plan):
    """Rows that the shuffles of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _moved(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _moved(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_moved(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_move_few_of_the_values(spark, by):
    df = spark.range(0, 200_000, 1, 2).select((F.col("id") % 2).alias("g"), (F.rand(5) * 1e5).alias("v"))
    q = quantile_frame(df, "v", [0.5, 0.9], by)
    got = {tuple(r)[:-1]: r._q for r in q.collect()}
    exact = {tuple(r)[:-1]: r.p for r in df.groupBy(*by).agg(F.percentile("v", [0.5, 0.9]).alias("p")).collect()}
    assert set(got) == set(exact) and all(got[k] == pytest.approx(exact[k], rel=1e-12) for k in got)
    assert _moved(q._jdf.queryExecution().executedPlan()) < 100_000


def test_quantiles_of_more_groups_than_marks(spark, monkeypatch):
    from basketlens.operators import quantile
    monkeypatch.setattr(quantile, "MARKS", 64)
    df = spark.range(3000).select((F.col("id") % 500).alias("g"), ((F.col("id") * 37) % 1009 / 7.0).alias("v"))
    got = {r.g: r._q for r in quantile_frame(df, "v", [0.25, 0.5], ["g"]).collect()}
    exact = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5]).alias("p")).collect()}
    assert all(got[g] == pytest.approx(exact[g], rel=1e-12) for g in exact) and len(got) == 500
