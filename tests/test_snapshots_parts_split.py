"""Versioned snapshots, part reconciliation, exports, the exact split and the exact rank test."""

import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.dist import exact_u_tail
from basketlens.operators import ml, stats
from basketlens.operators.quantile import kth_smallest
from basketlens.sources import tables
from basketlens.streaming import snapshots

ROW = "customer_id long, ltv double, projected_ltv double, churn_probability double, snapshot_date date, pipeline_version string"


def rows(spark, day, version, values):
    return spark.createDataFrame([(c, v, v * 2, 0.1) for c, v in values], "customer_id long, ltv double, projected_ltv double, churn_probability double").withColumns(
        {"snapshot_date": F.lit(day).cast("date"), "pipeline_version": F.lit(version)})


def test_versions_stay_and_unpublished_runs_are_invisible(spark, tmp_path):
    path = str(tmp_path)
    snapshots.append_snapshot(rows(spark, "2024-01-01", "1.0", [(1, 1.0), (2, 2.0)]), path)
    snapshots.append_snapshot(rows(spark, "2024-01-01", "1.10", [(1, 5.0)]), path)
    snapshots.write_run(rows(spark, "2024-02-01", "1.0", [(1, 9.0)]), path)
    snapshots.append_snapshot(rows(spark, "2024-01-01", "1.0", [(1, 1.5), (3, 3.0)]), path)
    got = {(r.pipeline_version, r.customer_id): r.ltv for r in snapshots.read_snapshots(spark, path).collect()}
    assert got == {("1.0", 1): 1.5, ("1.0", 3): 3.0, ("1.10", 1): 5.0}
    assert {r.pipeline_version for r in snapshots.manifest(spark, path).collect()} == {"1.0", "1.10"}
    assert snapshots.read_snapshots(spark, path, since="2030-01-01").count() == 0
    assert snapshots.read_snapshots(spark, path, version="1.10").count() == 1


def test_history_finds_predecessors_before_the_range(spark, tmp_path):
    path = str(tmp_path)
    snapshots.append_snapshot(rows(spark, "2024-01-01", "1.0", [(1, 1.0), (2, 2.0)]), path)
    snapshots.append_snapshot(rows(spark, "2024-02-01", "1.0", [(1, 4.0)]), path)
    snapshots.append_snapshot(rows(spark, "2024-03-01", "1.0", [(1, 5.0), (2, 6.0), (3, 7.0)]), path)
    snapshots.append_snapshot(rows(spark, "2024-04-01", "1.0", [(2, 8.0)]), path)
    got = {(r.customer_id, str(r.snapshot_date)): (str(r.previous_snapshot), r.ltv_change)
           for r in snapshots.read_snapshot_history(spark, path, since="2024-02-15").collect()}
    assert got == {(1, "2024-03-01"): ("2024-02-01", 1.0), (2, "2024-03-01"): ("2024-01-01", 4.0),
                   (3, "2024-03-01"): ("None", None), (2, "2024-04-01"): ("2024-03-01", 2.0)}


def test_parts_with_drifting_columns_and_types(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    spark.createDataFrame([(1, 2.5, "x")], "k int, v float, only_a string").write.parquet(a)
    spark.createDataFrame([(2 ** 40, 3)], "K long, v int").write.parquet(b)
    spark.createDataFrame([(3, Decimal("1.25"))], "k int, v decimal(10,2)").write.parquet(c)
    got = tables.load_parts(spark, [a, b, c])
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("k", "bigint"), ("v", "double"), ("only_a", "string")]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2.5, "x"), (3, 1.25, None), (2 ** 40, 3.0, None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_parts(spark, [a, str(tmp_path / "absent")])


@pytest.mark.parametrize("a, b, want", [("int", "bigint", "bigint"), ("float", "int", "double"), ("date", "timestamp", "timestamp"), ("decimal(10,2)", "bigint", "decimal(21,2)"),
                                        ("decimal(38,0)", "decimal(10,9)", "double"), ("string", "int", "string"), ("void", "int", "int"), ("array<int>", "int", "string")])
def test_wider(spark, a, b, want):
    x, y = T._parse_datatype_string(a), T._parse_datatype_string(b)
    assert tables.wider(x, y).simpleString() == want == tables.wider(y, x).simpleString()


def test_export_writes_every_output_by_one_job(spark, tmp_path):
    detail = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "customer_id long, tier string, ltv double")
    agg = spark.createDataFrame([("tier", "a", 1), ("country", "x", 2)], "dimension string, segment string, n long")
    base = tables.export_snapshot(detail, agg, str(tmp_path), "t0", ["customer_id", "ltv"])
    assert sorted(map(tuple, tables.read_export(spark, base, "detail", ["customer_id", "ltv"]).collect())) == [(1, 2.0), (2, 3.0)]
    assert [tuple(r) for r in tables.read_export(spark, base, "by_country", ["segment", "n"]).collect()] == [("x", 2)]


def test_split_is_exact_per_class_and_repeats(spark):
    data = [(i, None if i % 50 == 0 else int(i % 7 == 0)) for i in range(1003)]
    df = spark.createDataFrame(data, "k long, y int")
    s = ml.stratified_split(df, "y", "k", 0.2).toPandas()
    assert len(s) == 1003 and s.is_test.sum() == 201  # ceil(0.2 * 1003)
    again = ml.stratified_split(df.repartition(7), "y", "k", 0.2).toPandas()
    assert set(s[s.is_test].k) == set(again[again.is_test].k)
    shares = s.groupby("y", dropna=False).is_test.agg(["sum", "count"])
    assert all(abs(t - 201 * n / 1003) < 1 for t, n in zip(shares["sum"], shares["count"]))


def test_split_breaks_hash_ties_by_key(spark, monkeypatch):
    monkeypatch.setattr(ml, "split_hash_sql", lambda key, seed: f"({key}) % 3")
    s = ml.stratified_split(spark.range(0, 30).selectExpr("id AS k", "1 AS y"), "y", "k", 0.5).where("is_test").toPandas()
    assert sorted(s.k) == sorted([k for k in range(30) if k % 3 == 0] + [1, 4, 7, 10, 13])


def test_kth_smallest_with_repeats_and_negative_codes(spark):
    vals = [-5, -5, 2 ** 50, 3, 3, 3, -2 ** 40, 0]
    df = spark.createDataFrame([("g", v, 4) for v in vals] + [("h", 7, 0), ("i", 7, 5)], "g string, c long, r long")
    assert {(r.g, r.c, r.before) for r in kth_smallest(df, "g", "c", "r").collect()} == {("g", 3, 4), ("h", 7, 0)}


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 9), (2, 5), (3, 3), (4, 6), (5, 3)])
def test_exact_u_equals_enumeration(n1, n2):
    us = [sum(r - i for i, r in enumerate(c)) for c in itertools.combinations(range(n1 + n2), n1)]
    for u in range((n1 * n2 + 1) // 2, n1 * n2 + 1):
        assert exact_u_tail(n1, n2, u) == pytest.approx(sum(x >= u for x in us) / len(us), rel=1e-12)


def test_exact_u_in_doubles_agrees_with_integers():
    assert exact_u_tail(8, 9000, 40_000) == pytest.approx(exact_u_tail(9000, 8, 40_000), rel=1e-9)
    assert 0 < exact_u_tail(8, 100_000, 700_000) < 1e-3


def test_small_untied_samples_use_the_exact_test(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1.1, 2.2, 3.3)] + [("b", float(v)) for v in (4.4, 5.5, 6.6, 7.7)], "g string, v double")
    r = stats.mann_whitney(df, "v", "g", "a", "b").first()
    assert r.p == pytest.approx(2 / 35) and r.u == 0
    tied = stats.mann_whitney(df.union(df.where("v < 2")), "v", "g", "a", "b").first()
    assert tied.p != pytest.approx(2 / 70)
