from pyspark.sql import functions as F

from basketlens.operators import profile


def test_null_keys_dropped_and_empty_sums(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("a", None), ("b", 2.0)], "k string, x double")
    res = {r.k: r for r in profile.segment_profile(df, ["k"], [("n", "count", "x"), ("s", "sum", "x"),
                                                               ("m", "mean", "x")]).collect()}
    assert set(res) == {"a", "b"}
    assert res["a"].n == 0 and res["a"].s == 0.0 and res["a"].m is None
    assert res["b"].s == 2.0 and res["b"].m == 2.0


def test_reindex_domain_all_and_present(spark):
    df = spark.createDataFrame([("Gold", 3), ("Other", 1)], "membership_tier string, n int")
    full = profile.reindex_domain(df, "membership_tier", profile.TIER_ORDER).orderBy("membership_tier_ord").collect()
    assert [r.membership_tier for r in full] == profile.TIER_ORDER
    assert [r.n for r in full] == [None, None, 3, None]
    pres = profile.reindex_domain(df, "membership_tier", profile.TIER_ORDER, mode="present").collect()
    assert [r.membership_tier for r in pres] == ["Gold"]


def test_quantile_bins_ties_at_edge(spark):
    vals = [1.0, 2.0, 2.0, 2.0, 2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.q for r in profile.add_quantile_bin(df, "x", 4, ["a", "b", "c", "d"], "q").orderBy("x").collect()]
    # edges: 1, 2, 2, 3.25, 5 -> ties at 2 stay in the lowest bin, the (2, 2] bin is empty
    assert got == ["a", "a", "a", "a", "a", "c", "d", "d"]


def test_cohort_and_recode(spark):
    df = spark.createDataFrame([("2019-03-01",), ("2021-01-05",), (None,)], "d string")
    got = [r.cohort for r in profile.add_cohort(df, "d").collect()]
    assert got == ["pre_2020", "2021", None]


def test_long_by_dimension_single_pass(spark):
    df = spark.createDataFrame([("x", "p", 1), ("y", None, 0)], "a string, b string, r int")
    rows = sorted((r.dimension, r.segment, r.r) for r in profile.long_by_dimension(df, ["a", "b"], ["r"]).collect())
    assert rows == [("a", "x", 1), ("a", "y", 0), ("b", "p", 1)]
