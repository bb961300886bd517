from basketlens.operators import quality


def test_orphans_ignore_null_child_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,)], "k int")
    assert quality.orphans(child, parent, "k").first().orphaned == 2


def test_duplicates_treat_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a"), (None, "a")], "a int, b string")
    assert quality.duplicate_count(df).first().duplicates == 2


def test_empty_strings_and_numeric_text(spark):
    df = spark.createDataFrame([("", "1"), ("x", "2.5"), ("y", " 3 "), ("", "z"), ("w", "1e2")], "s string, t string")
    e = {r.column: r for r in quality.empty_string_check(df, "t").collect()}
    assert set(e) == {"s"} and e["s"].empty_strings == 2 and e["s"].pct == 40.0
    n = {r.column: r for r in quality.numeric_text_check(df, "t").collect()}
    assert set(n) == {"t"} and n["t"].numeric_pct == 80.0 or n == {}


def test_validate_all_shape(spark):
    a = spark.createDataFrame([(1, "x"), (2, "")], "k int, s string")
    b = spark.createDataFrame([(1,)], "k int")
    out = quality.validate_all({"a": a, "b": b}, [("a", "k", "b", "k")])
    assert out.columns == ["check", "table", "column", "value", "status"]
    orphan = [r for r in out.collect() if r.check.startswith("orphans")][0]
    assert orphan.value == 1.0 and orphan.status == "FAIL"


def test_digests_tell_nulls_columns_and_nested_values_apart(spark):
    rows = [(None, "a", [1.0, None]), ("a", None, [1.0, None]), (None, "a", [None, 1.0]), (None, "a", [1.0]), (None, "a", None), (None, "a", []),
            ("", "a", [1.0]), ("aa", "", []), ("a", "a", []), ("a", "a", [])]
    df = spark.createDataFrame(rows, "a string, b string, v array<float>")
    assert quality.duplicate_count(df).first().duplicates == 1
    row = quality.profile_row(df).first()
    assert (row._n, row._c0, row._c1, row._c2, row._e0, row._e1, row.duplicates) == (10, 5, 9, 9, 1, 1, 1)


def test_floats_that_compare_equal_are_duplicates(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert quality.duplicate_count(df).first().duplicates == 2 == df.count() - df.distinct().count()


def test_checks_of_empty_and_wide_tables(spark):
    assert quality.duplicate_count(spark.createDataFrame([], "a int")).first().duplicates == 0
    assert {r.value for r in quality.validate_all({"e": spark.createDataFrame([], "a int, s string")}).collect()} == {0.0}
    wide = spark.range(0, 7).selectExpr(*[f"CAST(CASE WHEN id % {i + 2} = 0 THEN NULL ELSE id % 3 END AS STRING) AS c{i}" for i in range(70)])
    row = quality.profile_row(wide).first().asDict()
    pdf = wide.toPandas()
    assert all(row[f"_c{i}"] == pdf[f"c{i}"].notna().sum() == row[f"_k{i}"] for i in range(70))


def test_texts_are_not_shuffled(spark):
    df = spark.range(0, 10).selectExpr("id", "repeat('word ', 100) AS text")
    plan = quality.profile_row(df)._jdf.queryExecution().executedPlan().toString()
    partial = plan[plan.index("Exchange"):].split("\n")[1]
    assert "text" not in partial.split("output=")[1]
