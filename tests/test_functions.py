import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.functions.core import bin_expr, first_match, numeric_text, pround, recode, safe_div
from basketlens.functions.dist import chi2_upper, norm_ppf, norm_two_sided, t_two_sided


def test_pround_matches_numpy(spark):
    vals = [1.005, 2.675, 0.125, 0.135, -1.005, 2.5, 3.5, 1234.5678, 0.0, -0.0, 1e-9, 123456789.125]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (0, 1, 2, 3):
        got = [r[0] for r in df.select(pround("x", d)).collect()]
        assert got == [float(np.round(v, d)) for v in vals], d


def test_safe_div_null_on_zero(spark):
    r = spark.range(1).select(safe_div(F.lit(1), F.lit(0)).alias("a"), safe_div(F.lit(3), F.lit(2)).alias("b")).first()
    assert r.a is None and r.b == 1.5


def test_age_bins_right_closed(spark):
    ages = [17, 18, 24, 25, 59, 60, 100, 101, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    edges = [17, 24, 31, 38, 45, 52, 59, 100]
    labels = ["18-24", "25-31", "32-38", "39-45", "46-52", "53-59", "60+"]
    got = [r[0] for r in df.select(bin_expr("age", edges, labels)).collect()]
    assert got == [None, "18-24", "18-24", "25-31", "53-59", "60+", "60+", None, None]


def test_numeric_text_coercion(spark):
    vals = ["", " 12 ", "1e3", "NaN", "1d", "abc", None, "-.5", "+3."]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(numeric_text("s")).collect()]
    assert got == [None, 12.0, 1000.0, None, None, None, None, -0.5, 3.0]


def test_first_match_and_recode(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "k int")
    got = [r[0] for r in df.select(recode("k", {0: "New", 1: "Returning"})).collect()]
    assert got == ["New", "Returning", None, None]
    lab = [r[0] for r in df.select(first_match([F.col("k") >= 1, F.col("k") >= 0], ["hi", "lo"], "none")).collect()]
    assert lab == ["lo", "hi", "hi", "none"]


def test_pvalues_textbook():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0734, abs=1e-4)
    assert chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi2_upper(10.0, 4) == pytest.approx(0.040428, abs=1e-6)
    assert norm_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert math.isnan(t_two_sided(float("nan"), 3))


def test_pvalues_closed_forms_and_large_dof():
    t = np.array([1e-6, 0.3, 1.0, 4.0, 25.0])
    assert t_two_sided(t, 1.0) == pytest.approx(1 - 2 / math.pi * np.arctan(t), rel=1e-11)
    assert t_two_sided(t, 2.0) == pytest.approx(1 - t / np.sqrt(2 + t * t), rel=1e-11)
    normal = np.array([math.erfc(v / math.sqrt(2)) for v in t])
    assert norm_two_sided(t) == pytest.approx(normal, rel=1e-11)
    for dof in (1e10, 1e12, 1e13, 1e15):  # within 1 / dof of the normal tail
        assert t_two_sided(t[:4], dof) == pytest.approx(normal[:4], rel=1e-8)
    assert t_two_sided(1.0, 99.9) == pytest.approx(float(t_two_sided(1.0, 100.1)), rel=1e-4)
    assert chi2_upper([3.0, 700.0], 2) == pytest.approx([math.exp(-1.5), math.exp(-350.0)], rel=1e-11)
    assert chi2_upper(5.0, 3) == pytest.approx(math.erfc(math.sqrt(2.5)) + math.sqrt(10 / math.pi) * math.exp(-2.5), rel=1e-12)
