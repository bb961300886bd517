import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import stats


def _pearson_np(x, y):
    return float(np.corrcoef(x, y)[0, 1])


def test_pearson_and_constant_column(spark):
    rows = [(float(i), float(i * i % 7), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    r = stats.pearson_test(df, "x", "y", digits=None).first()
    x, y = zip(*[(a, b) for a, b, _ in rows])
    assert r.r == pytest.approx(_pearson_np(x, y), abs=1e-12)
    assert r.t == pytest.approx(r.r * math.sqrt(28 / (1 - r.r ** 2)), rel=1e-12)
    const = stats.pearson_test(df, "x", "c").first()
    assert const.r is None and const.p is None and const.significant is False


def test_pairwise_deletion(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 7.0), (None, 1.0), (4.0, 8.0)], "x double, y double")
    r = stats.pearson_test(df, "x", "y", digits=None).first()
    assert r.n == 3 and r.r == pytest.approx(_pearson_np([1, 3, 4], [2, 7, 8]), abs=1e-12)


def _chi2_ref(table, yates):
    t = np.asarray(table, float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    o = t.copy()
    if yates:
        d = e - o
        o = o + np.minimum(0.5, np.abs(d)) * np.sign(d)
    return float(((o - e) ** 2 / e).sum())


def test_chi_square_yates_only_for_dof_1(spark):
    # 2x2 with Yates, and a 3x2 with an empty cell (zero-filled) without Yates.
    rows = [("a", 1)] * 12 + [("a", 0)] * 5 + [("b", 1)] * 3 + [("b", 0)] * 9
    rows += [("x", 1)] * 4 + [("y", 1)] * 6 + [("y", 0)] * 2 + [("z", 0)] * 7
    df = spark.createDataFrame([(d if d in "ab" else None, d if d in "xyz" else None, o) for d, o in rows],
                               "d1 string, d2 string, o int")
    res = {r.dimension: r for r in stats.chi_square(df, ["d1", "d2"], "o", digits=None).collect()}
    assert res["d1"].dof == 1 and res["d1"].chi2 == pytest.approx(_chi2_ref([[12, 5], [3, 9]], True), rel=1e-12)
    assert res["d2"].dof == 2 and res["d2"].chi2 == pytest.approx(_chi2_ref([[4, 0], [6, 2], [0, 7]], False),
                                                                   rel=1e-12)


def _avg_ranks(v):
    v = np.asarray(v, float)
    order = np.argsort(v, kind="mergesort")
    ranks = np.empty(len(v))
    ranks[order] = np.arange(1, len(v) + 1)
    for u in np.unique(v):
        m = v == u
        ranks[m] = ranks[m].mean()
    return ranks


def test_mann_whitney_and_kruskal_match_formulas(spark):
    a = [1.0, 2.0, 2.0, 3.5, 4.0, 6.0, 6.0, 7.0, 9.0, 10.0]
    b = [2.0, 3.0, 5.0, 6.0, 8.0, 8.0, 11.0, 12.0, 12.0, 13.0, 14.0]
    c = [0.5, 6.0, 9.0]
    rows = [(v, "A") for v in a] + [(v, "B") for v in b] + [(v, "C") for v in c]
    df = spark.createDataFrame(rows, "v double, g string")
    mw = stats.mann_whitney(df, "v", "g", "A", "B", buckets=3, digits=None).first()
    allv = np.array(a + b)
    rk = _avg_ranks(allv)
    u1 = rk[: len(a)].sum() - len(a) * (len(a) + 1) / 2
    assert mw.u == pytest.approx(u1)
    kw = stats.kruskal_wallis(df, "v", "g", buckets=3, digits=None).first()
    allv = np.array(a + b + c)
    rk = _avg_ranks(allv)
    n = len(allv)
    groups = [rk[: len(a)], rk[len(a): len(a) + len(b)], rk[len(a) + len(b):]]
    h = 12 / (n * (n + 1)) * sum(g.sum() ** 2 / len(g) for g in groups) - 3 * (n + 1)
    _, cnt = np.unique(allv, return_counts=True)
    h /= 1 - (cnt ** 3 - cnt).sum() / (n ** 3 - n)
    assert kw.h == pytest.approx(h, rel=1e-12) and kw.dof == 2 and 0 < kw.p < 1


def test_bootstrap_is_partition_invariant_and_brackets_r(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    y = 0.6 * x + rng.normal(size=60)
    df = spark.createDataFrame([(i, "g", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "k long, grp string, x double, y double")
    r1 = stats.bootstrap_corr_ci(df.repartition(1), "x", "y", "grp", "k", reps=400).first()
    r2 = stats.bootstrap_corr_ci(df.repartition(7), "x", "y", "grp", "k", reps=400).first()
    assert r1.ci_lower == pytest.approx(r2.ci_lower, abs=1e-12)
    assert r1.ci_upper == pytest.approx(r2.ci_upper, abs=1e-12)
    assert r1.ci_lower < r1.r_observed < r1.ci_upper


def test_ab_sample_size_normal_approximation(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(10)], "seg string, m double")
    r = stats.ab_sample_size(df, "seg", "m", effect_size=0.5).first()
    assert r.required_per_group == 63  # 2 * ((1.96 + 0.8416) / 0.5)^2 = 62.79


def test_bootstrap_by_name(spark):
    rows = [(f"item {i}", "g", float(i % 7), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, grp string, x double, y double")
    r = stats.bootstrap_corr_ci(df, "x", "y", "grp", "k", reps=200).first()
    assert r.ci_lower < r.r_observed < r.ci_upper


def test_forest_samples_are_full_at_any_size(spark):
    from basketlens.operators.forest import _tree_samples

    for n in (300, 60000, 70000):
        df = spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("double").alias("z"))
        s = _tree_samples(df, "k", ["z"], 50, 256, n, 42).groupBy("tree").agg(F.count("*").alias("c"), F.countDistinct("k").alias("d")).collect()
        assert len(s) == 50 and all(r.c == r.d == 256 for r in s), n


def test_tied_ranks_in_place_equal_pandas_and_join_no_values(spark):
    import numpy as np
    import pandas as pd
    from basketlens.operators.ordered import tied_ranks

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"v": rng.integers(-40, 40, 900) / 4.0, "g": rng.integers(0, 9, 900)})
    pdf.loc[:250, "v"] = 2.5  # one value holds more than a quarter
    vg = pdf.groupby(["v", "g"]).size().reset_index(name="c")
    df = spark.createDataFrame(vg)
    got = tied_ranks(df, "v", "c", "rank", "t", buckets=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    want = pdf.assign(rank=pdf.v.rank()).groupby("v").agg(rank=("rank", "first"), t=("v", "size"))
    rows = got.collect()
    assert len(rows) == len(vg)
    assert all((r.rank, r.t) == (want.loc[r.v, "rank"], want.loc[r.v, "t"]) for r in rows)


def test_looked_up_poisson_weights_equal_the_search():
    import numpy as np
    from basketlens.operators import stats

    thr = stats._poisson1_thresholds()
    near = (thr.astype(np.int64)[:, None] + np.arange(-70_000, 70_000, 997)).clip(0, 2 ** 32 - 1).ravel()
    h = np.concatenate([near, thr, np.array([0, 2 ** 32 - 1]), np.random.default_rng(1).integers(0, 2 ** 32, 50_000)]).astype(np.uint32)
    got = stats._poisson1_weights(h, thr, stats._poisson1_table(thr))
    assert (got == np.searchsorted(thr, h, side="right")).all()
