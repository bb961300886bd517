import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators.quantile import order_code, quantile_frame

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def test_radix_equals_exact_and_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 1), ("b", 2), ("c", 500), ("d", 3000), (None, 5)):
        vals = np.round(rng.lognormal(3, 1, n), 1)
        if g == "d":
            vals[: n // 3] = 42.0  # a hot value holding a third of the group
        rows += [(g, float(v)) for v in vals]
    rows += [("c", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    exact = {r.g: r._q for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", PROBS).alias("_q")).collect()}
    radix = {r.g: r._q for r in quantile_frame(df, "v", PROBS, ["g"]).collect()}
    assert set(exact) == set(radix)
    for g in exact:
        vals = np.array([v for k, v in rows if k == g and v is not None])
        assert radix[g] == pytest.approx(exact[g], abs=1e-9), g
        assert radix[g] == pytest.approx(list(np.percentile(vals, [p * 100 for p in PROBS])), abs=1e-9), g


@pytest.mark.parametrize("values", [
    [-1.5, -0.0, 0.0, 5e-324, 1e-310, -1e-310, 2.0 ** -1022, 1e308, -1e308, 1.7976931348623157e308],
    [1e9 + i / 1024 for i in range(300)],  # all alike in the leading 31 bits
    [float(2 ** 52 + i) for i in range(50)] * 3,
    [-float(i) for i in range(1000)] + [float("inf"), float("-inf")],
])
def test_radix_of_awkward_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.2, 0.5, 0.8, 1.0]
    got = quantile_frame(df, "v", probs).first()._q
    s = sorted(values)
    for p, g in zip(probs, got):
        at = (len(s) - 1) * p
        lo, hi = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
        assert (g == lo == hi) or g == pytest.approx(lo + (hi - lo) * (at - int(at)), rel=1e-12) or lo == float("-inf") or hi == float("inf")


def test_order_code_keeps_the_order_of_doubles(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64).view(np.float64)
    v = np.concatenate([v[~np.isnan(v)], 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1022, 1024), 0), [0.0, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", order_code("v").alias("c"))
    bits = v.view(np.int64)
    want = np.where(bits < 0, -(bits & np.int64(2 ** 63 - 1)), bits)
    assert [r.c for r in df.collect()] == want.tolist()


def test_no_rows_give_one_null_row_without_groups(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantile_frame(df, "v", [0.5, 0.9]).first()._q == [None, None]
    assert quantile_frame(df, "v", [0.5], ["g"]).count() == 0


def test_values_are_shuffled_once(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("v"))
    q = quantile_frame(df, "v", [0.5], ["g"])
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "percentile" not in plan
