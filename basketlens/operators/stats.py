"""Distributed hypothesis tests and correlations.

Each test reduces the data with Spark aggregations to a handful of numbers
per group (sums, co-moments, rank sums, contingency counts); only the tail
probability of the final statistic is a pandas UDF on those aggregated rows.
Rank tests collapse the input to distinct ``(value, count)`` rows and rank
them with the bucketed global order, so ties and hot values stay cheap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from basketlens.functions.core import mean, pround
from basketlens.functions.dist import EXACT_U_VALUES, chi2_pvalue, exact_u_pvalue, norm_ppf, t_pvalue
from basketlens.operators.ordered import running_sum, tied_ranks
from basketlens.operators.profile import long_by_dimension
from basketlens.session import saved, scratch


def _r_from_moments(cov: Column, vx: Column, vy: Column) -> Column:
    """Pearson r from sample co-moments; NULL for a constant column."""
    return F.try_divide(cov, F.sqrt(vx * vy))


def _t_from_r(r: Column, n: Column) -> Column:
    return r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))


def pearson_test(df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_rows: int | None = None,
                 alpha: float = 0.05, digits: int | None = 6) -> DataFrame:
    """Pearson r with t statistic and two-sided p per group (H1).

    Pairwise deletion: rows where either value is NULL are ignored (N11).
    ``min_rows`` keeps groups with more than that many rows (P14). A perfect
    correlation gives p = 0; a constant column gives NULL r, t and p.
    """
    keys = list(by)
    src = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    agg = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(both, 1)).alias("n"),
        F.covar_samp(F.when(both, F.col("_x")), F.when(both, F.col("_y"))).alias("_cov"),
        F.var_samp(F.when(both, F.col("_x"))).alias("_vx"),
        F.var_samp(F.when(both, F.col("_y"))).alias("_vy"))
    if min_rows is not None:
        agg = agg.filter(F.col("rows") > min_rows)
    r = _r_from_moments(F.col("_cov"), F.col("_vx"), F.col("_vy"))
    out = (agg.withColumn("r", r)
              .withColumn("t", _t_from_r(F.col("r"), F.col("n")))
              .withColumn("dof", F.col("n") - 2))
    p = F.when(F.abs(F.col("r")) >= 1, F.lit(0.0)).otherwise(t_pvalue(F.col("t"), F.col("dof")))
    out = out.withColumn("p", p).withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))
    if digits is not None:
        out = out.withColumn("r", pround("r", digits)).withColumn("t", pround("t", digits))
    return out.select(*keys, F.lit(x).alias("x"), F.lit(y).alias("y"), "rows", "n", "r", "t", "dof", "p",
                      "significant")


def correlation_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], digits: int | None = 6,
                      with_p: bool = True, alpha: float = 0.05) -> DataFrame:
    """Pearson r for many column pairs in ONE aggregate pass.

    Long output ``(x, y, n, r[, t, dof, p, significant])``; pairwise deletion.
    """
    exprs = []
    for i, (a, b) in enumerate(pairs):
        xa, yb = F.col(a).cast("double"), F.col(b).cast("double")
        both = xa.isNotNull() & yb.isNotNull()
        exprs += [F.count(F.when(both, 1)).alias(f"n{i}"),
                  F.covar_samp(F.when(both, xa), F.when(both, yb)).alias(f"c{i}"),
                  F.var_samp(F.when(both, xa)).alias(f"vx{i}"),
                  F.var_samp(F.when(both, yb)).alias(f"vy{i}")]
    row = df.agg(*exprs)
    parts = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{i}").alias("n"),
                      _r_from_moments(F.col(f"c{i}"), F.col(f"vx{i}"), F.col(f"vy{i}")).alias("r"))
             for i, (a, b) in enumerate(pairs)]
    out = row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    if with_p:
        out = (out.withColumn("t", _t_from_r(F.col("r"), F.col("n")))
                  .withColumn("dof", F.col("n") - 2))
        out = out.withColumn("p", F.when(F.abs(F.col("r")) >= 1, F.lit(0.0))
                                   .otherwise(t_pvalue(F.col("t"), F.col("dof"))))
        out = out.withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))
        if digits is not None:
            out = out.withColumn("t", pround("t", digits))
    if digits is not None:
        out = out.withColumn("r", pround("r", digits))
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int | None = 3) -> DataFrame:
    """All ordered column pairs incl. the diagonal, long form."""
    pairs = [(a, b) for a in columns for b in columns]
    return correlation_pairs(df, pairs, digits=digits, with_p=False)


def correlation_grid(df: DataFrame, xs: Sequence[str], ys: Sequence[str], digits: int | None = 6) -> DataFrame:
    """Every x against every y with t and p (H2)."""
    return correlation_pairs(df, [(a, b) for a in xs for b in ys], digits=digits)


def pairwise_tests(df: DataFrame, columns: Sequence[str], digits: int | None = 6) -> DataFrame:
    """Significance of every unordered pair (H1 over A27 pairs)."""
    return correlation_pairs(df, list(combinations(columns, 2)), digits=digits)


def chi_square(df: DataFrame, dims: Sequence[str], outcome: str, alpha: float = 0.05,
               digits: int | None = 6) -> DataFrame:
    """Chi-square test of independence of ``outcome`` and each dimension.

    Observed values define the table (as ``pd.crosstab``); missing cells are
    zeros. Yates' correction is applied when dof = 1 (SciPy's default). One
    row per dimension: ``(dimension, n, chi2, dof, p, significant)``. The
    counts table has one row per (dimension, segment, outcome), so every
    later step is tiny.
    """
    long = long_by_dimension(df.filter(F.col(outcome).isNotNull()), dims, [outcome])
    long = long.withColumnRenamed(outcome, "_bl_y")
    obs = long.groupBy("dimension", "segment", "_bl_y").agg(F.count(F.lit(1)).alias("_bl_o"))
    rows = obs.groupBy("dimension", "segment").agg(F.sum("_bl_o").alias("_bl_rt"))
    cols = obs.groupBy("dimension", "_bl_y").agg(F.sum("_bl_o").alias("_bl_ct"))
    tot = obs.groupBy("dimension").agg(F.sum("_bl_o").alias("_bl_n"), F.count_distinct("segment").alias("_bl_nr"),
                                       F.count_distinct("_bl_y").alias("_bl_nc"))
    grid = (rows.join(cols, "dimension").join(obs, ["dimension", "segment", "_bl_y"], "left")
                .join(tot, "dimension")
                .withColumn("_bl_o", F.coalesce(F.col("_bl_o"), F.lit(0)).cast("double"))
                .withColumn("_bl_e", F.col("_bl_rt").cast("double") * F.col("_bl_ct") / F.col("_bl_n"))
                .withColumn("_bl_dof", (F.col("_bl_nr") - 1) * (F.col("_bl_nc") - 1)))
    o, e = F.col("_bl_o"), F.col("_bl_e")
    diff = e - o
    adj = F.when(F.col("_bl_dof") == 1, o + F.least(F.lit(0.5), F.abs(diff)) * F.signum(diff)).otherwise(o)
    grid = grid.withColumn("_bl_term", F.try_divide((adj - e) * (adj - e), e))
    res = grid.groupBy("dimension").agg(F.first("_bl_n").alias("n"), F.sum("_bl_term").alias("chi2"),
                                        F.first("_bl_dof").alias("dof"))
    res = res.withColumn("p", chi2_pvalue(F.col("chi2"), F.col("dof")))
    res = res.withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))
    if digits is not None:
        res = res.withColumn("chi2", pround("chi2", digits))
    return res


SMALL_SAMPLE = 8


def mann_whitney(df: DataFrame, value: str, group: str, first, second, buckets: int | None = None,
                 alpha: float = 0.05, digits: int | None = 6) -> DataFrame:
    """Two-sided Mann-Whitney U of ``first`` vs ``second`` (H4).

    Asymptotic normal test with tie and continuity corrections; where one
    sample has at most SMALL_SAMPLE values and nothing is tied, p comes from the
    exact distribution of U (the choice the usual statistics library makes).
    ``u`` is the statistic of ``first``.
    """
    d = df.filter(F.col(value).isNotNull() & F.col(group).isin(first, second)) \
          .select(F.col(value).cast("double").alias("_v"), (F.col(group) == F.lit(first)).cast("int").alias("_g1"))
    per = d.groupBy("_v").agg(F.count(F.lit(1)).alias("t"), F.sum("_g1").alias("c1"))
    with scratch(df.sparkSession):  # the ordered counts go as soon as their sums are known
        cum = running_sum(per, [("_v", False)], "t", "_cum", buckets=buckets)
        rk = cum.withColumn("rank", F.col("_cum") - F.col("t") + (F.col("t") + 1) / 2.0)
        s = saved(rk.agg(F.sum(F.col("c1") * F.col("rank")).alias("r1"), F.sum("c1").cast("double").alias("n1"),
                         F.sum("t").cast("double").alias("n"),
                         F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie")), "rank_sums", scope=-2)
    n1, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    out = s.select(F.lit(str(first)).alias("group_1"), F.lit(str(second)).alias("group_2"),
                   n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), u1.alias("u"),
                   F.greatest(u1, n1 * n2 - u1).alias("_umax"),
                   (n1 * n2 / 2).alias("_mu"), F.col("tie").alias("_tie"),
                   F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1)))).alias("_s"))
    z = F.try_divide(F.col("_umax") - F.col("_mu") - 0.5, F.col("_s"))
    out = out.withColumn("z", z)
    out = out.withColumn("p", F.when(F.col("z") < 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), 2 * _norm_sf(F.col("z")))))
    small = (F.least("n1", "n2") <= SMALL_SAMPLE) & (F.least("n1", "n2") > 0) & (F.col("_tie") == 0) & (F.col("n1") * F.col("n2") <= EXACT_U_VALUES)
    exact = [F.when(small, c) for c in (F.col("n1"), F.col("n2"), F.col("_umax"))]
    out = out.withColumn("_exact", exact_u_pvalue(*exact)).withColumn("p", F.coalesce("_exact", "p"))
    out = out.withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False))).drop("_umax", "_mu", "_s", "_tie", "_exact")
    if digits is not None:
        out = out.withColumn("z", pround("z", digits))
    return out


def _norm_sf(z: Column) -> Column:
    from basketlens.functions.dist import norm_pvalue
    return norm_pvalue(z) / 2


def kruskal_wallis(df: DataFrame, value: str, group: str, buckets: int | None = None, alpha: float = 0.05,
                   digits: int | None = 6) -> DataFrame:
    """Kruskal-Wallis H over the groups of ``group`` with tie correction (H5).

    The counts per value and group are written once and ranked where they are;
    rank sums and ties come from one pass, one row a group. A value of t rows adds
    t^3 - t to the ties: t^2 - 1 for each of its rows.
    """
    d = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()) \
          .select(F.col(value).cast("double").alias("_v"), F.col(group).alias("_g"))
    with scratch(df.sparkSession):  # the counts go as soon as the groups' sums are known
        vg = saved(d.groupBy("_v", "_g").agg(F.count(F.lit(1)).alias("c")), "value_groups")
        ranks = tied_ranks(vg, "_v", "c", "rank", "t", buckets)
        per_group = saved(ranks.groupBy("_g").agg(
            F.sum(F.col("c") * F.col("rank")).alias("rsum"), F.sum("c").cast("double").alias("ng"),
            F.sum(F.col("c") * (F.pow(F.col("t").cast("double"), 2) - 1)).alias("tg")), "group_ranks", scope=-2)
    ties = per_group.agg(F.sum("tg").alias("tie"), F.sum("ng").alias("n"))
    off = F.col("rsum") / F.col("ng") - (F.col("n") + 1) / 2  # mean rank of the group against the overall one
    g = per_group.crossJoin(F.broadcast(ties)).agg(
        F.sum(F.col("ng") * off * off).alias("ssum"), F.count(F.lit(1)).alias("k"),
        F.first("tie").alias("tie"), F.first("n").alias("n"))
    n = F.col("n")
    h = F.try_divide(F.lit(12.0) * F.col("ssum") / (n * (n + 1)), 1 - F.col("tie") / (n * n * n - n))
    out = g.select(F.lit(value).alias("value"), F.lit(group).alias("group"),
                                   n.cast("bigint").alias("n"), F.col("k"), h.alias("h"),
                                   (F.col("k") - 1).alias("dof"))
    out = out.withColumn("p", chi2_pvalue(F.col("h"), F.col("dof")))
    out = out.withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))
    if digits is not None:
        out = out.withColumn("h", pround("h", digits))
    return out


# ------------------------------------------------------------- bootstrap

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def _poisson1_thresholds() -> np.ndarray:
    """Poisson(1) CDF scaled to 32-bit integers: ``searchsorted`` on raw hash bits."""
    k = np.arange(0, 20)
    pmf = np.exp(-1.0) / np.array([math.factorial(int(i)) for i in k], dtype=float)
    return np.minimum(np.cumsum(pmf) * float(1 << 32), float((1 << 32) - 1)).astype(np.uint32)


#: Groups whose sums a task holds before it passes them on (480 KB each at 10,000 replicates).
_GROUPS_HELD = 128

#: Weights that are hashed and looked up together (they stay in a core's cache).
_LOOKED_UP = 1 << 17

_C1, _C2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _poisson1_table(thr: np.ndarray) -> np.ndarray:
    """Weight by the leading 16 bits of a hash; 255 where the other bits decide."""
    lead = np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)
    low, high = (np.searchsorted(thr, x, side="right") for x in (lead, lead | np.uint32(0xFFFF)))
    return np.where(low == high, low, 255).astype(np.uint8)


def _poisson1_weights(h: np.ndarray, thr: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``searchsorted(thr, h, side="right")`` by table, searched only where 16 bits leave it open."""
    w = table[h >> np.uint32(16)]
    open_ = np.flatnonzero(w == 255)
    w[open_] = np.searchsorted(thr, h[open_], side="right")
    return w


def _fmix32_inplace(h: np.ndarray, tmp: np.ndarray) -> None:
    """murmur3 32-bit finaliser, in place (SIMD-friendly 32-bit multiplies)."""
    for shift, mult in ((16, _C1), (13, _C2), (16, None)):
        np.right_shift(h, np.uint32(shift), out=tmp)
        h ^= tmp
        if mult is not None:
            h *= mult


def _boot_sums(batches, by: str, key: str, x: str, y: str, reps: int, seed: int, chunk: int):
    """Per partition: Poisson(1) weights per (row, rep) from a hash of (seed, rep, key),
    reduced at once to 6 weighted sums per (group, rep). Rows are never exploded.

    The row hash and the replicate hash are computed once each; a (row, rep)
    weight costs one in-place mix and one table lookup. Batches are added
    into the sums one by one, and sums leave the task when ``_GROUPS_HELD``
    groups are held, so memory depends on neither rows nor groups; chunks of
    replicates keep the working set near ``chunk`` weights.
    """
    thr = _poisson1_thresholds()
    table = _poisson1_table(thr)
    sums: dict = {}

    def flush():
        if sums:
            flat = np.concatenate(list(sums.values()))
            yield pd.DataFrame({by: np.repeat(np.asarray(list(sums), dtype=object), reps),
                                "rep": np.tile(np.arange(reps, dtype=np.int64), len(sums)),
                                "s0": flat[:, 0], "sx": flat[:, 1], "sy": flat[:, 2],
                                "sxx": flat[:, 3], "syy": flat[:, 4], "sxy": flat[:, 5]})
            sums.clear()

    with np.errstate(over="ignore"):
        rep_h = (_mix(np.arange(reps, dtype=np.uint64) * _M1 + _mix(np.uint64(seed) + _G))
                 & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for pdf in batches:
            for group, rows in pdf.groupby(by, sort=False):
                if group not in sums and len(sums) == _GROUPS_HELD:
                    yield from flush()
                total = sums.setdefault(group, np.zeros((reps, 6)))
                keys = rows[key].to_numpy().astype(np.int64).astype(np.uint64)
                xv, yv = rows[x].to_numpy(dtype=float), rows[y].to_numpy(dtype=float)
                feats = np.stack([np.ones_like(xv), xv, yv, xv * xv, yv * yv, xv * yv], axis=1)
                base = (_mix(keys * _G + np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)
                m = len(keys)
                step = max(1, min(reps, chunk // m))
                few = max(1, min(step, _LOOKED_UP // m))
                h = np.empty((few, m), dtype=np.uint32)
                tmp = np.empty_like(h)
                w = np.empty((step, m))
                for r0 in range(0, reps, step):
                    r1 = min(reps, r0 + step)
                    for a in range(r0, r1, few):
                        b = min(r1, a + few)
                        hv, tv = h[: b - a], tmp[: b - a]
                        np.bitwise_xor(base[None, :], rep_h[a:b, None], out=hv)
                        _fmix32_inplace(hv, tv)
                        w[a - r0:b - r0] = _poisson1_weights(hv.ravel(), thr, table).reshape(hv.shape)
                    total[r0:r1] += w[: r1 - r0] @ feats
        yield from flush()


def bootstrap_corr_ci(df: DataFrame, x: str, y: str, by: str, key: str, reps: int = 10000,
                      level: float = 0.95, seed: int = 42, chunk: int = 1 << 21) -> DataFrame:
    """Bootstrap percentile CI of Pearson r per group (H7), Poisson bootstrap.

    Each row gets a Poisson(1) multiplicity per replicate from a hash of
    (seed, replicate, ``key``), so the result does not depend on
    partitioning. Partitions reduce their rows to 6 sums per (group,
    replicate) in ``mapInPandas``; Spark adds the partials; r per replicate
    and its percentiles are ordinary aggregates (at most ``reps`` values per
    group). Degenerate replicates (NULL r) are dropped and counted.
    """
    if not isinstance(df.schema[key].dataType, IntegralType):  # names and other keys by their hash
        df = df.withColumn(key, F.xxhash64(key))
    src = df.select(by, key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)) \
            .filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(by).isNotNull())
    from basketlens.session import task_parallelism

    gtype = dict(src.dtypes)[by]
    schema = f"`{by}` {gtype}, rep bigint, s0 double, sx double, sy double, sxx double, syy double, sxy double"
    # rows x reps of vectorised work: spread the rows over every core.
    src = src.repartition(task_parallelism(src.sparkSession))
    partial = src.mapInPandas(lambda it: _boot_sums(it, by, key, x, y, reps, seed, chunk), schema)
    sums = partial.groupBy(by, "rep").agg(*[F.sum(c).alias(c) for c in ("s0", "sx", "sy", "sxx", "syy", "sxy")])
    num = F.col("s0") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = F.sqrt((F.col("s0") * F.col("sxx") - F.col("sx") * F.col("sx"))
                 * (F.col("s0") * F.col("syy") - F.col("sy") * F.col("sy")))
    r = sums.select(by, F.try_divide(num, F.when(den > 0, den)).alias("r"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    ci = r.groupBy(by).agg(F.percentile(F.col("r"), [lo, hi]).alias("_ci"),
                           F.count(F.when(F.col("r").isNull(), 1)).alias("degenerate_reps"))
    obs = pearson_test(src, x, y, by=[by], digits=None).select(by, F.col("r").alias("r_observed"))
    return (obs.join(ci, by)
               .select(by, "r_observed", F.col("_ci")[0].alias("ci_lower"), F.col("_ci")[1].alias("ci_upper"),
                       F.lit(reps).alias("reps"), "degenerate_reps"))


def uplift_scenarios(ci: DataFrame, products: DataFrame, by: str, discount: str = "avg_discount_pct",
                     orders: str = "total_orders", price: str = "avg_price") -> DataFrame:
    """Best/Expected/Worst revenue uplift from the CI bounds (H7 second half).

    uplift = |r| * mean discount * mean orders / 100 * mean price per group.
    """
    means = products.groupBy(by).agg(mean(discount).alias("_d"), mean(orders).alias("_o"), mean(price).alias("_p"))
    j = ci.join(means, by)
    sc = F.array(*[F.struct(F.lit(lbl).alias("scenario"), F.col(c).alias("r"))
                   for lbl, c in (("Best", "ci_lower"), ("Expected", "r_observed"), ("Worst", "ci_upper"))])
    return (j.select(by, "_d", "_o", "_p", F.explode(sc).alias("s"))
             .select(by, "s.scenario", "s.r",
                     (F.abs(F.col("s.r")) * F.col("_d") * F.col("_o") / 100 * F.col("_p")).alias("revenue_uplift")))


def ab_sample_size(df: DataFrame, segment: str, metric: str, lift: float | None = None,
                   effect_size: float | None = 0.5, power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """Required rows per arm for a two-sided two-sample test (H8, normal approximation).

    d = ``effect_size`` or ``lift * mean / std`` of the segment; n = 2((z_{1-a/2} + z_power) / d)^2.
    """
    za, zb = norm_ppf(1 - alpha / 2), norm_ppf(power)
    g = df.groupBy(segment).agg(F.count(metric).alias("n"), mean(metric).alias("mean"),
                                F.stddev_samp(F.col(metric).cast("double")).alias("std"))
    d = F.lit(float(effect_size)) if effect_size is not None else F.try_divide(F.lit(lift) * F.col("mean"),
                                                                              F.col("std"))
    req = F.ceil(2 * F.pow(F.try_divide(F.lit(za + zb), d), 2))
    return (g.withColumn("effect_size", d).withColumn("required_per_group", req)
             .withColumn("enough", F.coalesce(F.col("n") >= 2 * F.col("required_per_group"), F.lit(False))))
