"""Distributed isolation forest (M4); MLlib has none.

Plan:

1. Features: NULL -> 0, standardised with population mean/std (one aggregate
   row, broadcast), as the reference's scaler.
2. Sampling by key hashes, never ``rand()`` or partition ids, so the forest is
   identical for any partitioning. One rule at every size: a row has one point
   on the unit circle (a hash of its key), a tree a starting point, and takes
   the ``psi = min(256, n)`` rows that follow it. The circle is cut into cells
   of about ``2 psi / n``; a row meets only the trees whose arc touches its
   cell (an equi-join with at most three small rows a tree), so work is O(n).
   Arcs are doubled until every tree is full.
3. ``groupBy(tree).applyInPandas`` grows each tree from its <= 1.3 * psi rows
   (bounded group size) with a per-tree seeded RNG.
4. The forest (<= trees * (2 psi - 1) nodes) is the fitted model: collected
   once and shipped to a vectorised ``mapInPandas`` scorer.
5. Offset = ``contamination`` quantile of the training scores; flag =
   score - offset < 0, as scikit-learn's ``predict``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EULER = 0.5772156649015329


def avg_path_length(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful BST search, c(n)."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    out = np.where(big, 2.0 * (np.log(np.where(big, n - 1, 1)) + _EULER) - 2.0 * (n - 1) / np.where(big, n, 1), out)
    return out


def standardize(df: DataFrame, features: Sequence[str], prefix: str = "_z_", fill: float | None = 0.0,
                ddof: int = 0) -> DataFrame:
    """Zero mean, unit variance per feature (M1); population std by default.

    A constant feature is left at 0 (scikit-learn keeps scale 1 there).
    """
    src = df
    if fill is not None:
        src = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(fill)) for f in features})
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = src.agg(*[F.struct(F.avg(f).alias("m"), std(f).alias("s")).alias(f"_st_{f}") for f in features])
    out = src.crossJoin(F.broadcast(stats))
    zs = {}
    for f in features:
        s = F.col(f"_st_{f}")
        zs[f"{prefix}{f}"] = F.coalesce(F.try_divide(F.col(f) - s["m"], F.when(s["s"] > 0, s["s"])), F.lit(0.0))
    return out.withColumns(zs).drop(*[f"_st_{f}" for f in features])


def _unit_hash(*cols) -> F.Column:
    """Uniform [0, 1) from xxhash64 of the given columns (deterministic)."""
    h = F.xxhash64(*cols)
    return (F.abs(h % F.lit(1 << 53)).cast("double")) / float(1 << 53)


def _tree_samples(df: DataFrame, key: str, zcols: Sequence[str], trees: int, psi: int, n: int,
                  seed: int) -> DataFrame:
    """The ``psi`` rows that follow each tree's starting point on the circle of key hashes."""
    from pyspark.sql.window import Window

    starts = np.random.default_rng(seed).random(trees)
    placed = df.select(key, *zcols, _unit_hash(F.lit(seed), F.col(key)).alias("_u"))

    def candidates(width: float) -> DataFrame:
        cells = max(1, int(1 / width))
        arcs = [(int(c), t, float(s)) for t, s in enumerate(starts)
                for c in {c % cells for c in range(int(s * cells), int((s + width) * cells) + 1)}]
        arcs = df.sparkSession.createDataFrame(arcs, "_cell long, tree int, _start double")
        near = placed.withColumn("_cell", F.least(F.floor(F.col("_u") * cells), F.lit(cells - 1)).cast("long"))
        near = near.join(F.broadcast(arcs), "_cell")  # at most three rows a tree
        return (near.withColumn("_h", F.pmod(F.col("_u") - F.col("_start"), F.lit(1.0)))
                .filter(F.col("_h") < width).drop("_u", "_cell", "_start"))

    width = min(1.0, 2.0 * psi / max(n, 1))
    while True:
        pairs = candidates(width)
        if width >= 1.0 or pairs.groupBy("tree").count().filter(F.col("count") >= psi).count() == trees:
            break
        width = min(1.0, 2 * width)
    w = Window.partitionBy("tree").orderBy("_h", key)
    return pairs.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= psi).drop("_rk")


def _grow(pdf: pd.DataFrame, zcols: list[str], psi: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    X = pdf.sort_values("_h")[zcols].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree])
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rows = []  # node, feature, threshold, left, right, size

    def build(idx: np.ndarray, depth: int) -> int:
        node = len(rows)
        rows.append([node, -1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return node
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return node
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        rows[node][1], rows[node][2] = f, thr
        rows[node][3] = build(left, depth + 1)
        rows[node][4] = build(right, depth + 1)
        return node

    build(np.arange(len(X)), 0)
    out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "size"])
    out.insert(0, "tree", tree)
    return out


def fit_isolation_forest(df: DataFrame, key: str, zcols: Sequence[str], trees: int = 200, max_samples: int = 256,
                         seed: int = 42) -> tuple[pd.DataFrame, int]:
    """Grow the forest; returns the node table (the model) and psi."""
    n = df.count()
    psi = min(max_samples, n)
    samples = _tree_samples(df, key, list(zcols), trees, psi, n, seed)
    schema = "tree int, node int, feature int, threshold double, left int, right int, size int"
    from basketlens.session import task_parallelism

    forest = (samples.select("tree", "_h", *zcols)
                     .repartition(task_parallelism(df.sparkSession), "tree")
                     .groupBy("tree").applyInPandas(lambda p: _grow(p, list(zcols), psi, seed), schema))
    return forest.toPandas(), psi


def _score_batches(batches, zcols: list[str], model: dict, psi: int, key: str):
    cpsi = float(avg_path_length(psi))
    for pdf in batches:
        X = pdf[zcols].to_numpy(dtype=float)
        total = np.zeros(len(X))
        for feat, thr, left, right, size in model.values():
            node = np.zeros(len(X), dtype=np.int64)
            depth = np.zeros(len(X))
            active = feat[node] >= 0
            while active.any():
                f = feat[node[active]]
                go_left = X[active, f] < thr[node[active]]
                node[active] = np.where(go_left, left[node[active]], right[node[active]])
                depth[active] += 1
                active = feat[node] >= 0
            total += depth + avg_path_length(size[node])
        mean_depth = total / len(model)
        score = -np.power(2.0, -mean_depth / cpsi)
        yield pd.DataFrame({key: pdf[key], "iso_score_samples": score})


def isolation_forest(df: DataFrame, features: Sequence[str], key: str, contamination: float = 0.05,
                     trees: int = 200, max_samples: int = 256, seed: int = 42, digits: int = 4) -> DataFrame:
    """Flag the ``contamination`` share of rows that isolate fastest (M4).

    Adds ``iso_anomaly_score`` (score - offset, rounded) and ``iso_flagged``.
    """
    from basketlens.session import ensure_checkpoint_dir

    z = standardize(df.select(key, *features), features)
    zcols = [f"_z_{f}" for f in features]
    # Four jobs read the standardised features (count, sample, score,
    # offset): cut the lineage once into the shared checkpoint folder.
    ensure_checkpoint_dir(df.sparkSession)
    z = z.select(key, *zcols).checkpoint(eager=True)
    nodes, psi = fit_isolation_forest(z, key, zcols, trees, max_samples, seed)
    model = {}
    for t, g in nodes.groupby("tree"):
        g = g.sort_values("node")
        model[int(t)] = (g["feature"].to_numpy(np.int64), g["threshold"].to_numpy(float),
                         g["left"].to_numpy(np.int64), g["right"].to_numpy(np.int64), g["size"].to_numpy(float))
    ktype = dict(z.dtypes)[key]
    from basketlens.session import task_parallelism

    scored = z.repartition(task_parallelism(df.sparkSession)).mapInPandas(
        lambda it: _score_batches(it, zcols, model, psi, key),
                           f"`{key}` {ktype}, iso_score_samples double")
    from basketlens.operators.quantile import quantile_frame

    scored = scored.checkpoint(eager=True)  # read by the offset and the flags
    offset = quantile_frame(scored, "iso_score_samples", [contamination]).select(F.col("_q")[0].alias("_bl_offset"))
    dec = F.col("iso_score_samples") - F.col("_bl_offset")
    res = (scored.crossJoin(F.broadcast(offset))
                 .select(key, dec.alias("_dec"))
                 .select(key, (F.col("_dec") < 0).alias("iso_flagged"),
                         F.bround(F.col("_dec") * 10 ** digits, 0).alias("_r")))
    res = res.withColumn("iso_anomaly_score", F.col("_r") / float(10 ** digits)).drop("_r")
    return df.join(res, key)
