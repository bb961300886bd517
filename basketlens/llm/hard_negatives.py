"""Hard-negative mining through a multiway hyperplane tree with sibling ranges (operator 12).

The index is a geometric near-neighbour access tree. A node has up to FAN split
points and a row belongs to the child of its nearest one. For every split point
and every sibling subtree the node stores the range of distances from the point
to the subtree's rows, and for every subtree the range of squared lengths. A
query asks for inner products within a window; with the length range of a
subtree this is an annulus of distances around the query. The distances from
the query to the split points, with the stored ranges, confine the distances
from the query to each sibling's rows; siblings whose interval misses the
annulus are eliminated, the others entered. Leaves are compared exactly, so the
result is exact whatever the split points are.

Split points come from a bounded sample (SAMPLE_PER_LEAF rows a leaf, at most
SAMPLE_PER_LEAF * FAN**MAX_LEVELS rows, smallest hashes first); every row is
indexed and the ranges cover all rows. The tree has at most FAN**MAX_LEVELS
leaves, so what is sent to tasks is bounded; larger leaves are cut into chunks
of about CHUNK rows, and the queries routed to a leaf into blocks of about
QUERY_BLOCK, and chunks meet blocks by key. A vector that a third of all rows
share is one leaf of many chunks.

Mining is two searches: the first rows of an anchor's own label (positives),
then for every anchor and positive the first rows of other labels whose score
lies within the window set by the positive's score. Each search first probes a
few leaves a query; the k-th score found narrows the window of the full pass.

Defined results: rows with a NULL label or vector or any NULL or non-finite
component take no part; rows with a NULL id do, last among ties, and are never
anchors; repeated rows are rows of their own; shorter vectors count as ending
in zeros; quantised components are held within +-2^24. Other columns take no
part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import partitions, saved

FAN = 8
MAX_LEVELS = 4
LEAF_ROWS = 2048
SAMPLE_PER_LEAF = 16
CHUNK = 4096
QUERY_BLOCK = 1024
PROBES = 2  # leaves a window looks into before its full pass
LIMIT = 1 << 24
LOWEST, HIGHEST = -(1 << 62), 1 << 62
EXACT = float(1 << 53)


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` float64 components, short rows ending in zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), dim))
    out[np.arange(dim) < lengths[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


@dataclass
class SplitTree:
    """Split points by level and node, and what all rows say about the subtrees.

    Nodes of level l are numbered 0 .. fan**l - 1, child j of node v is
    ``v * fan + j``; ``points[l][v]`` holds up to fan vectors. ``near`` and
    ``far`` [l][v, i, j] bound the distances from point i to subtree j,
    ``short`` and ``long`` [l][v, j] its squared lengths; ``count[l][v, j]`` rows.
    """

    dim: int
    points: list[dict[int, np.ndarray]]
    fan: int = FAN
    near: list[np.ndarray] = field(default_factory=list)
    far: list[np.ndarray] = field(default_factory=list)
    short: list[np.ndarray] = field(default_factory=list)
    long: list[np.ndarray] = field(default_factory=list)
    count: list[np.ndarray] = field(default_factory=list)

    @property
    def levels(self) -> int:
        return len(self.points)

    @staticmethod
    def fit(sample: np.ndarray, levels: int, fan: int = FAN) -> SplitTree:
        """Split points of every node: sample rows of the node, each farthest from those before it."""
        points: list[dict[int, np.ndarray]] = []
        at = np.zeros(len(sample), dtype=np.int64)
        for _ in range(levels):
            level = {}
            nxt = at * fan
            for v in np.unique(at):
                rows = np.flatnonzero(at == v)
                x = sample[rows]
                chosen = [0]
                gap = distances(x, x[:1])[:, 0]
                while len(chosen) < fan and gap.max() > 0:
                    chosen.append(int(gap.argmax()))
                    gap = np.minimum(gap, distances(x, x[chosen[-1:]])[:, 0])
                level[int(v)] = x[chosen]
                nxt[rows] += distances(x, x[chosen]).argmin(1)
            points.append(level)
            at = nxt
        return SplitTree(sample.shape[1], points, fan)

    def descend(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For every node met: (level, node, rows of x in it, their distances to its points, their children)."""
        at = np.zeros(len(x), dtype=np.int64)
        for level, nodes in enumerate(self.points):
            nxt = at * self.fan
            order = np.argsort(at, kind="stable")
            found, first = np.unique(at[order], return_index=True)
            for v, rows in zip(found, np.split(order, first[1:])):
                p = nodes.get(int(v))  # a node without sample rows has one child
                d = distances(x[rows], p) if p is not None else np.zeros((len(rows), 0))
                child = d.argmin(1) if p is not None else np.zeros(len(rows), dtype=np.int64)
                nxt[rows] += child
                yield level, int(v), rows, d, child
            at = nxt

    def place(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), dtype=np.int64)
        for _, v, rows, _, child in self.descend(x):
            leaf[rows] = v * self.fan + child
        return leaf

    def empty_ranges(self) -> None:
        for level in range(self.levels):
            n = self.fan ** level
            self.near.append(np.full((n, self.fan, self.fan), np.inf))
            self.far.append(np.full((n, self.fan, self.fan), -np.inf))
            self.short.append(np.full((n, self.fan), np.inf))
            self.long.append(np.full((n, self.fan), -np.inf))
            self.count.append(np.zeros((n, self.fan), dtype=np.int64))

    def add_rows(self, x: np.ndarray) -> None:
        """Widen the ranges by rows ``x``."""
        sq = (x * x).sum(1)
        for level, v, rows, d, child in self.descend(x):
            for j in np.unique(child):
                m = child == j
                k = d.shape[1]
                self.near[level][v, :k, j] = np.minimum(self.near[level][v, :k, j], d[m].min(0))
                self.far[level][v, :k, j] = np.maximum(self.far[level][v, :k, j], d[m].max(0))
                self.short[level][v, j] = min(self.short[level][v, j], sq[rows[m]].min())
                self.long[level][v, j] = max(self.long[level][v, j], sq[rows[m]].max())
                self.count[level][v, j] += int(m.sum())

    def range_rows(self) -> list[tuple]:
        """The ranges as rows (level, node, child, point, near, far, short, long, rows); point -1 is the child itself."""
        out = []
        for level in range(self.levels):
            for v, j in zip(*np.nonzero(self.count[level])):
                out.append((level, int(v), int(j), -1, 0.0, 0.0, float(self.short[level][v, j]), float(self.long[level][v, j]), int(self.count[level][v, j])))
                for i in np.flatnonzero(np.isfinite(self.near[level][v, :, j])):
                    out.append((level, int(v), int(j), int(i), float(self.near[level][v, i, j]), float(self.far[level][v, i, j]), 0.0, 0.0, 0))
        return out

    def set_ranges(self, rows: list) -> None:
        self.empty_ranges()
        for level, v, j, i, near, far, short, long, n in rows:
            if i < 0:
                self.short[level][v, j], self.long[level][v, j], self.count[level][v, j] = short, long, n
            else:
                self.near[level][v, i, j], self.far[level][v, i, j] = near, far

    def route(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, score of the leaf's split point) of all leaves that may hold scores within [low, high].

        ``low``, ``high`` are one window a row of ``q``, infinite where open.
        """
        sq = (q * q).sum(1)
        who, at = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
        score = np.zeros(len(q))
        for level, nodes in enumerate(self.points):
            parts = []
            order = np.argsort(at, kind="stable")
            found, first = np.unique(at[order], return_index=True)
            for v, sel in zip(found, np.split(order, first[1:])):
                i = who[sel]
                alive = self.count[level][v] > 0
                p = nodes.get(int(v))
                least = np.zeros((len(i), self.fan))
                most = np.full((len(i), self.fan), np.inf)
                centre = np.zeros((len(i), self.fan))
                if p is not None:
                    k = len(p)
                    d = distances(q[i], p)[:, :, None]
                    near, far = self.near[level][v, :k][None], self.far[level][v, :k][None]
                    least = np.maximum(np.maximum(d - far, near - d).max(1), 0.0)
                    most = (d + far).min(1)
                    centre[:, :k] = q[i] @ p.T
                with np.errstate(invalid="ignore"):
                    inner = sq[i][:, None] + self.short[level][v][None] - 2.0 * high[i][:, None]
                    outer = sq[i][:, None] + self.long[level][v][None] - 2.0 * low[i][:, None]
                slack = 1e-6 + 1e-7 * np.sqrt(sq[i][:, None] + np.where(alive, self.long[level][v], 0.0)[None])
                keep = alive[None] & (np.maximum(least - slack, 0.0) ** 2 <= outer + slack) & ((most + slack) ** 2 >= inner - slack)
                a, j = np.nonzero(keep)
                parts.append((i[a], v * self.fan + j, centre[a, j]))
            who, at, score = (np.concatenate(c) for c in zip(*parts)) if parts else (who[:0], at[:0], score[:0])
        return who, at, score


def quantised(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """(row, id, label, q): valid rows, components as floor(scale * x); ``row`` numbers them."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    q = F.transform("v", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * scale))).cast("int"))
    return (rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
            .where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(finite, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("row"), "id", "label", q.alias("q")))


@dataclass
class Index:
    tree: SplitTree
    rows: DataFrame  # (row, id, label, q, leaf), written
    leaves: dict[int, int]  # rows per leaf


def build_index(items: DataFrame) -> Index | None:
    """Places every row of ``items(row, id, label, q)`` in the tree; None if there is none."""
    spark = items.sparkSession
    items = saved(items, "items")
    n, dim = items.agg(F.count("*"), F.max(F.size("q"))).first()
    if not n:
        return None
    dim = max(1, dim)
    levels = 1
    while levels < MAX_LEVELS and FAN ** levels * LEAF_ROWS < n:
        levels += 1
    sample = items.select("q").orderBy(F.xxhash64("q", "row"), "row").limit(SAMPLE_PER_LEAF * FAN ** levels).toArrow()
    tree = SplitTree.fit(matrix(sample.column("q"), dim), levels, FAN)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.place(matrix(b.column("q"), dim)))], names=[*b.schema.names, "leaf"])

    placed = saved(items.mapInArrow(place, "row long, id long, label long, q array<int>, leaf long"), "placed")
    points, fan = tree.points, tree.fan

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SplitTree(dim, points, fan)
        own.empty_ranges()
        for b in batches:
            own.add_rows(matrix(b.column("q"), dim))
        cols = list(zip(*own.range_rows())) or [[]] * 9
        types = [pa.int32()] * 4 + [pa.float64()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         names=["level", "node", "child", "point", "near", "far", "short", "long", "n"])

    r = placed.select("q").mapInArrow(ranges, "level int, node int, child int, point int, near double, far double, short double, long double, n long")
    r = r.groupBy("level", "node", "child", "point").agg(F.min("near"), F.max("far"), F.min("short"), F.max("long"), F.sum("n"))
    tree.set_ranges([tuple(x) for x in r.collect()])  # at most FAN + 1 rows a subtree of a bounded tree
    last = tree.count[-1].reshape(-1)
    return Index(tree, placed, {int(i): int(last[i]) for i in np.flatnonzero(last)})


def routed(index: Index, queries: DataFrame, probe: bool) -> DataFrame:
    """Queries at every leaf that some window of theirs cannot rule out, with these windows; PROBES leaves a window if ``probe``."""
    tree = index.tree

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("q"), tree.dim)
            wins = b.column("windows")
            owner = np.repeat(np.arange(len(q)), np.diff(wins.offsets.to_numpy()))
            flat = wins.flatten()
            low, high = (flat.field(f).to_numpy().astype(np.float64) for f in ("low", "high"))
            who, leaf, score = tree.route(q[owner], np.where(low <= LOWEST, -np.inf, low), np.where(high >= HIGHEST, np.inf, high))
            if probe and len(who):
                aim = np.where(high[who] >= HIGHEST, -score, np.abs(high[who] - score))
                order = np.lexsort((leaf, aim, who))
                starts = np.flatnonzero(np.r_[True, np.diff(who[order]) != 0])
                place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
                pick = order[place < PROBES]
                who, leaf = who[pick], leaf[pick]
            order = np.lexsort((who, leaf, owner[who])) if len(who) else np.zeros(0, dtype=np.int64)
            who, leaf = who[order], leaf[order]
            new = np.flatnonzero(np.r_[True, (np.diff(owner[who]) != 0) | (np.diff(leaf) != 0)]) if len(who) else np.zeros(0, dtype=np.int64)
            for lo in range(0, len(new), 8192):
                part = new[lo:lo + 8192]
                stop = new[lo + 8192] if lo + 8192 < len(new) else len(who)
                cut = pa.array(np.r_[part, stop] - part[0], pa.int32())
                at = pa.array(owner[who[part]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[part]), *[b.column(c).take(at) for c in ("row", "label", "q")],
                     pa.ListArray.from_arrays(cut, flat.take(pa.array(who[part[0]:stop])))],
                    names=["leaf", "row", "label", "q", "windows"])

    spread = queries.repartition(partitions(queries.sparkSession), "row")
    return spread.mapInArrow(go, "leaf long, row long, label long, q array<int>, windows array<struct<slot: int, low: bigint, high: bigint>>")


def first_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))][:k]


def leaf_scores(index: Index, at_leaves: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, slot, found_row, found_id, found_label, score): the first k rows of each window within each chunk."""
    spark = at_leaves.sparkSession
    at_leaves = saved(at_leaves, "routed")
    routed_to = at_leaves.groupBy("leaf").count().collect()  # at most FAN**MAX_LEVELS rows
    sizes = [(r["leaf"], -(-index.leaves[r["leaf"]] // CHUNK), -(-r["count"] // QUERY_BLOCK)) for r in routed_to]
    size = F.broadcast(spark.createDataFrame(sizes, "leaf long, chunks int, blocks int"))
    rows = index.rows.join(size, "leaf").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks").cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = at_leaves.join(size, "leaf").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dim = index.tree.dim
    names = ["row", "slot", "found_row", "found_id", "score"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def compare(ask: pa.Table, row: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if ask.num_rows and row.num_rows:
            s = products(matrix(ask.column("q"), dim), matrix(row.column("q"), dim))
            number, label = (row.column(c).to_numpy() for c in ("row", "label"))
            ids = row.column("id").to_pandas().fillna(np.iinfo(np.int64).max).to_numpy().astype(np.int64) if row.column("id").null_count else row.column("id").to_numpy()
            given = row.column("id")
            for i, (own, lab, wins) in enumerate(zip(ask.column("row").to_pylist(), ask.column("label").to_pylist(), ask.column("windows").to_pylist())):
                fit = np.flatnonzero(((label == lab) == same) & (number != own))
                for w in wins:
                    at = fit[(s[i, fit] >= w["low"]) & (s[i, fit] <= w["high"])]
                    for j in at[first_rows(s[i, at], ids[at], k)]:
                        for c, value in zip(out, (own, w["slot"], int(number[j]), given[int(j)].as_py(), int(s[i, j]))):
                            c.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)

    key = ["leaf", "chunk", "block"]
    left = asks.select(*key, "row", "label", "q", "windows").groupBy(*key)
    right = rows.select(*key, "row", "id", "label", "q").groupBy(*key)
    return left.cogroup(right).applyInArrow(compare, "row long, slot int, found_row long, found_id long, score long")


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """First ``k`` rows of every window of ``queries(row, label, q, windows)``: (row, slot, place, found_row, found_id, score)."""
    w = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), F.col("found_id").asc_nulls_last(), "found_row")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

    queries = saved(queries, "queries")
    probe = ranked(leaf_scores(index, routed(index, queries, True), k, same))
    bound = saved(probe.where(F.col("place") == k).select("row", "slot", F.col("score").alias("bound")), "bounds")
    windows = queries.select("row", F.inline("windows")).join(bound, ["row", "slot"], "left")
    narrow = windows.groupBy("row").agg(F.collect_list(F.struct("slot", F.greatest("low", F.coalesce("bound", "low")).alias("low"), "high")).alias("windows"))
    full = queries.drop("windows").join(narrow, "row")
    return saved(ranked(leaf_scores(index, routed(index, full, False), k, same)), "found")


def mine(rows: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, positives: int = 5, negatives: int = 10,
         low_pct: int = 30, high_pct: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on ``id``; a negative's score lies between ``low_pct`` and
    ``high_pct`` per cent of the positive's.
    """
    index = build_index(quantised(rows, id_col, vector_col, label, scale))
    if index is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def window(slot: Column, low: Column, high: Column) -> Column:
        return F.struct(slot.cast("int").alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    anchors = index.rows.where(anchor).select("row", "id", "label", "q")
    everything = F.array(window(F.lit(0), F.lit(LOWEST), F.lit(HIGHEST)))
    near = search(index, anchors.select("row", "label", "q", everything.alias("windows")), positives, True)
    pairs = near.select("row", F.col("place").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    usable = pairs.where("positive_score >= 0")  # below zero the window is empty
    asked = usable.groupBy("row").agg(F.collect_list(window(F.col("slot"), F.expr(f"({low_pct} * positive_score + 99) div 100"),
                                                            F.expr(f"({high_pct} * positive_score) div 100"))).alias("windows"))
    found = search(index, anchors.drop("id").join(asked, "row"), negatives, False)
    return (found.join(pairs, ["row", "slot"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


#: DuckDB twin over ``embeddings``: all anchors against all rows.
SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q
           FROM (SELECT * FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
     s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, b.r AS br, b.vec_id AS id, b.label AS bl,
                  CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
           FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
     p AS (SELECT ar, anchor_id, id AS positive_id, score AS positive_score, al,
                  row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST) AS k
           FROM s WHERE al = bl QUALIFY k <= 5),
     n AS (SELECT p.ar, p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.id NULLS LAST) AS rank
           FROM p JOIN s ON s.ar = p.ar AND s.bl <> s.al AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
           QUALIFY rank <= 10)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""
