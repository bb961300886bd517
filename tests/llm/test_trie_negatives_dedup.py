"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, empty tables, clashing columns, long inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basketlens.llm import hard_negatives, prefix_trie, run_merge


# --- operator 11 -----------------------------------------------------------

def rebuilt(rows):
    """Python twin of shared_heads; ``rows`` are (conv, turn, role, text) without ties of different turns."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    return out


def brute_trie(seqs):
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        saved[k] = own + sum(saved[x] for x in kids[k])
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
    rows = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(k)))
        rows.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


TURNS = "conv_id long, turn long, role string, text string, bucket int, pos string, k1 int"


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, 3, "x", 4) for r in rows], TURNS)
    out = prefix_trie.trie(*prefix_trie.shared_heads(prefix_trie.turn_rows(df)))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_trie_equals_brute_force_with_heads_nulls_and_repeated_rows(spark):
    rnd = random.Random(5)
    rows = []
    for c in list(range(0, 40)) + [51, 52, 1003]:  # 50 and 1000 are absent
        for t in range(rnd.randrange(1, 10)):
            text = rnd.choice(["a", "é😀", "", None, "bb"])
            rows.append((c, t if t else rnd.choice([0, None]), rnd.choice(["user", None]), text))
    rows += [(3, 99, "user", "z"), (3, 99, "user", "z"), (None, 1, "user", "lost"), (-7, 0, "user", "a")]
    assert trie_rows(spark, rows) == brute_trie(rebuilt(rows))


def test_trie_of_deep_conversations_crosses_blocks(spark):
    shared = [("u", f"t{i % 7}") for i in range(37)]
    seqs = {1: shared, 2: shared + [("u", "x")], 3: shared[:33] + [("v", "q" * 50)] * 70, 4: shared[:33] + [("v", "q" * 50)] * 70,
            5: shared[:16], 6: shared[:32], 7: shared[:33], 9: [("w", "lone")] * 90, 10: [], 11: shared[:20] + [("n", "n")] * 12}
    rows = [(c, i, r, x) for c, s in seqs.items() for i, (r, x) in enumerate(s)]
    t = prefix_trie.turn_rows(spark.createDataFrame([(*r, 1, "x", 1) for r in rows], TURNS))
    convs = spark.createDataFrame([(c,) for c in seqs], "conv long")
    got = sorted((tuple(r) for r in prefix_trie.trie(convs, t).collect()), key=str)
    assert got == brute_trie(seqs)


def test_trie_of_many_equal_conversations_and_of_no_rows(spark):
    rows = [(c, t, "u", "same") for c in range(0, 5000, 5) for t in range(2)]
    assert trie_rows(spark, rows) == brute_trie(rebuilt(rows))
    assert trie_rows(spark, []) == []


def test_trie_ids_join_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    every = spark.createDataFrame([(c, 0, 0, 0, 0) for c in (-25, -3, 0, 9, 10, 11, 305)], "conv long, k1 long, k2 long, length long, size long")
    assert [r.ends for r in prefix_trie.end_hashes(every).collect()] == [hashlib.sha256(b"-25,-3,0,9,10,11,305").hexdigest()]


def test_trie_hot_parents_take_the_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", 3)
    seqs = {c: [("u", "hi"), ("a", str(c))] + [("u", str(c % 3))] * (c % 2) for c in range(30)}
    rows = [(c, i, r, x) for c, s in seqs.items() for i, (r, x) in enumerate(s)]
    t = prefix_trie.turn_rows(spark.createDataFrame([(*r, 1, "x", 1) for r in rows], TURNS))
    got = sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame([(c,) for c in seqs], "conv long"), t).collect()), key=str)
    assert got == brute_trie(seqs)


# --- operator 12 -----------------------------------------------------------

def brute_negatives(rows, anchors=100):
    e = []
    for i, (vid, vec, lab) in enumerate(rows):
        if lab is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        e.append((i, vid, (lab + 1) % 10 if vid is not None and vid % 7 == 0 else lab, [math.floor(256 * x) for x in vec]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, vid, lab, q in e:
        if vid is None or vid % anchors:
            continue
        s = [(dot(q, x), v, l) for j, v, l, x in e if j != i]
        for ps, pid, _ in sorted((r for r in s if r[2] == lab), key=order)[:5]:
            neg = sorted((r for r in s if r[2] != lab and 30 * ps <= 100 * r[0] <= 90 * ps), key=order)[:10]
            out += [(vid, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(neg)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, row int, leaf int, q string, id int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives.mine(df, "vec_id", "embedding", label, F.col("id") % 100 == 0).collect()), key=str)


def vectors(n, dim, seed):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [float(f"{(c + rnd.gauss(0, 0.2)):.6f}") for c in rnd.choice(centres)], rnd.randrange(4)) for i in range(n)]


def as_float32(rows):
    import numpy as np
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


def test_negatives_equal_brute_force_with_edges(spark):
    rows = vectors(420, 6, 1)
    rows += [(500, None, 1), (501, [1.0, None, 0, 0, 0, 0], 1), (502, [float("nan")] * 6, 1), (503, [float("inf")] * 6, 2), (504, rows[3][1], None),
             (None, rows[100][1], 2), (505, [0.5, 0.5], 2), (506, [], 1), (600, [0.0] * 6, 0), (300, rows[300][1], rows[300][2]), rows[100], rows[41], rows[41]]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0], i % 3) for i in range(130)]  # ties, one very common vector
    rows = as_float32(rows)
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_through_several_levels_chunks_and_blocks(spark, monkeypatch):
    for name, value in (("FAN", 4), ("LEAF_ROWS", 30), ("CHUNK", 16), ("QUERY_BLOCK", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = as_float32(vectors(900, 5, 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.mine(df, "vec_id", "embedding", F.col("label"), F.col("id") % 20 == 0)
    want = brute_negatives([(v * 7 + 1, x, lab) for v, x, lab in rows], 1)  # ids moved off the multiples of 7
    want = sorted(((a // 7, p // 7, k, n // 7, s, t) for a, p, k, n, s, t in want if (a // 7) % 20 == 0), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_ranges_eliminate_far_siblings():
    import numpy as np
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(20, 8)).repeat(100, 0) + rng.normal(scale=0.02, size=(2000, 8))))
    tree = hard_negatives.SplitTree.fit(x[::10], 2)
    tree.empty_ranges()
    tree.add_rows(x)
    q, s = x[::50], x[::50] @ x.T
    low = np.sort(s, 1)[:, -20].astype(float)
    who, leaf, _ = tree.route(q, low, np.full(len(q), np.inf))
    visited = np.zeros((len(q), hard_negatives.FAN ** 2), dtype=bool)
    visited[who, leaf] = True
    home = tree.place(x)
    assert all(visited[i, home[s[i] >= low[i]]].all() for i in range(len(q)))  # nothing lost
    assert visited.sum() < 0.4 * len(q) * len(np.unique(home))  # most siblings ruled out


def test_negatives_of_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(100, None, 1)]) == []


def test_products_stay_exact_beyond_doubles():
    import numpy as np
    a = np.full((1, 64), float(1 << 24))
    a[0, 0] -= 1
    assert int(hard_negatives.products(a, a)[0, 0]) == sum(int(v) ** 2 for v in a[0])


# --- operator 13 -----------------------------------------------------------

def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        t = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), doc_id is None, doc_id or 0, doc_id))
    out = []
    for t, g in groups.items():
        g.sort()
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(r[3], g[0][3], len(g), k == 0, sha) for k, r in enumerate(g)]
    return sorted(out, key=str)


DOCS = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (4, "a b"), (None, "ab"), (5, "ab  "), (6, "ab "), (7, "é😀 x"), (8, "é 😀x"),
        (9, "word " * 50_000), (10, "word" * 50_000), (11, "A B"), (None, None), (12, "a b ")]


@pytest.mark.parametrize("shuffle", ["4", "40"])
def test_copies_equal_brute_force(spark, shuffle):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)  # one round, two rounds
    try:
        rows = DOCS + [(100 + i, f"t{i % 9} " * (i % 4 + 1)) for i in range(300)]
        df = spark.createDataFrame([(*r, "c", 7, b"x", True) for r in rows], "doc_id long, text string, d string, row int, sha binary, kept boolean").repartition(9)
        got = run_merge.tree_merge(df)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_copies(rows)
        kept = run_merge.deduplicated(df)
        assert kept.columns == df.columns
        want = sorted((r[0], r[4]) for r in brute_copies(rows) if r[3] and r[0] is not None)
        assert sorted((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in kept.collect() if r.doc_id is not None) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_of_no_rows_and_no_python_in_the_plan(spark, no_docs):
    out = run_merge.tree_merge(no_docs)
    assert out.count() == 0 and run_merge.deduplicated(no_docs).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
