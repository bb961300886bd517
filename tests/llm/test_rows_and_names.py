"""Rows with NULL and repeated ids, clashing column names, and the sparse trie."""

import random

import numpy as np

from basketlens.llm import curriculum, jaccard_join, kernels, secret_index

T = " ".join(f"w{i}" for i in range(40))
U = " ".join(f"u{i}" for i in range(30))


def test_one_row_of_each_group_stays_when_ids_repeat_or_are_null(spark):
    rows = [(1, T, 1), (1, T, 2), (None, T, 3), (None, T, 4), (5, T, 5), (5, U, 6), (None, U + " x", 7), (7, None, 8), (7, "", 9), (None, "", 10), (8, T + " z", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int")
    got = jaccard_join.keep_one_per_group(df)
    assert got.columns == df.columns
    out = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(out, key=str) == sorted([(1, T), (5, U), (7, None), (7, ""), (None, "")], key=str)


def test_group_of_null_ids_only_keeps_one(spark):
    rows = [(None, T), (None, T), (None, U), (3, "short text"), (4, "other words")]
    got = jaccard_join.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text for r in got)) == sorted([T, U, "short text", "other words"])


def test_unique_ids_keep_the_smallest(spark):
    rows = [(9, T), (2, T), (4, T + " end"), (6, U)]
    got = jaccard_join.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [2, 6]


def test_stages_pass_clashing_names_through(spark):
    names = ["__id", "__spans", "__rules", "__tie", "__at", "__plan"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    rows = [(i, f"password = hunter{i}22 and words " * 3, "en", "ab"[i % 2], 9, *range(6)) for i in range(6)]
    df = spark.createDataFrame(rows, schema)
    for out in (secret_index.redact(df), curriculum.mixed(df)):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(tuple(r[n] for n in names) == tuple(range(6)) for r in got)
    assert "hunter" not in secret_index.redact(df).first().text


def test_byte_trie_follows_exactly_its_words():
    rnd = random.Random(1)
    words = {bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randrange(1, 9))): i for i in range(400)}
    trie = kernels.ByteTrie(words)
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    for _ in range(3000):
        w = bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randrange(1, 9)))
        node = np.zeros(1, np.int64)
        for k, b in enumerate(w):
            node = trie.step(node, np.array([b], np.uint8))
            assert (node[0] > 0) == (w[:k + 1] in prefixes)
            if not node[0]:
                break
        else:
            assert trie.accept[node[0]] == words.get(w, -1)
    assert len(kernels.ByteTrie({}).accept) == 1
