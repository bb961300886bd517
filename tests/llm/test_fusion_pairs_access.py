"""Operators 2, 7 and 8 against brute force: evidence fusion, similar signature sets, access to shards."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from basketlens.llm import language_id as L
from basketlens.llm import queries, spotsigs, wavelet
from basketlens.llm.common import shared_path

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, kept double"


def page(text, lang=None):
    return f"<html{f' lang={lang}' if lang else ''}><script>x</script><p>{text}</p></html>"


@pytest.fixture(scope="module")
def labelled_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) > 200")


@pytest.fixture(scope="module")
def pages(spark, labelled_docs):
    rng, rows = random.Random(2), []
    for i, (text, lang) in enumerate(labelled_docs.select("text", "lang").orderBy("doc_id").limit(80).collect()):
        host = rng.choice([f"www.{lang}.example.co.uk", f"{lang}.site.org", "10.0.0.1", "big.com"])
        rows.append((i, f"http://{host}/{i}", page(text.replace("<", " "), lang if rng.random() < 0.7 else None), 1.0))
    rows += [(None, None, None, None), (900, "no address", "", 1.0), (900, "no address", "", 1.0)]
    return spark.createDataFrame(rows, PAGES)


def twin(rows, docs):
    """The posterior of every page, by loops."""
    counts = {}
    for text, lang in docs:
        bins = L.trigram_bins(np.frombuffer((text or "").encode(), np.uint8))
        counts[lang] = counts.get(lang, np.zeros(L.BINS)) + np.bincount(bins, minlength=L.BINS)
    langs = sorted(counts)
    log_p = [np.log((counts[x] + L.ALPHA) / (counts[x].sum() + L.ALPHA * L.BINS)) for x in langs]
    seen = []
    for _, url, html, _ in rows:
        host = url.split("/")[2] if url and "//" in url else ""
        labels = host.split(".")
        numeric = len(labels) == 4 and all(x.isdigit() for x in labels)
        two = ".".join(labels[-2:]) if len(labels) > 1 else ""
        domain = host if numeric else ".".join(labels[-3:]) if two in L.SHARED_SUFFIXES and len(labels) > 2 else two
        declared = html.split("lang=")[1][:2] if html and html.startswith("<html lang=") else ""
        bins = L.trigram_bins(np.frombuffer(L.visible_text(html).encode(), np.uint8))
        ll = [float(p[bins].sum()) * min(1.0, L.EVIDENCE / len(bins)) if len(bins) else 0.0 for p in log_p]
        seen.append((host, domain, "" if numeric else labels[-1], declared, ll, int(np.argmax(ll)) if len(bins) else None))
    total = Counter(x[5] for x in seen if x[5] is not None)
    by = [Counter((x[j], x[5]) for x in seen) for j in range(4)]
    values = [len({x[j] for x in seen}) for j in range(4)]
    size, k, out = sum(total.values()), len(langs), []
    for x in seen:
        own = [float(i == x[5]) for i in range(k)]
        prior = [(total[i] + 1) / (size + k) for i in range(k)]
        for j in (1, 0):
            n = [by[j][x[j], i] - own[i] for i in range(k)]
            prior = [(n[i] + L.STRENGTH * prior[i]) / (sum(n) + L.STRENGTH) for i in range(k)]
        score = [x[4][i] + math.log(prior[i]) for i in range(k)]
        for j in (3, 2):
            score = [score[i] + math.log((by[j][x[j], i] - own[i] + L.ALPHA) / (total[i] - own[i] + L.ALPHA * values[j])) for i in range(k)]
        best = max(range(k), key=lambda i: score[i])
        out.append((langs[best], 1 / sum(math.exp(s - score[best]) for s in score)))
    return out


def test_fusion_equals_brute_force(pages, labelled_docs):
    rows = [tuple(r) for r in pages.collect()]
    want = twin(rows, labelled_docs.select("text", "lang").collect())
    got = {}
    for r in L.fuse(pages, labelled_docs).collect():
        got.setdefault(r.page_id, []).append((r.lang, r.probability))
    assert sum(map(len, got.values())) == len(rows)
    for r, (lang, p) in zip(rows, want):
        assert got[r[0]][0][0] == lang and got[r[0]][0][1] == pytest.approx(p, rel=1e-9)


def test_fusion_finds_the_language(pages, labelled_docs):
    lang = [r.lang for r in labelled_docs.select("lang", "doc_id").orderBy("doc_id").limit(80).collect()]
    got = {r.page_id: r.lang for r in L.fuse(pages, labelled_docs).collect()}
    assert sum(got[i] == x for i, x in enumerate(lang)) >= 0.95 * len(lang)


def test_fusion_edges(spark, pages, labelled_docs):
    assert L.fuse(pages.limit(0), labelled_docs).count() == 0
    assert {r.lang for r in L.fuse(pages, labelled_docs.limit(0)).collect()} == {None}
    with pytest.raises(ValueError):
        L.fuse(pages, labelled_docs.withColumn("lang", labelled_docs.doc_id.cast("string")), max_languages=5)


def test_length_partitions_hold_all_similar_lengths():
    for percent in (50, 75, 90):
        bounds = spotsigs.length_bounds(percent, 2000)
        part = [sum(b <= n for b in bounds) for n in range(1500)]
        for n in range(1, 1000):
            m = min(1499, 100 * n // percent)
            assert part[m] - part[n] <= 1


@pytest.mark.parametrize("percent", [60, 75])
def test_similar_pairs_equal_brute_force(spark, edge_docs, percent):
    rng = random.Random(7)
    words = ["the", "of", "to", "is", *[f"w{i}" for i in range(40)]]
    rows = []
    for g in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        for _ in range(rng.randint(1, 8)):
            t = list(text)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(500, None), (500, ""), (None, rows[0][1]), (None, "the big house of stone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, members = spotsigs.similar_pairs(docs, percent)
    sets = {r.class_key: frozenset(r.sigs) for r in spotsigs.signature_classes(docs).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    got = [(r.left_key, r.right_key) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    rows_of = members.collect()
    assert len(rows_of) == len(rows) and len({r.class_key for r in rows_of}) == len(sets)
    size = Counter(r.class_key for r in rows_of)
    assert all(r.class_size == size[r.class_key] for r in rows_of)


def test_similar_pairs_edges(edge_docs, no_docs):
    pairs, members = spotsigs.similar_pairs(edge_docs)
    assert members.count() == 7 and all(r.left_key < r.right_key for r in pairs.collect())
    pairs, members = spotsigs.similar_pairs(no_docs)
    assert pairs.count() == 0 and members.count() == 0


def test_access_to_shards(spark, edge_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    out = shared_path(spark, "shards-test")
    wavelet.write_shards(docs, out, queries.word_bpe_path(), shard_tokens=5000)
    rows = wavelet.read_shards(spark, out).collect()
    assert len(rows) == docs.count()
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(rows, key=lambda r: r.start)])
    asked = [0, 1, 1, 4999, 5000, 5001, len(ids) // 2, len(ids) - 1, len(ids), -1, None]
    got = wavelet.token_at(spark, out, spark.createDataFrame([(x,) for x in asked], "position long"), shard_tokens=5000).collect()
    assert len(got) == len(asked)
    for r in got:
        inside = r.position is not None and 0 <= r.position < len(ids)
        assert r.token == (int(ids[r.position]) if inside else None)
    tokens = [1, int(ids[0]), int(ids[7]), 49_407, 10**6]
    assert {r.token: r.n for r in wavelet.count_of(spark, out, tokens).collect()} == {t: int((ids == t).sum()) for t in set(tokens)}
    where = wavelet.positions_of(spark, out, tokens).collect()
    assert sorted((r.token, r.position) for r in where) == sorted((t, int(i)) for t in set(tokens) for i in np.flatnonzero(ids == t))


def test_shards_of_an_empty_table(spark, no_docs):
    out = shared_path(spark, "shards-empty")
    wavelet.write_shards(no_docs, out, queries.word_bpe_path())
    assert wavelet.read_shards(spark, out).count() == 0
    assert [(r.token, r.n) for r in wavelet.count_of(spark, out, [1]).collect()] == [(1, 0)]
