"""Each operator against a brute-force twin, and on nulls, empty and long texts, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from basketlens.llm import (bpe_automaton, chat_collapse, curriculum, jaccard_join, lattice_lm, quality_bands, queries,
                            secret_index, spotsigs, wavelet)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_quality_matches_brute_force(docs):
    got = {r.doc_id: r for r in quality_bands.score(docs).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        words = WORD.findall(text)
        grams = list(zip(words, words[1:], words[2:]))
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 400 else None
        assert got[i].n_words == len(words) and got[i].word_chars == sum(map(len, words))
        if covered is not None:
            assert got[i].n_repeat_words == len(covered)


def test_quality_edge_cases(edge_docs, no_docs):
    rows = quality_bands.score(edge_docs).collect()
    assert len(rows) == 7 and not any(r.kept for r in rows if r.n_words < 50)
    assert quality_bands.score(no_docs).count() == 0
    assert quality_bands.keep_good(edge_docs).columns == edge_docs.columns


def labelled(quality):
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    ids = pq.read_table("/root/testdata/sf0.1/labels.parquet", filters=[("quality", "=", quality)]).column("doc_id")
    d = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    return d.filter(pc.is_in(d.column("doc_id"), ids.combine_chunks())).column("text").combine_chunks()


def test_quality_bands_decide():
    import base64

    import pyarrow as pa

    texts = labelled(1)
    good, bad = quality_bands.metrics(texts), quality_bands.metrics(labelled(0))
    assert (good["kept"] == ~good["base_failed"]).all()
    assert (~bad["base_failed"]).sum() == 291 and bad["kept"].sum() == 81  # 210 are left to the bands
    size, ok = np.array([len(t.as_py().encode()) for t in texts]), ~good["base_failed"] & (good["ratio"] > 0)
    fits = ok & (size < 24576)
    assert quality_bands.fitted(size[fits], good["ratio"][fits], [b[0] for b in quality_bands.BANDS[:-1]]) == quality_bands.BANDS[1:-1]

    prose = [t.as_py() for t, k, n in zip(texts, ok, size) if k and 2000 < n < 12000][:40]
    rng = random.Random(4)
    junk = []
    for t in prose:
        n = len(t.encode())
        code = base64.b64encode(rng.randbytes(n)).decode()
        junk.append(" ".join(code[i:i + 8] for i in range(0, n, 9)))  # incompressible
        words = t.split()[:60]
        junk.append(" ".join(rng.choice(words) for _ in range(n // 6)))  # repetitive, few repeated word triples
        junk.append(" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in t.split()))  # symbols
    got = quality_bands.metrics(pa.array(junk))
    assert not got["base_failed"].any() and not got["kept"].any()


def near_copies():
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base)) for i in (900, 901)]
    for i in range(60):  # copies with one to nine changed words, so not all of them link with each other
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    shared = " ".join(f"p{k}" for k in range(60))
    rows += [(100 + i, shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(150))) for i in range(40)]
    return [*rows, (500, None), (501, ""), (502, "a B c"), (503, "A b C"), (503, "A b C"), (None, " ".join(base))]


def brute_components(rows, pct=75):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= pct * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(sets[k]), low.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_jaccard_join_matches_brute_force(spark):
    rows = near_copies()
    got = jaccard_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def brute_links(rows, pct=75):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links = [sum(i != j and bool(a & b) and 100 * len(a & b) >= pct * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    return sorted(((i, n) for (i, _), n in zip(rows, links)), key=str)


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_ROWS, 7])
def test_jaccard_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    words = [f"t{k}" for k in range(100)]
    triangle = [(800 + k, " ".join([*words, f"end{k}"])) for k in range(3)]  # all three link with each other
    grown = [(810 + k, " ".join([f"g{j}" for j in range(60 + 6 * k)])) for k in range(12)]  # sizes in several bands
    copies = [(830 + k, "only exact copies of this one text " * 3) for k in range(9)]
    rows = [*near_copies(), *triangle, *grown, *copies]
    got = jaccard_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_links(rows)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == want
    assert dict(want)[801] == 2 and dict(want)[830] == 8


def test_sets_that_share_a_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SUM_BITS", 3)
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicate_classes(frame).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == brute_links(rows)
    monkeypatch.setattr(jaccard_join, "MAX_CLASHES", 2)
    with pytest.raises(RuntimeError, match="share more than 2"):
        jaccard_join.near_duplicate_classes(frame)


def test_jaccard_join_of_nothing(no_docs):
    assert jaccard_join.near_duplicate_classes(no_docs).count() == 0


PATTERNS = {"assign": re.compile(secret_index.RULES[0].pattern, re.A), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            n = len(m[2]) if kind == "assign" else len(m[0])
            if n >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_secrets_match_brute_force(docs, edge_docs, no_docs):
    for d in (docs, edge_docs):
        want = sorted((str(i), hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in brute_spans(t)).encode()).hexdigest())
                      for i, t in d.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.base_sha256) for r in secret_index.report(d).collect()) == want
    clean = secret_index.redact(edge_docs)
    assert clean.columns == edge_docs.columns and not any(brute_spans(r.text) for r in clean.collect())
    assert secret_index.report(no_docs).count() == 0


def test_mixing_targets_and_limits(docs, edge_docs, no_docs):
    rows = curriculum.plan(docs).collect()
    total = sum(r.size for r in rows)
    assert abs(sum({r.src: r.target for r in rows}.values()) - 1.5 * total) < 1e-6 * total
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    assert all(0 <= r.position <= 1 for r in rows if r.position is not None)
    assert curriculum.plan(edge_docs).count() == 7 and curriculum.plan(no_docs).count() == 0
    assert curriculum.mixed(docs).count() == sum(r.copies for r in rows)


def test_lattice_base_score(spark, docs, edge_docs, no_docs):
    got = {r.doc_id: r for r in lattice_lm.score(docs, queries.piece_path(), head=500).collect()}
    counts = {}
    for i, t in docs.select("doc_id", "text").collect():
        if zlib.crc32(str(i).encode()) % 10:
            for w in [*WORD.findall(t.translate(LOWER)), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in docs.select("doc_id", "text").collect():
        tokens = [*WORD.findall(t.translate(LOWER)), None]
        want = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert got[i].n_tokens == len(tokens) and got[i].base_score == pytest.approx(want) and got[i].score < 0
    assert lattice_lm.score(edge_docs, queries.piece_path()).count() == 7
    assert lattice_lm.score(no_docs, queries.piece_path()).count() == 0


def test_lattice_recursion_sums_all_segmentations():
    p = lattice_lm.load_pieces(queries.piece_path())
    log_p = p.log_rank - np.log(np.exp(p.log_rank).sum())
    total, expected = lattice_lm.marginals(p, log_p, [b"ab", "é".encode()], np.ones(2))
    src, dst, piece, off = p.lattice([b"ab"])
    paths = {0: 1.0}
    for node in range(1, off[1]):
        paths[node] = sum(paths.get(int(s), 0.0) * np.exp(log_p[k]) for s, d, k in zip(src, dst, piece) if d == node)
    assert total[0] == pytest.approx(np.log(paths[int(off[1]) - 1])) and expected.sum() > 0


def test_spotsigs(docs, edge_docs, no_docs):
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    text = dict(docs.select("doc_id", "text").collect())
    ids = sorted(text, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        k = len(text[a]) // 3
        edited = text[a][:len(text[a]) - k] + text[b][:k]
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[a].near_next <= 1 and (text[a] != text[b] or got[a].near_next == 1)
    assert spotsigs.fingerprints(edge_docs).count() == 7 and spotsigs.fingerprints(no_docs).count() == 0


def test_wavelet_matrix():
    values = np.random.default_rng(1).integers(0, 49_408, 3000)
    values[::9] = 77
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(values).to_bytes())
    assert (m.decode() == values).all() and all(m.access(i) == values[i] for i in range(0, 3000, 41))
    assert m.occurrences(77) == np.flatnonzero(values == 77).tolist() and m.rank(77, 1000) == (values[:1000] == 77).sum()
    for few in ([], [0], [3, 3]):
        assert wavelet.WaveletMatrix.build(np.array(few, np.uint32)).decode().tolist() == few


def test_wavelet_shards_match_library(spark):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(queries.word_bpe_path()), 0
    got = {r.doc_id: r for r in queries.op8_wavelet_shards(spark, SF).collect()}
    for i, text in sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_automaton_matches_library(edge_docs, no_docs):
    from tokenizers import Tokenizer

    path = queries.byte_bpe_path()
    t, a, rng = Tokenizer.from_file(path), bpe_automaton.automaton(path), random.Random(5)
    alphabet = [*"  \n\t'sstremvldaABCé1²٣😀_-<|.。", "'re", " 's", "<|endoftext|>", "\xa0"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    raw = [x.encode() for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, at = a.encode(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for i, want in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i]:at[i + 1]].tolist() == want.ids
    rows = bpe_automaton.encode_decode(edge_docs, path).collect()
    assert len(rows) == 7 and bpe_automaton.encode_decode(no_docs, path).count() == 0


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"),
            (4, 0, "user", None), (None, 0, "user", "bye")]
    out = chat_collapse.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.copies) for r in out) == [("2", 2, 2), ("4", 1, 1), ("None", 1, 1)]


def test_pipeline_stages_keep_columns(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"
    out = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in quality_bands.keep_good(docs).collect()}
    assert {r.doc_id for r in out.collect()} <= kept and out.columns[0] == "doc_id"
