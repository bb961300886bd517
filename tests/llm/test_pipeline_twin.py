"""The pipeline's first two stages and its last one against brute force (the others have tests of their own)."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from basketlens.llm import queries
from basketlens.llm.common import saved

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = saved(stage["quality_rules"](spark, docs, SF), "twin-good")
    text = dict(good.select("doc_id", "text").collect())
    assert 0 < len(text) < docs.count()
    for t in text.values():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = list(zip(words, words[1:], words[2:]))
        many = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else set()
        covered = {i + j for i, g in enumerate(grams) if g in many for j in range(3)}
        assert len(words) >= 50 and 100 * len(covered) <= 50 * len(words)

    sets, root = {i: shingles(t) for i, t in text.items()}, {i: i for i in text}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    unique = saved(stage["ngram_jaccard_join"](spark, good, SF), "twin-unique")
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i in text if find(i) == i)

    mixed = saved(stage["curriculum_mix"](spark, saved(stage["secret_scan"](spark, unique, SF), "twin-clean"), SF), "twin-mixed")
    library = Tokenizer.from_file(queries.byte_bpe_path())
    want = []
    for i, t in mixed.select("doc_id", "text").collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in stage["bpe_automaton"](spark, mixed, SF).collect()]
    assert sorted(got) == sorted(want) and {r[0] for r in got} <= {i for i in text if find(i) == i}
    run = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(run) == sorted(want)
