"""Operator 10: the compiled table against the explicit gadget construction and the library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from basketlens.llm import bpe_automaton, queries


def explicit_automaton(base, rules):
    """The gadget construction written out: {state: {label: state}} from a one-state automaton."""
    arcs, fresh = {0: {b: 0 for b in base}}, 1
    for u, v, uv in rules:
        reached = {out[u] for out in arcs.values() if u in out}
        assert len(reached) == 1  # equal labels lead to one state
        q = reached.pop()
        if v not in arcs[q]:
            continue
        arcs[fresh] = {x: to for x, to in arcs[q].items() if x != v}
        into = [p for p, out in arcs.items() if u in out]
        after = arcs[q][v]
        for p in into:
            arcs[p][u] = fresh
        if u == v:
            after = q  # the pair is taken from the left: what follows it is what followed its second half
        for p in into:
            arcs[p][uv] = after
        fresh += 1
    return arcs


def test_merge_table_equals_the_gadget_construction():
    rng = random.Random(11)
    for _ in range(60):
        names = ["a", "b", "c"]
        rules = []
        for _ in range(rng.randint(1, 14)):
            u, v = rng.choice(names), rng.choice(names)
            # a rule whose pair no longer occurs has no gadget; vocabularies hold none
            if u + v not in names:
                t = bpe_automaton.MergeTable([0, 1, 2], [(names.index(x), names.index(y), names.index(x + y)) for x, y in rules], len(names))
                if t.has(np.array([names.index(u)]), np.array([names.index(v)]))[0]:
                    names.append(u + v)
                    rules.append((u, v))
        ids = [(names.index(u), names.index(v), names.index(u + v)) for u, v in rules]
        t, n = bpe_automaton.MergeTable([0, 1, 2], ids, len(names)), len(names)
        arcs = explicit_automaton([0, 1, 2], ids)
        for u in range(n):
            q = next(out[u] for out in arcs.values() if u in out)
            assert [bool(x) for x in t.has(np.full(n, u), np.arange(n))] == [v in arcs[q] for v in range(n)]
        assert t.has(np.full(n, n), np.arange(n)).all()


def test_automaton_refuses_other_settings():
    plain = {"model": {"type": "BPE"}, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel"}}
    bpe_automaton.check_settings(plain)
    for part in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "Unigram"}},
                 {"model": {"type": "BPE", "end_of_word_suffix": "</w>"}}, {"added_tokens": [{"content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe_automaton.check_settings(plain | part)


def test_automaton_on_long_pieces():
    from tokenizers import Tokenizer

    path, rng = queries.byte_bpe_path(), random.Random(3)
    texts = ["a" * 5001, "=" * 777, "ab" * 3000, "aaa" * 1001 + "b", "".join(rng.choices("abcdefghijklmnopqrst", k=20_000))]
    raw = [x.encode() for x in texts]
    ids, at = bpe_automaton.automaton(path).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for i, want in enumerate(Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i]:at[i + 1]].tolist() == want.ids


def test_encoding_holds_little_beside_a_batch():
    import tracemalloc

    rng, path = random.Random(7), queries.byte_bpe_path()
    bpe_automaton.automaton(path)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(60_000)]
    batch = pa.record_batch({"id": list(range(1_500)), "t": [" ".join(rng.choices(words, k=600)) for _ in range(1_500)]})
    assert batch.nbytes > 5 << 20
    tracemalloc.start()
    rows = sum(b.num_rows for b in bpe_automaton.encoded(iter([batch]), path))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_500
    assert peak < 80 << 20, peak
