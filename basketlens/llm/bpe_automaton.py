"""BPE encoding and decoding by a tokenization automaton (operator 10).

The automaton over tokens accepts exactly the merge-correct token sequences. It
is compiled by one merge gadget per rule, in rank order, from the one-state
automaton with an arc per byte. At every time all arcs with one label lead to one
state, so a state is named by its token. The gadget of rule u v:

* the state reached by u loses its arc v (the pair would have been merged);
* each state with an arc u gets an arc uv beside it, which leads to a new
  state, a copy of the one that v leads to at this time.

The second step is not written out arc by arc. Tokens are numbered so that those
that grow out of l to the right stand before l, in rank order: a state that loses
l at rank r never gets the tokens that grow out of l from r on, and these and l
form one interval. A state thus is a list of intervals of missing arcs; a copy
takes over the intervals found so far. The table holds all states' disjoint
intervals in order, and one binary search tells whether an arc exists.

Encoding splits a text into pieces (contractions, optional blank + letters,
digits or other marks, white space) and runs each distinct piece through the table
once, byte by byte and without stepping back: each prefix has one accepted
sequence, whose last arc is the one token, of those that end at this byte, with an
arc from the state before it. The arcs are then read off from the end. Decoding
emits the byte labels of the arcs. Runs in one narrow pass over whole texts.

A file with settings other than plain byte-level merges is refused. NULL or empty
text gives no ids and an empty decoded text. The special string of the vocabulary
becomes its own id. Nothing else depends on other rows or columns; repeated rows
give repeated results.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm import kernels as K

LONG_PIECE = 96  # bytes; longer pieces are walked one by one
SLICE_BYTES = 1 << 20  # text bytes encoded at once: the working arrays take about 40 times as much in every worker
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points of white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_settings(spec: dict) -> None:
    """Raises ValueError for a file whose rules are not those built here."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k in ("lstrip", "rstrip", "single_word", "normalized") if any(x.get(k) for x in spec["added_tokens"])]
    if model["type"] != "BPE" or odd or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"only plain byte-level BPE files are supported; found {model['type']}, {odd}, {spec.get('normalizer')}, {pre}")


class MergeTable:
    """Compiled automaton: ``order`` of the tokens, and the missing arcs of all states as sorted disjoint intervals."""

    def __init__(self, base: list[int], rules: list[tuple[int, int, int]], n: int):
        grown = [1] * n
        for u, _, uv in reversed(rules):
            grown[u] += grown[uv]
        nxt, own, missing, at = [0] * n, [0] * n, [[] for _ in range(n)], 0
        for b in base:
            nxt[b], own[b] = at, at + grown[b] - 1
            at += grown[b]
        for u, v, uv in rules:
            first = nxt[v]                        # tokens that grow out of v from this rank on start here
            missing[uv] = missing[v].copy()       # new state, as the one v leads to
            nxt[uv] = nxt[u]
            nxt[u] += grown[uv]
            own[uv] = nxt[u] - 1
            missing[u].append(first * n + own[v])  # the state of u loses them
        count = np.array([len(x) for x in missing], np.int64)
        flat = np.fromiter((x for row in missing for x in row), np.int64, int(count.sum()))
        del missing
        state = np.repeat(np.arange(n, dtype=np.int64) * n, count)
        low, high = state + flat // n, state + flat % n
        by = np.argsort(low, kind="stable")
        low, high = low[by], np.maximum.accumulate(high[by])
        head = np.ones(len(low), bool)
        head[1:] = low[1:] > high[:-1] + 1
        # the end of a run of touching intervals is the running maximum at its last member
        last = np.append(np.flatnonzero(head)[1:] - 1, len(low) - 1) if len(low) else np.zeros(0, np.int64)
        # intervals of neighbouring states may touch; a run across states still means the same missing arcs
        self.n, self.order = n, np.array(own, np.int64)
        self.low, self.high = np.append(-1, low[head]), np.append(-1, high[last])

    def has(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for the token; state n is the start and has all."""
        key = state * self.n + self.order[token]
        return self.high[np.searchsorted(self.low, key, side="right") - 1] < key


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        rules = [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]
        base = [vocab[c] for c in alphabet if c in vocab]
        used = base + [uv for _, _, uv in rules]
        if len(base) < 256 or len(set(used)) < len(used):
            raise ValueError("every byte must be a token, and every token the result of one rule")
        names = {i: t for t, i in vocab.items()}
        token = {bytes(alphabet[c] for c in names[i]): i for i in used}
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        label = {i: b for b, i in token.items()} | {i: t for t, i in self.special.items()}
        n = max(label) + 1
        self.table = MergeTable(base, rules, n)
        self.shorter = np.full(n, -1, np.int64)  # next shorter token that ends on the same bytes
        for b, i in token.items():
            for k in range(1, len(b)):
                if (s := token.get(b[k:])) is not None:
                    self.shorter[i] = s
                    break
        self.trie = K.ByteTrie({b[::-1]: i for b, i in token.items()})
        size = np.array([len(label.get(i, b"")) for i in range(n)], np.int64)
        self.flat = np.frombuffer(b"".join(label.get(i, b"") for i in range(n)), np.uint8)
        self.size, self.label_at = size, np.cumsum(size) - size

    def _longest(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Longest token that ends with each byte and starts at ``first`` or later."""
        best = np.zeros(len(data), np.int64)
        live = np.arange(len(data))
        node = np.zeros(len(data), np.int64)
        k = 0
        while len(live):
            node = self.trie.step(node, data[live - k])
            on = node > 0
            live, node = live[on], node[on]
            end = self.trie.accept[node]
            hit = end >= 0
            best[live[hit]] = end[hit]
            k += 1
            more = live - k >= first[live]
            live, node = live[more], node[more]
        return best

    def _last_arcs(self, best: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each byte, the last arc of the accepted sequence that ends there; pieces in step, one byte a turn."""
        start, size, shorter, last = self.table.n, self.size, self.shorter, best
        by = np.argsort(-n, kind="stable")
        first, n = first[by], n[by]
        together = int(np.searchsorted(-n, -LONG_PIECE, side="left"))  # pieces of more bytes come first
        for a, m in zip(first[:together].tolist(), n[:together].tolist()):
            self._walk_one(last, a, m)
        first, n = first[together:], n[together:]
        alive = np.searchsorted(-n, -np.arange(1, int(n.max(initial=0)) + 1), side="right")
        for k, m in enumerate(alive.tolist()):
            at, head = first[:m] + k, first[:m]
            while len(at):
                t = last[at]
                before = at - size[t]
                state = np.where(before < head, start, last[before])
                no = ~self.table.has(state, t)
                at, head = at[no], head[no]
                last[at] = shorter[t[no]]
        return last

    def _walk_one(self, last: np.ndarray, a: int, m: int) -> None:
        table, size, shorter = self.table, self.size, self.shorter
        low, high, order, n = table.low, table.high, table.order, table.n
        for i in range(a, a + m):
            t = last[i]
            while (before := i - size[t]) >= a:
                key = last[before] * n + order[t]
                if high[low.searchsorted(key, side="right") - 1] < key:
                    break
                t = shorter[t]
            last[i] = t

    def walk_all(self, data: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces laid end to end in ``data`` (lengths ``n``): (ids, ids of each piece)."""
        first = np.cumsum(n) - n
        last = self._last_arcs(self._longest(data, np.repeat(first, n)), first, n)
        arc = np.zeros(len(data), bool)  # bytes with which an arc of the path ends
        at, head = (first + n - 1)[n > 0], first[n > 0]
        while len(at):
            arc[at] = True
            at = at - self.size[last[at]]
            on = at >= head
            at, head = at[on], head[on]
        c = np.concatenate([[0], np.cumsum(arc)])
        return last[arc], c[first + n] - c[first]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, id offsets of the rows)."""
        start, row = split_pieces(data, off, list(self.special))
        size = np.diff(start, append=len(data))
        _, at, inv = np.unique(K.span_hashes(data, start, start + size), return_index=True, return_inverse=True)
        size, start = size[at], start[at]
        body = size.copy()
        special = {}
        for s, i in self.special.items():
            for p in np.flatnonzero(size == len(s)):
                if data[start[p]:start[p] + size[p]].tobytes() == s:
                    special[p] = i
                    body[p] = 0
        ids, n = self.walk_all(K.ragged_take(data, start, body), body)
        if special:
            where = np.array(list(special))
            ids = np.insert(ids, (np.cumsum(n) - n)[where], list(special.values()))
            n[where] = 1
        n_all = n[inv]
        c = np.concatenate([[0], np.cumsum(n_all)])
        return K.ragged_take(ids, (np.cumsum(n) - n)[inv], n_all), c[row]

    def decode(self, ids: np.ndarray, id_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, byte offsets of the rows)."""
        n = self.size[ids]
        c = np.concatenate([[0], np.cumsum(n)])
        return K.ragged_take(self.flat, self.label_at[ids], n), c[id_off]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kind[cp] = LETTER
        elif c == "N":
            kind[cp] = NUMBER
    kind[WHITE] = SPACE
    return kind


def split_pieces(data: np.ndarray, off: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pieces, and for each row the index of its first piece (one more entry at the end).

    The pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|blank+(?!not blank)|blank+``,
    with special strings cut out first.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    raw = data.tobytes()
    head = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[cp]
    border = np.zeros(len(cp) + 1, bool)  # starts of rows and of special strings, and what follows those
    border[np.searchsorted(head, off)] = True
    fixed = []
    for s in special:
        at = raw.find(s)
        while at >= 0:
            row = int(np.searchsorted(off, at, side="right")) - 1
            if at + len(s) <= off[row + 1]:
                a, b = np.searchsorted(head, [at, at + len(s)])
                border[[a, b]] = True
                fixed.append((a, b))
                at = raw.find(s, at + len(s))
            else:
                at = raw.find(s, at + 1)
    n = len(cp)
    cut = border[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    nxt = np.append(border[1:n] | False, True)        # a border follows
    last_blank = (kind == SPACE) & ~nxt
    last_blank[:-1] &= kind[1:] != SPACE
    last_blank[-1] = False
    blank = last_blank & (cp == 0x20)
    joined = np.flatnonzero(blank) + 1                 # a single blank leads the next piece
    cut[joined] = False
    cut[last_blank] = True
    q = np.flatnonzero((cp == 0x27) & cut & ~nxt)
    if len(q):
        pad = np.append(cp, [0, 0, 0])
        a, b = pad[q + 1], pad[q + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        two &= ~border[np.minimum(q + 2, n)]
        for mask, k in ((one, 1), (two & ~one, 2)):
            at = q[mask]
            cut[at + 1] = False
            tail = at + 1 + k
            cut[tail[tail < n]] = True
    for a, b in fixed:
        cut[a + 1:b] = False
    start = head[cut]
    return start, np.searchsorted(start, off)


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    """(id, n_tokens, ids, decoded) of batches (id, t), one output batch per slice of ``SLICE_BYTES``."""
    auto = automaton(tokenizer_path)
    for batch in batches:
        for s in K.batch_slices(batch, "t", SLICE_BYTES):
            data, off = K.text_buffer(s.column("t"))
            ids, at = auto.encode(data, off)
            text, to = auto.decode(ids, at)
            rows = range(len(off) - 1)
            yield pa.RecordBatch.from_arrays(
                [s.column("id"), pa.array(np.diff(at)), pa.array([ids[at[i]:at[i + 1]].astype("<u4").tobytes() for i in rows], pa.binary()),
                 pa.array([text[to[i]:to[i + 1]].tobytes().decode("utf-8", "replace") for i in rows], pa.string())],
                names=["id", "n_tokens", "ids", "decoded"])


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, n_tokens, ids, decoded); ids are little-endian unsigned 32-bit integers."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = src.mapInArrow(lambda batches: encoded(batches, tokenizer_path), f"id {src.schema[0].dataType.simpleString()}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
