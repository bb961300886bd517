"""LM scoring by subword lattice likelihood (operator 6).

The vocabulary of an existing subword tokenizer spans a lattice over every
word; each path is a segmentation. Its unigram scores start from the file's
own ranking (Zipf's law), are re-estimated once from the training words
(expected piece counts over all segmentations, forward-backward), and give each
word's marginal probability by a log-space forward recursion over the lattice.
A document's score is the sum over its words and one end symbol.

* Words are aggregated first: every distinct word of the corpus is scored once.
* Documents meet the word table in two ways: the HEAD most frequent words
  (a bounded table) are applied inside the scan, so hot words never shuffle;
  all other words join by hash, and the sums return per document row.

Training documents are those whose crc32(id as text) mod 10 is not 0; a NULL
id counts as held out. NULL and empty texts have the end symbol only. Rows are
scored one by one, repeated ids included; words are compared by 64-bit hash.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm import kernels as K
from basketlens.llm.common import saved

HEAD = 1 << 17      # words applied by a broadcast table (20 bytes a word)
ADD = 0.1           # added to every count
ZIPF = 2.7
SPACE_MARK = "▁".encode()
LOG10 = math.log(10.0)


class Pieces:
    """Byte trie of the vocabulary and the starting scores of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        rank = sorted(range(sp.get_piece_size()), key=lambda i: (-sp.get_score(i), i))
        self.log_rank = np.zeros(sp.get_piece_size())
        self.log_rank[rank] = -np.log(np.arange(len(rank)) + 1 + ZIPF)
        label: dict[bytes, int] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                label.setdefault(sp.id_to_piece(i).encode(), i)
        for i in range(sp.get_piece_size()):  # a byte piece stands in where no piece has that one byte
            if sp.is_byte(i):
                label.setdefault(bytes([int(sp.id_to_piece(i)[3:5], 16)]), i)
        self.size = sp.get_piece_size()
        self.trie = K.ByteTrie(label)

    def lattice(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of all words laid end to end: (from, to, piece, word offsets); nodes are byte positions plus one per word."""
        marked = [SPACE_MARK + w for w in words]
        n = np.array([len(w) for w in marked], np.int64)
        data = np.frombuffer(b"".join(marked), np.uint8)
        first = np.cumsum(n) - n
        shift = np.repeat(np.arange(len(n)), n)  # every word has one node more than bytes
        stop = np.repeat(first + n, n)
        live, node, k = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        src, dst, piece = [], [], []
        while len(live):
            node = self.trie.step(node, data[live + k])
            on = node > 0
            live, node = live[on], node[on]
            k += 1
            hit = np.flatnonzero(self.trie.accept[node] >= 0)
            src.append(live[hit] + shift[live[hit]])
            dst.append(live[hit] + shift[live[hit]] + k)
            piece.append(self.trie.accept[node[hit]])
            more = live + k < stop[live]
            live, node = live[more], node[more]
        return np.concatenate(src), np.concatenate(dst), np.concatenate(piece), np.append(first + np.arange(len(n)), len(data) + len(n))


def _sweep(own: np.ndarray, other: np.ndarray, weight: np.ndarray, depth: np.ndarray, total: np.ndarray) -> None:
    """total[own] = logsumexp(total[other] + weight) over the arcs, level by level of ``depth``."""
    order = np.lexsort((own, depth))
    own, other, weight, depth = own[order], other[order], weight[order], depth[order]
    level = np.flatnonzero(np.append(True, depth[1:] != depth[:-1])) if len(depth) else np.zeros(0, int)
    for lo, hi in zip(level.tolist(), np.append(level[1:], len(depth)).tolist()):
        x = total[other[lo:hi]] + weight[lo:hi]
        at = own[lo:hi]
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        top = np.maximum.reduceat(x, head)
        safe = np.where(np.isfinite(top), top, 0.0)
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
        with np.errstate(divide="ignore"):
            total[at[head]] = safe + np.log(np.add.reduceat(np.exp(x - safe[group]), head))


def marginals(pieces: Pieces, log_p: np.ndarray, words: list[bytes], counts: np.ndarray | None = None):
    """Natural-log marginal probability of each word; with ``counts`` also the expected piece counts."""
    src, dst, piece, off = pieces.lattice(words)
    w = log_p[piece]
    word = np.searchsorted(off, src, side="right") - 1
    alpha = np.full(off[-1], -np.inf)
    alpha[off[:-1]] = 0.0
    _sweep(dst, src, w, dst - off[word], alpha)
    total = alpha[off[1:] - 1]
    if counts is None:
        return total
    beta = np.full(off[-1], -np.inf)
    beta[off[1:] - 1] = 0.0
    _sweep(src, dst, w, off[word + 1] - src, beta)
    post = np.exp(alpha[src] + w + beta[dst] - total[word]) * counts[word]
    return total, np.bincount(piece, weights=post, minlength=pieces.size)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


def is_held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def _lowered(s: pa.RecordBatch):
    data, off = K.text_buffer(s.column("t"))
    data = np.take(K.LOWER, data)
    start, end, row = K.word_spans(data, off)
    return data, start, end, row, K.span_hashes(data, start, end)


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, word, c, n): every distinct lower-cased word, its count in training documents and in all."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        for b in batches:
            for s in K.batch_slices(b, "t"):
                data, start, end, row, h = _lowered(s)
                train = np.array([not is_held_out(i) for i in s.column("id").to_pylist()])
                key, at, inv = np.unique(h, return_index=True, return_inverse=True)
                c = np.bincount(inv, weights=np.repeat(train, np.diff(row)).astype(float), minlength=len(key))
                n = np.bincount(inv, minlength=len(key))
                size = end[at] - start[at]
                body = K.ragged_take(data, start[at], size)
                cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                word = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(body.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(K.to_long(key)), word, pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))],
                                                 names=["h", "word", "c", "n"])

    return (src.mapInArrow(run, "h long, word binary, c long, n long").groupBy("h")
            .agg(F.min("word").alias("word"), F.sum("c").alias("c"), F.sum("n").alias("n")))


def _blocks(batch: pa.RecordBatch, rows: int = 20_000):
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def learned_scores(words: DataFrame, model_path: str, end_count: int) -> tuple[np.ndarray, float]:
    """Natural-log piece probabilities from one pass of expected counts over the training words, and the end symbol's."""

    def run(batches):
        p = load_pieces(model_path)
        start = p.log_rank - np.log(np.exp(p.log_rank).sum())
        for b in batches:
            total = np.zeros(p.size)
            for s in _blocks(b):
                total += marginals(p, start, s.column("word").to_pylist(), s.column("c").to_numpy().astype(float))[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "n"])

    sums = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    size = load_pieces(model_path).size
    n = np.full(size + 1, ADD)
    n[sums.column("piece").to_numpy()] += sums.column("n").to_numpy()
    n[size] += end_count
    log_p = np.log(n / n.sum())
    return log_p[:size], float(log_p[size])


def _scored_words(words: DataFrame, log_p: np.ndarray, model_path: str) -> DataFrame:
    """(h, c, n, lp): log10 marginal of every distinct word."""
    shared = words.sparkSession.sparkContext.broadcast(log_p)

    def run(batches):
        p = load_pieces(model_path)
        for b in batches:
            for s in _blocks(b):
                lp = marginals(p, shared.value, s.column("word").to_pylist()) / LOG10
                yield pa.RecordBatch.from_arrays([s.column("h"), s.column("c"), s.column("n"), pa.array(lp)], names=["h", "c", "n", "lp"])

    return words.select("h", "word", "c", "n").mapInArrow(run, "h long, c long, n long, lp double")


def _partial(docs: DataFrame, head: tuple[np.ndarray, ...], id_col: str, text_col: str) -> DataFrame:
    """kind 0: a row per document with the sums over head words; kind 1: its other words (key, h, m)."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        hh, known, base, lp = shared.value
        serial = TaskContext.get().partitionId() << 40
        for b in batches:
            for s in K.batch_slices(b, "t"):
                _, start, _, row, h = _lowered(s)
                docs_n = len(row) - 1
                owner = np.repeat(np.arange(docs_n), np.diff(row))
                at = np.searchsorted(hh, h)
                at[at == len(hh)] = 0
                hit = (hh[at] == h) if len(hh) else np.zeros(len(h), bool)

                def per_doc(v, where=owner[hit]):
                    return np.bincount(where, weights=v, minlength=docs_n).astype(float)  # an empty count has integers

                key = serial + np.arange(docs_n)
                serial += docs_n
                ids = s.column("id")
                held = [is_held_out(i) for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), ids, pa.array(held), pa.array(np.diff(row)), pa.nulls(docs_n, pa.int64()), pa.array(per_doc(known[at[hit]].astype(float)).astype(np.int64)),
                     pa.array(per_doc(base[at[hit]])), pa.array(per_doc(lp[at[hit]]))],
                    names=["key", "id", "held_out", "m", "h", "known", "base", "lp"])
                o, x = owner[~hit], h[~hit]
                order = np.lexsort((x, o))
                o, x = o[order], x[order]
                first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (x[1:] != x[:-1]))) if len(o) else np.zeros(0, np.int64)
                n, pair = np.diff(np.append(first, len(o))), (o[first], K.to_long(x[first]))
                k = len(n)
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[pair[0]]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.array(n.astype(np.int64)), pa.array(pair[1]),
                         pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())],
                        names=["key", "id", "held_out", "m", "h", "known", "base", "lp"])

    return src.mapInArrow(run, "key long, id long, held_out boolean, m long, h long, known long, base double, lp double")


def score(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    words = saved(word_table(docs, id_col, text_col), "words")
    train_docs = docs.select(F.col(id_col).alias("id")).where(F.crc32(F.col("id").cast("string").cast("binary")) % 10 != 0).count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.sum((F.col("c") > 0).cast("long"))).first()
    n_train, v = int(sums[0]) + train_docs, int(sums[1] or 0) + (train_docs > 0)
    log_p, log_end = learned_scores(words, model_path, train_docs)
    scored = saved(_scored_words(words, log_p, model_path), "scored")

    top = scored.orderBy(F.col("n").desc(), "h").limit(head).toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    c = top.column("c").to_numpy()[order]
    table = (h[order], c > 0, np.log10(c + ADD) - math.log10(n_train + ADD * (v + 1)), top.column("lp").to_numpy()[order])

    rows = saved(_partial(docs, table, id_col, text_col), "partial")
    base = F.log10(F.col("c") + ADD) - math.log10(n_train + ADD * (v + 1))
    rest = (rows.where("h is not null").select("key", "h", "m").join(scored, "h")
            .groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("known2"),
                                F.sum(F.col("m") * base).alias("base2"), F.sum(F.col("m") * F.col("lp")).alias("lp2")))
    per_doc = rows.where("h is null").drop("h").join(rest, "key", "left")
    end_base = math.log10(train_docs + ADD) - math.log10(n_train + ADD * (v + 1))

    def plus(a: str, b: str):
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return per_doc.select(
        F.col("id").alias(id_col), "held_out", (F.col("m") + 1).alias("n_tokens"), (plus("known", "known2") + (1 if train_docs else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (plus("base", "base2") + end_base).alias("base_score"),
        (plus("lp", "lp2") + log_end / LOG10).alias("score"))
