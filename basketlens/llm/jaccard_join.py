"""N-gram Jaccard join (operator 4): blocked sparse product of document by n-gram incidence.

Two documents link when ``100 * |A and B| >= 75 * |A or B|`` over their sets of
distinct 5-word shingles (A-Z lower-cased; a text of 1 to 4 words has its whole
word sequence as one shingle; without words the set is empty and links with
nothing). The result is exact.

* **Incidence rows.** One pass per document turns the text into sorted 64-bit
  shingle hashes. Documents with equal sets form one class, represented by one
  signature, so thousands of copies weigh as one row of the matrix.
* **Column blocks and size-derived bounds.** Only the part of a row that a
  partner must meet is multiplied: with shingles in one global order (shingles
  seen often last, then by hash), two linked sets share one of their first
  ``n - ceil(0.75 n) + 1`` entries. The postings are partitioned by shingle and
  sorted, so a posting list is streamed, never held. A pair counts only where
  ``min(n_a - i, n_b - j) >= 3/7 (n_a + n_b)`` for its positions i, j, the
  largest overlap that is still possible there.
* **Parity bound.** A class carries a bitmap of the parity of its shingle
  slots, two to four bits a shingle. Common shingles cancel, so the bits in
  which two bitmaps differ (the longer one folded) bound the symmetric
  difference from below, and a pair with ``7 * differing bits > n_a + n_b``
  cannot link. Only pairs that pass have their whole rows moved.
* **No all-pairs emission.** For components, each list first
  emits one pair per row, with its pivot; verified links contract the
  documents, and later rounds emit only pairs of a row with one of ``PIVOTS``
  pivots in another component, other pivots in each list and round. The pairs of different components that could
  still meet are counted, not made; rounds go on while each cuts that
  count by a quarter and it exceeds the rows. The last round emits what is left of them and what the bounds on
  sizes, positions and parity allow, so no link between different texts is lost.
* **Accumulated overlap.** Surviving pairs get their exact overlap from the two
  whole shingle rows, first one pair per row, then the pairs that are still of
  different components. The rows of classes in shared lists are stored where
  their texts are scanned; a round shuffles only those of its promising pairs.
  They are arrays that Spark intersects, so no Python worker receives their pairs.
* **Link counts.** Contraction leaves pairs inside a component untested, so
  links are counted after it: a component's classes are cut into blocks by set
  size and hash, and every two blocks whose sizes allow a link are multiplied
  as gram by row matrices that accumulate the overlap of all their pairs. A task
  holds two bounded blocks and gives one count per row, never a pair. A partner
  class weighs its copies, and the class's own other copies are added.

The order only affects cost: a fixed-size bitmap (``FREQ_BITS``) marks shingles
that batches of documents repeat, and a wrong mark changes no result. Shingles
are compared as 64-bit hashes.

A set is identified by 128 bits: the key of a class is its first 64-bit digest,
and where sets of different second digests or sizes share that (a short list,
bounded by ``MAX_CLASHES``), both digests combined.

NULL and empty texts: ``n_shingles`` 0, own component. NULL ids keep their row;
the component is the smallest non-NULL id. Repeated rows link with each other.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.llm import kernels as K
from basketlens.llm.common import batch_rows, components, new_names, partitions, saved, shared_path

WORDS = 5
THRESHOLD_PCT = 75
TEXT_ROWS = 1000     # texts or whole shingle rows sent to Python in one batch
LIST_ROWS = 4000     # texts sent to Python and postings streamed in one batch
SLICE_BYTES = 1 << 20  # text bytes turned into sets at once: the working arrays take some 30 times as much in every worker
FREQ_BITS = 1 << 23  # bits of the frequent-shingle bitmap: 1 MB, whatever the corpus
SEEN_BITS = 1 << 25  # bits that remember the shingles of the documents of a report: 4 MB
REPORT_ROWS = 10_000  # documents whose repeated shingles are reported together
LOCAL_MIN = 3        # documents of them that must share a shingle to report it
FREQ_MIN = 16        # reported documents from which a shingle is ordered last
SUM_BITS = 64        # bits of the first digest that are used; tests take few, so that different sets share it
MAX_CLASHES = 100_000  # first digests that different sets may share; more raise
PIVOTS = 4           # rows of a list that the others meet in a later round
PARITY_BITS = 1024   # least bits of a parity bitmap
FOLDED = 4           # 64-bit words to which the last round folds it
BLOCK_ROWS = 256     # classes of one block of the link count
BLOCK_SHINGLES = 1 << 19  # shingles of one block
BLOCK_COLUMNS = 4096      # shingles multiplied at once
BAND = 1.4           # ratio of set sizes in one block; linked sets differ by 4/3 at most

_FOLDS = [f"f{i}" for i in range(FOLDED)]
_DIGEST = ["kind", "id", "n", "s1", "s2", *_FOLDS, "bits"]


def shingle_sets(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, off = K.text_buffer(texts)
    data = K.LOWER[data]
    start, end, row = K.word_spans(data, off)
    h = K.span_hashes(data, start, end)
    w, at = K.window_hashes(h, row, k)
    cut = np.searchsorted(at, row)
    out = []
    for i in range(len(off) - 1):
        n = row[i + 1] - row[i]
        if n >= k:
            out.append(np.unique(w[cut[i]:cut[i + 1]]))
        elif n:
            out.append(K.window_hashes(h[row[i]:row[i + 1]], np.array([0, n]), int(n))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    a = K.mix64(s + np.uint64(0x1B873593))
    b = K.mix64(s ^ np.uint64(0xCC9E2D51CC9E2D51))
    return int(a.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(b, initial=np.uint64(0))) ^ len(s)


def class_key(s: np.ndarray, clashes: frozenset, bits: int) -> int:
    """Key of the set's class; ``clashes`` are first digests that different sets share."""
    one, two = signature(s)
    one &= (1 << bits) - 1
    return one ^ two if one in clashes else one


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap (64-bit words): bit k is the number of shingles of slot k, modulo 2; a power of two of bits, 2 a shingle at least."""
    m = max(PARITY_BITS, 1 << (2 * len(s) - 1).bit_length() if len(s) else 0)
    slot = (K.mix64(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(m - 1)).astype(np.int64)
    odd = (np.bincount(slot, minlength=m) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of ``words`` words that the same set has."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _digests(batches, bits_used: int):
    """The rows of ``_digest_rows`` of batches (id, t); of first digests the lowest ``bits_used`` bits."""
    seen, earlier, n_rows = [], None, 0
    for b in batches:
        for s in K.batch_slices(b, "t", SLICE_BYTES):
            sets = shingle_sets(s.column("t"))
            sig = [signature(x) for x in sets]
            sig = [(a & (1 << bits_used) - 1, c) for a, c in sig]
            bits = [parity(x) for x in sets]
            short = np.array([fold(x, FOLDED) for x in bits], np.int64).reshape(len(sets), FOLDED)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int32)), s.column("id"), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([_signed(a) for a, _ in sig], pa.int64()), pa.array([_signed(c) for _, c in sig], pa.int64()),
                 *[pa.array(short[:, i]) for i in range(FOLDED)], pa.array([x.tobytes() for x in bits], pa.binary())], names=_DIGEST)
            # Only shingles that a slice repeats, or that an earlier slice seems to hold, are kept until the next
            # report: the bitmap made of them is an order of rarity, any subset serves.
            if earlier is None:
                earlier = np.zeros(SEEN_BITS // 64, np.uint64)  # slots of the shingles of earlier slices
            g, c = np.unique(np.concatenate(sets), return_counts=True)
            slot = g & np.uint64(SEEN_BITS - 1)
            word, bit = (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63))
            again = (c > 1) | (earlier[word] & bit > 0)
            np.bitwise_or.at(earlier, word, bit)
            seen.append((g[again], c[again]))
            n_rows += len(sets)
            if n_rows >= REPORT_ROWS:
                yield from _report(seen)
                seen, earlier, n_rows = [], None, 0
    yield from _report(seen)


def _report(seen: list):
    """The shingles that LOCAL_MIN documents or more repeat, of (shingles, counts) per slice."""
    if not seen:
        return
    g, where = np.unique(np.concatenate([x for x, _ in seen]), return_inverse=True)
    c = np.bincount(where, weights=np.concatenate([x for _, x in seen]), minlength=len(g)).astype(np.int64) + 1
    g, c = g[c >= LOCAL_MIN], c[c >= LOCAL_MIN]
    if len(g):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(g), np.int32)), pa.nulls(len(g), pa.int64()), pa.array(c.astype(np.int64)),
             pa.array(K.to_long(g)), *[pa.nulls(len(g), pa.int64())] * (FOLDED + 1), pa.nulls(len(g), pa.binary())], names=_DIGEST)


def _digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """kind 0: one row per document (id, n, s1, s2, folded parity words, bits); kind 1: shingles that neighbouring documents repeat (s1, n)."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return src.mapInArrow(lambda batches: _digests(batches, SUM_BITS), ", ".join(["kind int", *[f"{c} long" for c in _DIGEST[1:-1]], "bits binary"]))


def _grouped(digests: DataFrame, key) -> DataFrame:
    """(sig, rep, copies, n, folded parity words, bits, clash): one row per key, rep the smallest id; clash: several sets have it."""
    return (digests.where("kind = 0 and n > 0").groupBy(key.alias("sig"))
            .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *[F.min(c).alias(c) for c in ["n", *_FOLDS, "bits"]],
                 ((F.min("s2") < F.max("s2")) | (F.min("n") < F.max("n"))).alias("clash")))


def _classes(digests: DataFrame) -> tuple[DataFrame, frozenset, DataFrame]:
    """Classes (``_grouped`` without a clash), the first digests that different sets share, and one row per document (id, n, s1, s2, key)."""
    key = F.col("s1")
    classes = saved(_grouped(digests, key), "classes")
    found = [r.sig for r in classes.where("clash").select("sig").limit(MAX_CLASHES + 1).collect()]
    if len(found) > MAX_CLASHES:
        raise RuntimeError(f"different shingle sets share more than {MAX_CLASHES} digests")
    if found:
        shared = F.broadcast(classes.where("clash").select(F.col("sig").alias("s1"), F.lit(True).alias("shared")))
        digests = digests.join(shared, "s1", "left")
        key = F.when(F.col("shared"), F.col("s1").bitwiseXOR(F.col("s2"))).otherwise(F.col("s1"))
        classes = saved(_grouped(digests, key), "classes")
        if not classes.where("clash").isEmpty():
            raise RuntimeError("different shingle sets share both digests")
    keyed = digests.where("kind = 0").select("id", "n", "s1", "s2", key.alias("key"))
    return classes.drop("clash"), frozenset(x & (1 << 64) - 1 for x in found), keyed


def _frequent_bitmap(rows: DataFrame) -> np.ndarray:
    """Bitmap of every shingle reported FREQ_MIN times."""
    often = rows.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQ_MIN)
    return _bitmap(often, F.col("s1"))


def _bitmap(rows: DataFrame, key) -> np.ndarray:
    """Bitmap of FREQ_BITS bits, set at the slot of every key."""
    words = (rows.select(key.bitwiseAND(F.lit(FREQ_BITS - 1)).alias("slot"))
             .groupBy((F.col("slot") / 64).cast("int").alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toArrow())
    bitmap = np.zeros(FREQ_BITS // 64, np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _prefix(s: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    n = len(s)
    keep = n - -(-THRESHOLD_PCT * n // 100) + 1
    slot = s & np.uint64(FREQ_BITS - 1)
    often = (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
    return np.concatenate([s[often == 0], s[often == 1]])[:keep]


def _postings(docs: DataFrame, text_col: str, bitmap: np.ndarray, clashes: frozenset) -> DataFrame:
    """(gram, sig, np): the bounded part of every incidence row; np = set size * 2^31 + position."""
    src = docs.select(F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        seen = set()  # classes this task has already emitted: a group of copies weighs once per task
        for b in batches:
            for s in K.batch_slices(b, "t", SLICE_BYTES):
                g, sig, size = [], [], []
                for x in shingle_sets(s.column("t")):
                    own = class_key(x, clashes, SUM_BITS)
                    if len(x) and own not in seen:
                        seen.add(own)
                        p = _prefix(x, shared.value)
                        g.append(p)
                        sig.append(np.full(len(p), own, np.uint64))
                        size.append((np.int64(len(x)) << np.int64(31)) + np.arange(len(p)))
                if g:
                    yield pa.RecordBatch.from_arrays([pa.array(K.to_long(np.concatenate(g))), pa.array(K.to_long(np.concatenate(sig))),
                                                      pa.array(np.concatenate(size))], names=["gram", "sig", "np"])

    return src.mapInArrow(run, "gram long, sig long, np long")


def _possible(n_a, i, n_b, j):
    """Size-derived bound: the overlap that positions i, j still allow reaches the threshold."""
    need = 3 * (n_a + n_b)
    return (7 * (n_a - i) >= need) & (7 * (n_b - j) >= need)


_LOW = np.int64((1 << 31) - 1)


def _first_round(batches):
    """Streams postings sorted by (gram, order of the pivot): pairs with the pivot, and rows of lists of three or more.

    A list that ends inside the batch is judged exactly; one that crosses a
    batch border is kept whole.
    """
    gram = pivot = last = None
    for b in batches:
        g, s, x = (b.column(i).to_numpy() for i in range(3))
        if len(g) == 0:
            continue
        same = np.zeros(len(g), bool)
        same[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
        same[0] = gram is not None and g[0] == gram and s[0] == last
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        ps, px = s[start][run], x[start][run]
        carried = gram is not None and g[0] == gram
        if carried:
            ps = np.where(run == 0, pivot[0], ps)
            px = np.where(run == 0, pivot[1], px)
        n, i, m, j = x >> 31, x & _LOW, px >> 31, px & _LOW
        ok = (s != ps) & ~same & _possible(n, i, m, j)
        pairs = np.unique(np.stack([np.minimum(s, ps)[ok], np.maximum(s, ps)[ok]]), axis=1)
        keep = np.zeros(len(g), bool)
        live = ~same
        count = np.bincount(run[live], minlength=len(start))
        for r in np.flatnonzero(count >= 3):
            lo, hi = start[r], start[r + 1] if r + 1 < len(start) else len(g)
            at = lo + np.flatnonzero(live[lo:hi])
            if len(at) <= 256:
                nn, ii = n[at], i[at]
                fit = _possible(nn[:, None], ii[:, None], nn[None, :], ii[None, :])
                np.fill_diagonal(fit, False)
                at = at[fit.any(axis=1)]
            keep[at] = True
        for r in {0, len(start) - 1}:
            lo, hi = start[r], start[r + 1] if r + 1 < len(start) else len(g)
            if (r == 0 and carried) or r == len(start) - 1:
                keep[lo:hi] = live[lo:hi]
        k = int(keep.sum())
        gram, last, pivot = g[-1], s[-1], (ps[-1], px[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.zeros(pairs.shape[1], np.int64), g[keep]], mask=np.r_[np.ones(pairs.shape[1], bool), np.zeros(k, bool)]),
             pa.array(np.r_[pairs[0], s[keep]]), pa.array(np.r_[pairs[1], x[keep]])], names=["gram", "a", "b"])


def _later_round(batches):
    """Streams (gram, sig, np, comp) sorted by gram: pairs of a row with its list's first PIVOTS rows in another component."""
    carry = None
    for b in batches:
        rows = np.stack([b.column(i).to_numpy() for i in range(4)])
        if rows.shape[1] == 0:
            continue
        if carry is not None and rows[0, 0] == carry[0, 0]:
            rows = np.concatenate([carry, rows], axis=1)
        g, s, x, c = rows
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        start = np.flatnonzero(new)
        first = start[np.cumsum(new) - 1]
        found = []
        for q in range(PIVOTS):
            at = np.flatnonzero(np.arange(len(g)) - first > q)
            p = first[at] + q
            ok = (c[at] != c[p]) & _possible(x[at] >> 31, x[at] & _LOW, x[p] >> 31, x[p] & _LOW)
            found.append(np.stack([np.minimum(s[at], s[p])[ok], np.maximum(s[at], s[p])[ok]]))
        carry = rows[:, start[-1]:start[-1] + PIVOTS]
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _linked():
    """Whether the exact overlap of the whole rows ``ra`` and ``rb`` reaches the threshold; counted by Spark, rows never go to Python."""
    common = F.size(F.array_intersect("ra", "rb"))
    return 100 * common >= THRESHOLD_PCT * (F.size("ra") + F.size("rb") - common)


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links among ``pairs(a, b)`` by the exact overlap of their whole rows.

    The row table is bucketed, so only rows that take part are shuffled; both
    joins are plain shuffle joins whose hot keys the engine can split.
    """
    part = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select(F.col("b").alias("sig"))).distinct()
    own = rows.join(part, "sig", "left_semi")
    left = own.select(F.col("sig").alias("a"), F.col("row").alias("ra"))
    right = own.select(F.col("sig").alias("b"), F.col("row").alias("rb"))
    return pairs.join(left, "a").join(right, "b").where(_linked()).select("a", "b").distinct()


def _row_store(docs: DataFrame, classes: DataFrame, part: DataFrame, id_col: str, text_col: str, clashes: frozenset) -> DataFrame:
    """Whole shingle rows (sig, row) of the classes ``part(sig)``, written where their texts are scanned: nothing is shuffled.

    A fixed-size bitmap of (class, smallest id) picks the documents in the
    scan. A full bitmap only lets more rows through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        _bitmap(classes.select("sig", "rep").join(part, "sig", "left_semi"), F.col("sig").bitwiseXOR(F.coalesce("rep", F.lit(0).cast("long")))))
    mask = FREQ_BITS - 1

    def run(batches):
        seen = set()
        for b in batches:
            for s in K.batch_slices(b, "t", SLICE_BYTES):
                sig, rows = [], []
                for x, i in zip(shingle_sets(s.column("t")), s.column("id").to_pylist()):
                    own = class_key(x, clashes, SUM_BITS)
                    slot = (own ^ (i or 0)) & mask
                    if len(x) and own not in seen and int(shared.value[slot >> 6]) >> (slot & 63) & 1:
                        seen.add(own)
                        sig.append(_signed(own))
                        rows.append(K.to_long(x))
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                row = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows or [np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), row], names=["sig", "row"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        return saved(src.mapInArrow(run, "sig long, row array<long>"), "rows")


def _whole_rows(store: DataFrame, part: DataFrame) -> str:
    """Writes the rows (sig, row) of the classes ``part(sig)`` as a bucketed table; returns its name.

    Rows are picked from the store by a bitmap of fixed size, so only rows of
    these classes (and few others) are shuffled.
    """
    spark = store.sparkSession
    n_parts = partitions(spark)
    shared = spark.sparkContext.broadcast(_bitmap(part, F.col("sig")))

    def pick(batches):
        for b in batches:
            slot = b.column(0).to_numpy() & np.int64(FREQ_BITS - 1)
            on = (shared.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            yield b.filter(pa.array(on == 1))

    table = f"shingle_rows_{uuid.uuid4().hex}"
    with batch_rows(spark, TEXT_ROWS):
        (store.mapInArrow(pick, store.schema).repartition(n_parts, "sig").dropDuplicates(["sig"])
         .write.bucketBy(n_parts, "sig").sortBy("sig").option("path", shared_path(spark, table)).saveAsTable(table))
    return table


def _differing(left: list, right: list):
    """Number of bits in which two bitmaps differ."""
    total = F.lit(0)
    for x, y in zip(left, right):
        total = total + F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    return total


def _parity_allows(batches):
    """The pairs whose parity bitmaps, the longer one folded, allow a link."""
    for b in batches:
        left, right = b.column(2), b.column(3)
        n = b.column(4).to_numpy()
        keep = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            x = np.frombuffer(left[i].as_buffer(), np.int64)
            y = np.frombuffer(right[i].as_buffer(), np.int64)
            words = min(len(x), len(y))
            bits = np.bitwise_count((fold(x, words) ^ fold(y, words)).view(np.uint64))
            keep[i] = 7 * int(bits.sum()) <= n[i]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose parity bitmaps allow a link."""
    ends = [classes.select(F.col("sig").alias(e), F.col("n").alias(f"n_{e}"), F.col("bits").alias(f"bits_{e}")) for e in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b")
    return both.select("a", "b", "bits_a", "bits_b", F.expr("n_a + n_b")).mapInArrow(_parity_allows, "a long, b long")


def _one_each(pairs: DataFrame) -> DataFrame:
    """One pair of every row, with its partner of the smallest hash."""
    ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    best = ends.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m"))
    return best.select(F.least("u", "m.v").alias("a"), F.greatest("u", "m.v").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of different components."""
    for e in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}")), e, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) after further links: only roots that a new link joins are searched again."""
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("root").alias("__root"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("__root", end)).drop("__root")
    moved = saved(components(links), "moved").select(F.col("node").alias("was"), F.col("root").alias("now"))
    kept = labels.join(moved, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    fresh = moved.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return saved(kept.unionByName(fresh), "labels")


def _left_over(known: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of ``known(gram, sig, np, comp)`` that share a list and that components, sizes, positions and folded parity allow."""
    known = known.join(classes.select("sig", *_FOLDS), "sig")
    other = known.select("gram", *[F.col(c).alias(f"{c}2") for c in ("sig", "np", "comp", *_FOLDS)])
    n, i = F.expr("shiftright(np, 31)"), F.expr(f"np & {int(_LOW)}L")
    m, j = F.expr("shiftright(np2, 31)"), F.expr(f"np2 & {int(_LOW)}L")
    bits = _differing(_FOLDS, [f"{f}2" for f in _FOLDS])
    return (known.join(other, (known["gram"] == other["gram"]) & (F.col("sig") < F.col("sig2")) & (F.col("comp") != F.col("comp2"))
                       & _possible(n, i, m, j) & (7 * bits <= n + m))
            .select(F.col("sig").alias("a"), F.col("sig2").alias("b")).distinct())


def _pairs_left(known: DataFrame) -> tuple[float, float]:
    """Number of pairs of ``known(gram, comp)`` that share a list but not a component; number of rows."""
    sizes = known.groupBy("gram", "comp").agg(F.count("*").cast("double").alias("k"))
    lists = sizes.groupBy("gram").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    pairs = F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2)
    return tuple(lists.agg(F.coalesce(pairs, F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first())


def gram_product(rows: list[np.ndarray], cut: int) -> np.ndarray:
    """Overlap of each of the first ``cut`` rows with each of the others; of all rows with each other if there are no others."""
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    _, inv, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = count > 1
    live = shared[inv]
    owner, column = owner[live], (np.cumsum(shared) - 1)[inv[live]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    right = slice(cut, None) if cut < len(rows) else slice(None)
    total = np.zeros((cut, len(rows) - cut or cut), np.int64)
    for lo in range(0, int(shared.sum()), BLOCK_COLUMNS):
        at = slice(*np.searchsorted(column, [lo, lo + BLOCK_COLUMNS]))
        m = np.zeros((len(rows), BLOCK_COLUMNS), np.float32)
        m[owner[at], column[at] - lo] = 1
        total += (m[:cut] @ m[right].T).astype(np.int64)
    return total


def _block_links(t: pa.Table) -> pa.Table:
    """Links of two blocks, or inside one: (sig, other documents linked). One unit of ``_link_counts``."""
    first = {c: t.column(c)[0].as_py() for c in ("pb", "ph", "qb", "qh")}
    one = (first["pb"], first["ph"]) == (first["qb"], first["qh"])
    in_left = (t.column("band").to_numpy() == first["pb"]) & (t.column("h").to_numpy() == first["ph"])
    t = t.take(pa.array(np.argsort(~in_left, kind="stable")))
    cut = int(in_left.sum())
    none = pa.table({"sig": pa.array([], pa.int64()), "extra": pa.array([], pa.int64())})
    if cut == 0 or (cut == t.num_rows and not one):
        return none
    rows = [x.values.to_numpy().view(np.uint64) for x in t.column("row")]
    n, copies = t.column("n").to_numpy(), t.column("copies").to_numpy()
    right = slice(None) if one else slice(cut, None)
    common = gram_product(rows, cut)
    linked = 100 * common >= THRESHOLD_PCT * (n[:cut, None] + n[None, right] - common)
    if one:
        np.fill_diagonal(linked, False)
        extra = linked @ copies
    else:
        extra = np.r_[linked @ copies[right], linked.T @ copies[:cut]]
    return pa.table({"sig": t.column("sig"), "extra": pa.array(extra, pa.int64())}).filter(pa.array(extra > 0))


def _link_counts(classes: DataFrame, labels: DataFrame, store: DataFrame) -> DataFrame:
    """(sig, n_links): every other document whose set links with the class's, its own copies included.

    Links lie inside components. A component of two classes has its one link; in
    larger ones every pair of blocks that sizes allow is one unit.
    """
    own = saved(classes.select("sig", "n", "copies", F.floor(F.log("n") / math.log(BAND)).alias("band"))
                .join(labels.withColumnRenamed("node", "sig"), "sig"), "members")
    sizes = saved(own.groupBy("root", "band").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"), F.sum("copies").alias("docs")), "sizes")
    whole = sizes.groupBy("root").agg(F.sum("k").alias("k"), F.sum("docs").alias("docs"))
    couples = own.join(whole.where("k = 2").select("root", "docs"), "root").select("sig", (F.col("docs") - F.col("copies")).alias("extra"))

    grid = saved(sizes.join(whole.where("k > 2").select("root"), "root", "left_semi").select("root", "band", F.greatest(
        F.ceil(F.col("k") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("nb")), "grid")
    for name, step in (("above", 1), ("below", -1)):
        near = grid.select("root", (F.col("band") - step).alias("band"), F.col("nb").alias(name))
        grid = grid.join(near, ["root", "band"], "left")
    unit = "named_struct('pb', {}, 'ph', {}, 'qb', {}, 'qh', {})".format
    each = "if({0} is null, array(), transform(sequence(1L, {0}), x -> {1}))".format
    units = F.expr("explode(concat({}, {}, {}))".format(
        f"transform(sequence(1L, nb), x -> {unit('band', 'least(x - 1, h)', 'band', 'greatest(x - 1, h)')})",
        each("above", unit("band", "h", "band + 1", "x - 1")), each("below", unit("band - 1", "x - 1", "band", "h"))))
    placed = own.join(grid, ["root", "band"]).withColumn("h", F.expr("pmod(xxhash64(sig, 7), nb)"))
    placed = placed.select("sig", "n", "copies", "root", "band", "h", units.alias("u")).select("*", "u.*").drop("u")
    larger = own.join(whole.where("k > 2").select("root"), "root", "left_semi").select("sig")
    table = _whole_rows(store, larger)
    counted = (placed.join(store.sparkSession.table(table), "sig").groupBy("root", "pb", "ph", "qb", "qh")
               .applyInArrow(_block_links, "sig long, extra long"))
    extra = couples.unionByName(counted).groupBy("sig").agg(F.sum("extra").alias("extra"))
    out = saved(classes.select("sig", "copies").join(extra, "sig", "left").select(
        "sig", (F.coalesce("extra", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "degree")
    store.sparkSession.sql(f"DROP TABLE {table}")
    return out


def _members(docs: DataFrame, id_col: str, text_col: str, links: bool) -> tuple[DataFrame, DataFrame | None]:
    """One row per document (id, n, s1, s2, key, root), key its class, root the component of that (NULL without words);
    with ``links`` also (key, n_links) per class."""
    spark = docs.sparkSession
    with batch_rows(spark, TEXT_ROWS):
        digests = saved(_digest_rows(docs, id_col, text_col), "digests")
    classes, clashes, per_doc = _classes(digests)
    n_parts = partitions(spark)
    order = F.xxhash64("sig")
    first = (_postings(docs, text_col, _frequent_bitmap(digests), clashes)
             .repartition(n_parts, "gram").sortWithinPartitions("gram", order, "sig")
             .mapInArrow(_first_round, "gram long, a long, b long"))
    with batch_rows(spark, LIST_ROWS):
        first = saved(first, "lists")
    lists = first.where("gram is not null").select("gram", F.col("a").alias("sig"), F.col("b").alias("np"))

    labels = spark.createDataFrame([], "node long, root long")

    tested = saved(_promising(first.where("gram is null").select("a", "b").distinct(), classes), "pairs")
    part = lists.select("sig").unionAll(tested.select("a")).unionAll(tested.select("b")).distinct()
    store = _row_store(docs, classes, part, id_col, text_col, clashes)

    def follow(pairs: DataFrame) -> None:
        """Verifies pairs until each is tested or joins rows of one component."""
        nonlocal labels
        if pairs.isEmpty():
            return
        table = _whole_rows(store, pairs.select(F.col("a").alias("sig")).unionAll(pairs.select("b")).distinct())
        best = saved(_one_each(pairs), "pairs")
        for some in (best, pairs.join(best, ["a", "b"], "left_anti")):
            found = saved(_verified(_apart(some, labels), spark.table(table)), "links")
            if not found.isEmpty():
                labels = _merged(labels, found)
        spark.sql(f"DROP TABLE {table}")

    follow(tested)
    left, k = float("inf"), 0
    while True:
        known = lists.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select(
            "gram", "sig", "np", F.coalesce("root", "sig").alias("comp"))
        open_lists = (known.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                      .where("lo <> hi").select("gram"))
        known = saved(known.join(open_lists, "gram", "left_semi"), "open")
        before, k = left, k + 1
        left, n_rows = _pairs_left(known)
        if left == 0:  # every list lies inside one component
            break
        last = left <= n_rows or 4 * left > 3 * before
        if last:
            found = _left_over(known, classes)
        else:
            found = (known.repartition(n_parts, "gram").sortWithinPartitions("gram", F.xxhash64("sig", "gram", F.lit(k)), "sig")
                     .mapInArrow(_later_round, "a long, b long").distinct())
        fresh = saved(_promising(found.join(tested, ["a", "b"], "left_anti"), classes), "pairs")
        tested = tested.unionByName(fresh)
        follow(fresh)
        if last:
            break
    degree = _link_counts(classes, labels, store).withColumnRenamed("sig", "key") if links else None
    members = per_doc.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "id", "n", "s1", "s2", "key", F.when(F.col("n") > 0, F.coalesce("root", "key")).alias("root"))
    return members, degree


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id, n_links).

    ``n_links`` is the number of other documents that link with the document,
    exact copies included.
    """
    members, degree = _members(docs, id_col, text_col, True)
    lowest = members.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    empty = members.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    full = (members.where("n > 0").join(lowest, "root").join(degree, "key")
            .select("id", F.col("n").alias("n_shingles"), "component_id", F.col("n_links").cast("long").alias("n_links")))
    return full.unionByName(empty).withColumnRenamed("id", id_col)


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: one row of each component stays, all columns as they were.

    The row with the smallest id stays (NULL ids last, then the smaller digest
    of its set); of rows alike in id and set, any one. Rows without words stay.
    Where ids are unique the id decides; rows whose id is NULL or repeated are
    told apart by id and set, so a different text under a repeated id is not lost.
    """
    members = saved(_members(docs, id_col, text_col, False)[0], "members")
    key = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("s1").alias("s1"), F.col("s2").alias("s2"))
    best = members.where("n > 0").groupBy("root").agg(F.min(key).alias("best")).select("root", "best.id", "best.s1", "best.s2")
    winners = best.select("id", "s1", "s2")
    repeated = members.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    id_name, = new_names(docs.columns, ["kept_id"])
    alone = members.where("n > 0 and id is not null").join(best.select("root", F.col("id").alias("best_id")), "root")
    # Not eqNullSafe: a component with a known id never has a NULL best.
    gone = alone.where("id <> best_id").select("id").unionAll(repeated).distinct().withColumnRenamed("id", id_name)
    left = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col) == F.col(id_name), "left_anti")
    if repeated.isEmpty() and members.where("id is null").isEmpty():
        return left
    return left.unionByName(_one_of_each(docs, repeated, winners, id_col, text_col))


def _one_of_each(docs: DataFrame, repeated: DataFrame, winners: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the rows with a NULL or repeated id: those without words, and one row of each winner."""
    names = new_names(docs.columns, ["set_1", "set_2", "set_size", "id_2"])
    one, two, size, other = names
    again = repeated.withColumnRenamed("id", other)
    some = docs.where(F.col(id_col).isNull()).unionByName(docs.where(F.col(id_col).isNotNull()).join(again, F.col(id_col) == F.col(other), "left_semi"))
    schema = T.StructType([*docs.schema.fields, T.StructField(one, T.LongType()), T.StructField(two, T.LongType()), T.StructField(size, T.LongType())])

    def tag(batches):
        for b in batches:
            for s in K.batch_slices(b, text_col, SLICE_BYTES):
                sets = shingle_sets(s.column(text_col))
                sig = [signature(x) for x in sets]
                sig = [(a & (1 << SUM_BITS) - 1, c) for a, c in sig]
                cols = [pa.array([_signed(v[i]) for v in sig], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*s.columns, *cols, pa.array([len(x) for x in sets], pa.int64())], names=schema.names)

    with batch_rows(docs.sparkSession, TEXT_ROWS):
        tagged = saved(some.mapInArrow(tag, schema), "unclear")
    empty = tagged.where(F.col(size) == 0).select(*docs.columns)
    w = winners.select(*[F.col(c).alias(f"{c}_win") for c in ("id", "s1", "s2")])
    cols = [f"`{c}`" for c in tagged.columns]
    hit = tagged.where(F.col(size) > 0).toDF(*[f"c{i}" for i in range(len(cols))])
    at = {c: f"c{i}" for i, c in enumerate(tagged.columns)}
    won = hit.join(w, F.col(at[id_col]).eqNullSafe(F.col("id_win")) & (F.col(at[one]) == F.col("s1_win")) & (F.col(at[two]) == F.col("s2_win")), "left_semi")
    each = won.groupBy(at[id_col], at[one], at[two]).agg(F.first(F.struct(*[F.col(at[c]).alias(c) for c in docs.columns])).alias("row"))
    return empty.unionByName(each.select("row.*"))
