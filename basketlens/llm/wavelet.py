"""Token-ID output as one wavelet matrix per shard (operator 8).

Documents are range-partitioned and sorted by id, encoded, ended with an end
id, and cut into shards of whole documents. A shard is one compressed binary
file body: for every bit of the ids (highest first) the packed bit-plane of the
stably partitioned sequence, with the number of zeros and a rank directory.
``WaveletMatrix`` answers access, rank, count, select and occurrences from that
body alone. Shards are written by Spark's Parquet writer into shared storage
(one row per shard: header columns and the body), so a lost executor only
repeats its tasks.

NULL or empty text gives a document of just the end id. Documents without id
come first; repeated ids are ordered by text. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from basketlens.llm import kernels as K
from basketlens.llm.common import partitions

MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 20
BLOCK_BITS = 4096  # bits between entries of the rank directory
_HEAD = struct.Struct("<4sIQ")


class WaveletMatrix:
    """Sequence of unsigned integers below 2**16 (or 2**32) as bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.width = len(planes)
        self._ranks: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        width = max(1, int(values.max()).bit_length()) if len(values) else 1
        seq = values.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(width - 1, -1, -1):
            bit = (seq >> seq.dtype.type(b)).astype(np.uint8) & np.uint8(1)
            planes.append(np.packbits(bit, bitorder="little"))
            one = bit.view(bool)
            low = seq[np.flatnonzero(~one)]
            zeros.append(len(low))
            seq = np.concatenate([low, seq[np.flatnonzero(one)]])
        return cls(len(values), planes, zeros)

    def to_bytes(self) -> bytes:
        z = zstandard.ZstdCompressor(level=1)
        bodies = [z.compress(p.tobytes()) for p in self.planes]
        head = _HEAD.pack(MAGIC, self.width, self.n)
        table = struct.pack(f"<{2 * self.width}Q", *self.zeros, *map(len, bodies))
        return head + table + b"".join(bodies)

    @classmethod
    def from_bytes(cls, body: bytes) -> WaveletMatrix:
        magic, width, n = _HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        table = struct.unpack_from(f"<{2 * width}Q", body, _HEAD.size)
        at, planes, z = _HEAD.size + 16 * width, [], zstandard.ZstdDecompressor()
        for size in table[width:]:
            planes.append(np.frombuffer(z.decompress(body[at:at + size]), np.uint8))
            at += size
        return cls(n, planes, list(table[:width]))

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if self._ranks[level] is None:
            per = np.add.reduceat(np.bitwise_count(self.planes[level]).astype(np.int64), np.arange(0, len(self.planes[level]), BLOCK_BITS // 8)) if self.n else []
            self._ranks[level] = np.concatenate([[0], np.cumsum(per)])
        block = i // BLOCK_BITS
        lo, hi = block * BLOCK_BITS // 8, i // 8
        plane = self.planes[level]
        ones = int(self._ranks[level][block]) + int(np.bitwise_count(plane[lo:hi]).sum())
        if i % 8:
            ones += int(plane[hi] & ((1 << (i % 8)) - 1)).bit_count()
        return ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.width):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the symbol's occurrences before ``end`` lie after the last plane."""
        if symbol >> self.width:
            return 0, 0
        lo, hi = 0, end
        for level in range(self.width):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (self.width - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, end: int) -> int:
        lo, hi = self._range(symbol, end)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        lo, hi = self._range(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.width - 1, -1, -1):
            if symbol >> (self.width - 1 - level) & 1:
                i = self._find(level, i - self.zeros[level], True)
            else:
                i = self._find(level, i, False)
        return i

    def _find(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th one (or zero) of a plane: binary search by rank."""
        lo, hi = 0, self.n
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            before = self._ones(level, mid)
            if (before if one else mid - before) <= k:
                lo = mid
            else:
                hi = mid
        return lo

    def occurrences(self, symbol: int) -> list[int]:
        """All positions in order: the symbol's range below the last plane, mapped back plane by plane."""
        lo, hi = self._range(symbol, self.n)
        at = np.arange(lo, hi)
        for level in range(self.width - 1, -1, -1):
            if not len(at):
                break
            one = bool(symbol >> (self.width - 1 - level) & 1)
            at = np.flatnonzero(self._bits(level) == one)[at - (self.zeros[level] if one else 0)]
        return at.tolist()

    def decode(self) -> np.ndarray:
        """The whole sequence, planes undone from the lowest."""
        v = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            one = self._bits(level)
            out = np.empty_like(v)
            z = self.zeros[level]
            out[np.flatnonzero(~one)] = v[:z]
            out[np.flatnonzero(one)] = v[z:] | v.dtype.type(1 << (self.width - 1 - level))
            v = out
        return v


_TAIL = np.zeros(256, bool)   # marks that end a word as a piece of their own
_TAIL[[ord(c) for c in ".,;:!?#*$%&()[]{}/-+=~^@"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LATIN = np.zeros(256, bool)  # second bytes of the two-byte letters U+00C0..U+00FF (first byte C3)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


class WordEncoder:
    """Ids of whole texts by a lower-casing word tokenizer file, through the tokenizers library.

    The vocabulary drops white space and never joins pieces across it, nor a
    letter or digit with a mark behind it; so each distinct unit (a word, or
    the marks at its end) is encoded once and its ids are laid out again for
    every text. Units of one piece are handed over many at a time, and split
    again at the ids that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words = K.PieceCache(self._many)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        two = np.zeros(len(data), bool)
        two[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]] & ~((data[1:] < 0x9F) & (data[1:] >= 0x80))
        letter = ((data >= 97) & (data <= 122)) | two
        letter[:-1] |= two[1:]
        one_piece = np.zeros(len(size), bool)
        for mask in (letter, _TAIL[data]):
            c = np.concatenate([[0], np.cumsum(mask)])
            one_piece |= c[end] - c[start] == size
        plain, rest = np.flatnonzero(one_piece), np.flatnonzero(~one_piece)
        parts, n = [], np.zeros(len(size), np.int64)
        padded = np.append(data, np.uint8(0x20))
        for lo in range(0, len(plain), 2000):
            at = plain[lo:lo + 2000]
            text = K.ragged_take(padded, start[at], size[at] + 1).copy()
            text[np.cumsum(size[at] + 1) - 1] = 0x20
            ids = np.array(self._ids([text.tobytes().decode()])[0], np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(at) or stop[-1] != len(ids):
                raise ValueError("a unit is not one piece of this vocabulary")
            n[at] = np.diff(stop, prepend=0)
            parts.append(ids)
        others = self._ids([data[start[i]:end[i]].tobytes().decode() for i in rest])
        n[rest] = [len(x) for x in others]
        flat = np.concatenate([np.zeros(0, np.uint32), *parts, *[np.array(x, np.uint32) for x in others]])
        order = np.concatenate([plain, rest])
        at = np.zeros(len(size), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        return K.ragged_take(flat, at, n), n

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, id offsets of the rows)."""
        start, end, _ = K.word_spans(data, off)
        if len(start):
            two = np.zeros(len(data), bool)
            two[1:] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
            if b"<|" not in data.tobytes():  # special strings are matched before lower-casing
                data = K.LOWER[data]
                data[two & (data < 0x9F)] += 0x20
            index = np.arange(len(data))
            cut = np.maximum.accumulate(np.where(_TAIL[data], -1, index))[end - 1] + 1
            before = np.maximum(cut - 1, 0)
            split = (cut > start) & (cut < end) & (_ALNUM[data[before]] | two[before])
            start, end = np.sort(np.concatenate([start, cut[split]])), np.sort(np.concatenate([end, cut[split]]))
        ids, n = self.words.encode(data, start, end)
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, off)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


SHARDS = "part int, seq int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, body binary"


def write_shards(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes the documents in id order and writes one wavelet matrix per shard under ``out``."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    src = src.repartitionByRange(partitions(docs.sparkSession), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "t")

    def run(batches):
        enc = word_encoder(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        ids, names, sizes, held = [], [], [], 0

        def shard():
            values = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([len(values)], pa.int64()), pa.array([WaveletMatrix.build(values).to_bytes()], pa.binary())],
                names=["part", "seq", "doc_ids", "doc_tokens", "n_tokens", "body"])

        for batch in batches:
            for s in K.batch_slices(batch, "t"):
                data, off = K.text_buffer(s.column("t"))
                got, at = enc.encode(data, off)
                n = np.diff(at)
                got = np.insert(got, at[1:], np.uint32(end_id))
                own = s.column("id").to_pylist()
                ends = np.cumsum(n + 1)
                lo = 0
                for i in range(len(own)):
                    held += int(n[i]) + 1
                    if held >= shard_tokens or i == len(own) - 1:
                        ids.append(got[ends[lo] - n[lo] - 1:ends[i]])
                        names += own[lo:i + 1]
                        sizes += (n[lo:i + 1] + 1).tolist()
                        lo = i + 1
                    if held >= shard_tokens:
                        yield shard()
                        ids, names, sizes, held, seq = [], [], [], 0, seq + 1
        if names:
            yield shard()

    src.mapInArrow(run, SHARDS).write.parquet(out)


def _heads(shards: DataFrame) -> DataFrame:
    """(p, q, shard_start) of every shard: its part, its number there, and the ids of all shards before it."""
    heads = shards.select("part", "seq", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before_part), F.lit(0)).alias("part_start"))
    before_seq = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (heads.join(parts, F.col("part") == F.col("p"))
             .select(F.col("part").alias("p"), F.col("seq").alias("q"),
                     (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(before_seq), F.lit(0))).alias("shard_start")))


def read_shards(spark, out: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: (id_col, start, n_tokens, ids); ids are little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it, over all shards.
    """
    shards = spark.read.schema(SHARDS).parquet(out)
    heads = _heads(shards)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                values = WaveletMatrix.from_bytes(batch.column("body")[i].as_py()).decode().astype("<u4")
                n = batch.column("doc_tokens")[i].values.to_numpy()
                end = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), batch.column("part")[i].as_py(), np.int32)), pa.array(np.full(len(n), batch.column("seq")[i].as_py(), np.int32)),
                     batch.column("doc_ids")[i].values, pa.array(end - n), pa.array(n),
                     pa.array([values[e - k:e].tobytes() for e, k in zip(end.tolist(), n.tolist())], pa.binary())],
                    names=["part", "seq", "id", "own_start", "n_tokens", "ids"])

    rows = shards.select("part", "seq", "doc_ids", "doc_tokens", "body").mapInArrow(
        run, "part int, seq int, id long, own_start long, n_tokens long, ids binary")
    return (rows.join(heads, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q")))
            .select(F.col("id").alias(id_col), (F.col("shard_start") + F.col("own_start")).alias("start"), "n_tokens", "ids"))


def token_at(spark, out: str, positions: DataFrame, position_col: str = "position", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(position_col, token) for every row of ``positions``, by access to the bit planes; NULL outside the sequence.

    Positions meet shards by an equi-join on cells of ``shard_tokens`` positions; a shard gets the list of its
    distinct positions (no more than its tokens) and is opened once.
    """
    shards = spark.read.schema(SHARDS).parquet(out)
    sizes = shards.select(F.col("part").alias("p"), F.col("seq").alias("q"), "n_tokens")
    heads = _heads(shards).join(sizes, ["p", "q"])
    cells = F.sequence(F.floor(F.col("shard_start") / shard_tokens), F.floor((F.col("shard_start") + F.col("n_tokens") - 1) / shard_tokens))
    heads = heads.where("n_tokens > 0").withColumn("cell", F.explode(cells))
    asked = positions.select(F.col(position_col).cast("long").alias("pos")).where("pos is not null").distinct()
    asked = asked.withColumn("cell", F.floor(F.col("pos") / shard_tokens))
    inside = (F.col("pos") >= F.col("shard_start")) & (F.col("pos") < F.col("shard_start") + F.col("n_tokens"))
    per = asked.join(heads, "cell").where(inside).groupBy("p", "q", "shard_start").agg(F.collect_list(F.col("pos") - F.col("shard_start")).alias("own"))
    full = shards.select(F.col("part").alias("p"), F.col("seq").alias("q"), "body").join(per, ["p", "q"]).select("shard_start", "own", "body")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                m = WaveletMatrix.from_bytes(batch.column("body")[i].as_py())
                own = batch.column("own")[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(own + batch.column("shard_start")[i].as_py()), pa.array([m.access(int(k)) for k in own], pa.int64())],
                                                 names=["pos", "token"])

    found = full.mapInArrow(run, "pos long, token long")
    return positions.select(position_col).join(found, F.col(position_col).cast("long") == F.col("pos"), "left").select(position_col, "token")


def _per_shard(spark, out: str, tokens: list[int], each, schema: str) -> DataFrame:
    shards = spark.read.schema(SHARDS).parquet(out).select("part", "seq", "body")
    wanted = sorted({int(t) for t in tokens})

    def run(batches):
        for batch in batches:
            for part, seq, body in zip(*[batch.column(c) for c in ("part", "seq", "body")]):
                m = WaveletMatrix.from_bytes(body.as_py())
                for t in wanted:
                    got = each(m, t)
                    if len(got):
                        n = len(got)
                        yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()),
                                                          pa.array([t] * n, pa.int64()), pa.array(got, pa.int64())], names=["part", "seq", "token", "value"])

    return shards.mapInArrow(run, schema)


def count_of(spark, out: str, tokens: list[int]) -> DataFrame:
    """(token, n) over all shards for each of ``tokens`` (a given list), by rank at both ends of a shard; 0 if absent."""
    rows = _per_shard(spark, out, tokens, lambda m, t: [m.count(t)], "part int, seq int, token long, value long")
    asked = spark.createDataFrame([(int(t),) for t in sorted(set(tokens))], "token long")
    found = rows.groupBy("token").agg(F.sum("value").alias("n"))
    return asked.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def positions_of(spark, out: str, tokens: list[int]) -> DataFrame:
    """(token, position) of every occurrence of each of ``tokens`` (a given list), by select; position counts over all shards."""
    rows = _per_shard(spark, out, tokens, lambda m, t: m.occurrences(t), "part int, seq int, token long, value long")
    heads = _heads(spark.read.schema(SHARDS).parquet(out))
    return rows.join(heads, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q"))).select("token", (F.col("shard_start") + F.col("value")).alias("position"))


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
