"""Quality rules: compression bands (operator 1).

Every whole text is compressed with zstandard, and so is every fixed chunk of
it. A ratio (raw bytes / compressed bytes) above its length class's ceiling
means repetitive text, one below the floor means incompressible text. A
document is kept when the base rules pass, its whole-text ratio is inside the
band of its byte length, and at most half of its chunks leave the chunk band
of their length. Runs in one narrow pass (no shuffle); one row out per row in.

NULL or empty text has no words and fails the base rules. Repeated rows are
scored alike; NULL ids are kept as they are; extra columns are never read by
``score`` and are passed through by ``keep_good``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm import kernels as K

LEVEL = 3
CHUNK_BYTES = 4096
SLICE_BYTES = 1 << 20  # text bytes measured at once: the working arrays take some 40 times as much in every worker
MAX_BAD_CHUNKS = 0.5
#: (from this many bytes, lowest ratio, highest ratio). ``fitted`` to a fixed sample, the 3,243 documents of sf0.1
#: that are labelled quality 1 and pass the base rules; the first class holds none of them and the last too few, so both have wide limits.
BANDS = ((0, 0.0, 2.6), (256, 1.31, 1.68), (362, 1.34, 1.86), (512, 1.39, 1.89), (724, 1.51, 2.0), (1024, 1.64, 2.06),
         (1448, 1.75, 2.17), (2048, 1.82, 2.18), (2896, 1.9, 2.24), (4096, 2.01, 2.32), (5793, 2.04, 2.37),
         (8192, 2.11, 2.41), (11585, 2.15, 2.44), (16384, 2.22, 2.47), (24576, 1.4, 4.5))
#: The same of chunks, from the chunks of that sample and its texts of less than a chunk.
CHUNK_BANDS = ((0, 0.1, 1.55), (256, 1.3, 1.68), (362, 1.34, 1.86), (512, 1.39, 1.89), (724, 1.51, 2.0), (1024, 1.64, 2.06),
               (1448, 1.75, 2.17), (2048, 1.82, 2.18), (2896, 1.9, 2.24), (4096, 1.97, 2.28))
MIN_WORDS = 50
MAX_REPEAT_PCT = 50

METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = " \t\n\x0b\x0c\r"


def in_band(n_bytes: int, ratio: float, bands=BANDS) -> bool:
    _, low, high = bands[bisect_right([b[0] for b in bands], n_bytes) - 1]
    return low <= ratio <= high


def fitted(sizes, ratios, edges) -> tuple:
    """Limits per length class from good texts: 5 % below the lowest ratio, 1 % (and 0.005) above the highest."""
    sizes, ratios = np.asarray(sizes), np.asarray(ratios)
    at = np.searchsorted(edges, sizes, side="right") - 1
    return tuple((e, round(float(ratios[at == k].min()) * 0.95, 2), round(float(ratios[at == k].max()) * 1.01 + 0.005, 2))
                 for k, e in enumerate(edges) if (at == k).any())


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return dup


def metrics(texts: pa.Array, bands=BANDS, level: int = LEVEL, chunk: int = CHUNK_BYTES, chunk_bands=CHUNK_BANDS) -> dict[str, np.ndarray]:
    """The METRICS columns of one slice of texts."""
    data, off = K.text_buffer(texts)
    start, end, row = K.word_spans(data, off)
    n_words = np.diff(row)
    head = (data & 0xC0) != 0x80
    h = K.span_hashes(data, start, end)
    w3, at = K.window_hashes(h, row, 3)
    owner = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), n_words)
    _, inv, cnt = np.unique(w3 ^ K.mix64(owner[at] + np.uint64(1)), return_inverse=True, return_counts=True)
    hit = at[cnt[inv] > 1]
    covered = np.zeros(len(h), dtype=bool)
    for j in range(3):
        covered[hit + j] = True
    n_repeat = K.per_row(covered, row)
    ratio = np.zeros(len(off) - 1)
    chunks = np.zeros(len(off) - 1, np.int64)
    bad = np.zeros(len(off) - 1, np.int64)
    dup = np.zeros(len(off) - 1, np.int64)
    ok = np.zeros(len(off) - 1, bool)
    z = zstandard.ZstdCompressor(level=level)
    for i in range(len(off) - 1):
        raw = data[off[i]:off[i + 1]].tobytes()
        if not raw:
            continue
        dup[i] = _dup_lines(raw.decode("utf-8", "surrogatepass"))
        ratio[i] = len(raw) / len(z.compress(raw))
        pieces = [raw[j:j + chunk] for j in range(0, len(raw), chunk)] if len(raw) > chunk else [raw]
        chunks[i] = len(pieces)
        if len(pieces) == 1:
            bad[i] = not in_band(len(raw), ratio[i], bands)
        else:
            bad[i] = sum(not in_band(len(p), len(p) / len(z.compress(p)), chunk_bands) for p in pieces)
        ok[i] = in_band(len(raw), ratio[i], bands) and bad[i] <= MAX_BAD_CHUNKS * len(pieces)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PCT * n_words)
    return {"n_words": n_words, "word_chars": K.per_row(head & ~K.IS_SPACE[data], off),
            "n_symbols": K.per_row(_SYMBOL[data], off), "n_dup_lines": dup, "n_repeat_words": n_repeat,
            "base_failed": failed, "kept": ok & ~failed, "ratio": ratio, "n_chunks": chunks, "n_bad_chunks": bad}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and METRICS."""
    src = docs.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches):
        for b in batches:
            for s in K.batch_slices(b, "__text", SLICE_BYTES):
                m = metrics(s.column("__text"))
                yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(v) for v in m.values())], names=[id_col, *m])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, {METRICS}")


def good_rows(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` whose text, column ``at``, passes."""
    for b in batches:
        b = b.rename_columns([f"c{i}" for i in range(b.num_columns)])
        for s in K.batch_slices(b, f"c{at}", SLICE_BYTES):
            yield s.filter(pa.array(metrics(s.column(at))["kept"])).rename_columns(names)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    at, names = docs.columns.index(text_col), docs.columns
    return docs.mapInArrow(lambda batches: good_rows(batches, at, names), docs.schema)
