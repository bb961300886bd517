"""Language ID by Bayesian evidence fusion (operator 2).

For every page the log posterior of a language is the sum of

* the text log-likelihood: byte trigrams of the visible text, hashed to BINS
  bins, against counts of all labelled documents; weighed down to EVIDENCE
  trigrams, as neighbouring trigrams are not independent;
* log P(declared markup language | language) and log P(address suffix |
  language), from counts over all pages against the text-only guess;
* the log prior of the host, smoothed in a hierarchy: host counts are shrunk to
  those of the registered domain, these to all pages (STRENGTH pseudo-pages a
  level). The registered domain is the last two labels of a host, three where
  the last two are in ``shared_suffixes``; a numeric address is its own domain
  and has no suffix.

A page's own guess is taken out of all counts that it is judged by, so a page
never confirms itself. Pages are parsed and scored once; the scores are a written
table that the counts and the joins read. All counts are grouped aggregations over
the whole tables (a host with a third of the pages is combined map-side). The
trigram table has BINS rows a language, and more than ``max_languages`` labels
raise ValueError, so its size does not depend on the corpus. A NULL or empty page has no text
evidence and follows the other signs; a missing declaration or host is a value
of its own; repeated rows are judged alike. Without labelled documents the
operator returns NULL languages.
"""

from __future__ import annotations

import html as html_entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm import kernels as K
from basketlens.llm.common import saved

BINS = 1 << 15
EVIDENCE = 60
STRENGTH = 20.0
ALPHA = 0.5
MAX_LANGUAGES = 200
#: Address endings of two labels under which names are registered (a default, to be replaced by a full list).
SHARED_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx",
                   "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
_NUMERIC_HOST = r"^[0-9]+(\.[0-9]+){3}$"

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")


def visible_text(page: str | None) -> str:
    return html_entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def trigram_bins(data: np.ndarray) -> np.ndarray:
    """Bin of every byte trigram of a lower-cased text, white space folded."""
    data = np.where(K.IS_SPACE[data], np.uint8(32), K.LOWER[data]).astype(np.uint64)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    code = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    return (K.mix64(code) & np.uint64(BINS - 1)).astype(np.int64)


def trigram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bin, n) over all labelled documents."""
    src = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))

    def run(batches):
        for b in batches:
            total: dict[str, np.ndarray] = {}
            for s in K.batch_slices(b, "t"):
                data, off = K.text_buffer(s.column("t"))
                for i, lang in enumerate(s.column("lang").to_pylist()):
                    n = np.bincount(trigram_bins(data[off[i]:off[i + 1]]), minlength=BINS)
                    total[lang] = total[lang] + n if lang in total else n
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bin", "n"])

    return src.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def _text_scores(pages: DataFrame, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """Adds ``ll``: tempered text log-likelihood per language."""
    shared = pages.sparkSession.sparkContext.broadcast(log_p)

    def run(batches):
        table = shared.value
        for b in batches:
            for s in K.batch_slices(b, "html"):
                out = np.zeros((s.num_rows, len(langs)))
                for i, page in enumerate(s.column("html").to_pylist()):
                    bins = trigram_bins(np.frombuffer(visible_text(page).encode("utf-8", "replace"), np.uint8))
                    if len(bins):
                        out[i] = table[:, bins].sum(axis=1) * min(1.0, EVIDENCE / len(bins))
                flat = pa.array(out.ravel())
                ll = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(langs), dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*[s.column(c) for c in ("id", "host", "domain", "suffix", "declared")], ll],
                                                 names=["id", "host", "domain", "suffix", "declared", "ll"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInArrow(run, f"id {kind}, host string, domain string, suffix string, declared string, ll array<double>")


def _counts(scored: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """(key, n array): text-only guesses per language for each value of ``key``."""
    sums = scored.groupBy(key).agg(*[F.sum((F.col("guess") == i).cast("double")).alias(f"n{i}") for i in range(len(langs))])
    return sums.select(F.col(key).alias(f"__{key}"), F.array(*[f"n{i}" for i in range(len(langs))]).alias(f"n_{key}"))


def _shrunk(n: Column, parent: Column) -> Column:
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(n, parent, lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))


def fuse(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
         text_col: str = "text", lang_col: str = "lang", shared_suffixes: tuple[str, ...] = SHARED_SUFFIXES,
         max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """One row per page: (id_col, host, declared, suffix, text_lang, lang, probability)."""
    labels = docs.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(max_languages + 1).count()
    if labels > max_languages:
        raise ValueError(f"more than max_languages = {max_languages} values of {lang_col}")
    model = trigram_counts(docs, text_col, lang_col).toPandas()  # at most BINS rows a language
    langs = sorted(model["lang"].unique())
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    src = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.col(html_col).alias("html"))
    numeric, two = F.col("host").rlike(_NUMERIC_HOST), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    three = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    src = src.withColumns({
        "domain": F.when(numeric, F.col("host")).when(two.isin(*shared_suffixes) & (three != ""), three).otherwise(two),
        "suffix": F.when(numeric, F.lit("")).otherwise(F.regexp_extract("host", r"([^.]+)$", 1)),
        "declared": F.lower(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))})
    if not langs:
        none = F.lit(None).cast("string")
        return src.select(F.col("id").alias(id_col), "host", "declared", "suffix", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("probability"))
    n = np.zeros((len(langs), BINS))
    n[model["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(int), model["bin"].to_numpy(int)] = model["n"].to_numpy(float)
    log_p = np.log((n + ALPHA) / (n.sum(axis=1, keepdims=True) + ALPHA * BINS))
    s = _text_scores(src, langs, log_p)
    s = s.withColumn("guess", F.when(F.array_max("ll") < 0, F.array_position("ll", F.array_max("ll")) - 1))
    s = saved(s, "pages-scored")
    known = s.select("host", "domain", "suffix", "declared", "guess")
    k = len(langs)
    signs = ("declared", "suffix")
    overall = known.agg(*[F.sum((F.col("guess") == i).cast("double")).alias(f"n{i}") for i in range(k)],
                        *[F.countDistinct(F.coalesce(key, F.lit(""))).alias(f"values_{key}") for key in signs])
    n_all = F.array(*[F.coalesce(F.col(f"n{i}"), F.lit(0.0)) for i in range(k)])
    size = F.aggregate(n_all, F.lit(0.0), lambda a, x: a + x)
    overall = overall.select(*[f"values_{key}" for key in signs], n_all.alias("n_all"), F.transform(n_all, lambda x: (x + 1) / (size + k)).alias("p_all"))
    s = s.crossJoin(F.broadcast(overall))  # one row

    def without_own(n: Column) -> Column:
        return F.transform(n, lambda x, i: x - F.coalesce((i == F.col("guess")).cast("double"), F.lit(0.0)))

    for key in ("host", "domain", "suffix", "declared"):
        c = _counts(known, key, langs)
        s = s.join(c, s[key].eqNullSafe(c[f"__{key}"]), "left").drop(f"__{key}")
        zero = F.array(*[F.lit(0.0)] * k)
        s = s.withColumn(f"n_{key}", without_own(F.transform(F.coalesce(F.col(f"n_{key}"), zero), lambda x: F.coalesce(x, F.lit(0.0)))))
    s = s.withColumn("prior", _shrunk(F.col("n_host"), _shrunk(F.col("n_domain"), F.col("p_all"))))

    def value_given_language(key: str) -> Column:
        return F.zip_with(F.col(f"n_{key}"), without_own(F.col("n_all")), lambda x, a: F.log((x + ALPHA) / (a + ALPHA * F.col(f"values_{key}"))))

    score = F.zip_with("ll", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b)
    for key in signs:
        score = F.zip_with(score, value_given_language(key), lambda a, b: a + b)
    s = s.withColumn("score", score).withColumn("best", F.array_max("score"))
    weight = F.aggregate(F.col("score"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    names = F.array(*[F.lit(x) for x in langs])
    return s.select(F.col("id").alias(id_col), "host", "declared", "suffix", F.get(names, F.col("guess").cast("int")).alias("text_lang"),
                    F.element_at(names, F.array_position("score", F.col("best")).cast("int")).alias("lang"), (1 / weight).alias("probability"))
