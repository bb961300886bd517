"""Secret scans through a trigram inverted index (operator 3, DataFrame operations only).

Each rule is a regular expression. Its mandatory literals are turned into a
Boolean trigram query (an OR of ANDs); the index holds one posting per
(trigram, document) for the trigrams of those queries; postings are intersected
by counting, per document and clause, how many of the clause's trigrams it has;
documents that satisfy a clause are verified with the regular expression
itself. Rules without mandatory trigrams scan every text.

Spans are code points, end exclusive, leftmost and non-overlapping per kind.
NULL text counts as empty (no spans). Every input row gives one row: repeated
ids share their candidates, and verification decides per row. Long texts are
scanned whole.
"""

from __future__ import annotations

import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import shielded

MASK = "[SECRET]"
_MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    value_group: int = 0   # the group whose length counts
    min_length: int = 0
    base: bool = False


#: The base rules, then those this scanner adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


def _one(op: str, arg) -> set[str] | None:
    """The lower-case characters a literal or a small class of literals matches."""
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and len(arg) <= 8 and all(str(k) == "LITERAL" for k, _ in arg):
        return {chr(c).lower() for _, c in arg}
    return None


def _literals(nodes) -> list[set[str]]:
    """Mandatory parts of a parsed pattern in order; each part is the set of strings that can stand there."""
    parts, run = [], {""}

    def close():
        nonlocal run
        if run != {""}:
            parts.append(run)
        run = {""}

    for op, arg in nodes:
        name = str(op)
        options = _one(name, arg)
        if name == "SUBPATTERN":
            options = _exact(arg[3])
        elif name == "BRANCH":
            options = _exact([(op, arg)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == 0 and arg[1] == 1:
            inner = _exact(arg[2])
            options = inner | {""} if inner is not None else None
        if options is not None and len(run) * len(options) <= _MAX_ALTERNATIVES:
            run = {a + b for a in run for b in options}
            continue
        close()
        if name == "SUBPATTERN":
            parts += _literals(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            parts += _literals(arg[2])
    close()
    return parts


def _exact(nodes) -> set[str] | None:
    """All strings a parsed pattern matches, if they are few and finite."""
    out = {""}
    for op, arg in nodes:
        name = str(op)
        if (options := _one(name, arg)) is not None:
            pass
        elif name == "SUBPATTERN":
            options = _exact(arg[3])
        elif name == "BRANCH":
            each = [_exact(b) for b in arg[1]]
            options = None if any(e is None for e in each) else set().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == 0 and arg[1] == 1:
            inner = _exact(arg[2])
            options = None if inner is None else inner | {""}
        else:
            return None
        if options is None or len(out) * len(options) > _MAX_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in options}
    return out


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams that every match's text must contain; empty when nothing is mandatory."""
    best = max(_literals(rp.parse(pattern)), key=lambda p: min(map(len, p)), default={""})
    if min(map(len, best)) < 3:
        return []
    clauses = {trigrams(s) for s in best}
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def candidates(docs: DataFrame, rules, id_col: str, text_col: str) -> DataFrame:
    """(__id, __rules): the rules whose trigram query each document id satisfies."""
    clauses = [(r.kind, c) for r in rules for c in trigram_query(r.pattern)]
    terms = sorted(set().union(*(c for _, c in clauses)))
    of_term = F.create_map(*[x for t in terms for x in (
        F.lit(t), F.array(*[F.lit(i) for i, (_, c) in enumerate(clauses) if t in c]))])
    need = F.create_map(*[x for i, (_, c) in enumerate(clauses) for x in (F.lit(i), F.lit(len(c)))])
    rule = F.create_map(*[x for i, (k, _) in enumerate(clauses) for x in (F.lit(i), F.lit(k))])
    low = F.array(F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    present = F.transform(low, lambda t: F.filter(F.array(*[F.lit(x) for x in terms]), lambda x: F.contains(t, x)))[0]
    postings = docs.select(F.col(id_col).alias("__id"), F.explode(present).alias("trigram")).distinct()
    hits = postings.select("__id", F.explode(of_term[F.col("trigram")]).alias("clause"))
    met = hits.groupBy("__id", "clause").agg(F.count("*").alias("n")).where(F.col("n") == need[F.col("clause")])
    return met.groupBy("__id").agg(F.collect_set(rule[F.col("clause")]).alias("__rules"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, k, end, kind>> of a rule's matches in ``text``."""
    pat = F.lit(rule.pattern)
    both = F.struct(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pat, F.lit(0)).alias("hit"),
                    F.regexp_extract_all(text, pat, F.lit(rule.value_group)).alias("val"))
    empty = F.expr("cast(array() as array<struct<start: int, k: int, `end`: int, kind: string>>)")

    def walk(m):
        def step(acc, i):
            start = acc["pos"] + F.length(F.element_at(m["gap"], i))
            end = start + F.length(F.element_at(m["hit"], i))
            span = F.struct(start.alias("start"), F.lit(order).alias("k"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            long_enough = F.length(F.element_at(m["val"], i)) >= rule.min_length
            return F.struct(end.alias("pos"), F.when(long_enough, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.size(m["hit"])), F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])

    return F.when(F.regexp_like(text, pat), F.transform(F.array(both), walk)[0]).otherwise(empty)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The input's columns and ``__spans``, sorted by start and then by the rules' order."""
    found = candidates(docs, [r for r in rules if trigram_query(r.pattern)], id_col, text_col)
    cols = [docs[c] for c in docs.columns]
    joined = docs.join(found, docs[id_col].eqNullSafe(found["__id"]), "left")
    text = F.coalesce(docs[text_col], F.lit(""))
    per_rule = []
    for k, r in enumerate(rules):
        s = _spans(r, k, text)
        if trigram_query(r.pattern):
            none = F.expr("cast(array() as array<struct<start: int, k: int, `end`: int, kind: string>>)")
            s = F.when(F.array_contains(found["__rules"], r.kind), s).otherwise(none)
        per_rule.append(s)
    return joined.select(*cols, F.array_sort(F.concat(*per_rule)).alias("__spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id, a count per base rule, digest of the base spans, and all spans."""
    s = scan(docs.select(id_col, text_col), id_col, text_col, rules)
    base = [r.kind for r in rules if r.base]
    own = F.filter("__spans", lambda x: x["kind"].isin(*base))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("__spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in base]
    return s.select(F.col(id_col), *counts, F.sha2(span_text(own), 256).alias("base_sha256"), span_text(F.col("__spans")).alias("spans"))


@shielded
def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", rules=RULES) -> DataFrame:
    """The documents with every span replaced by MASK (overlapping spans once); ``length_col`` follows the text."""
    s = scan(docs, id_col, text_col, rules)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc, x):
        add = F.concat(acc["out"], F.substring(F.col(text_col), acc["pos"] + 1, x["start"] - acc["pos"]), F.lit(MASK))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(x["start"] >= acc["pos"], add).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["pos"] + 1, F.lit(2147483647))))
    text = F.when(F.size("__spans") > 0, clean).otherwise(F.col(text_col))
    out = s.withColumn(text_col, text)
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.size("__spans") > 0, F.length(F.col(text_col)).cast(kind)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
