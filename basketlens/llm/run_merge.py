"""Exact duplicates by a tree-merge of sorted digest runs (operator 13).

The scan reduces every text to a narrow row: SHA-256 of the text without
whitespace, the number of characters left, and what ranks copies. Each scan
partition is a *run* of these rows. Runs are merged in binomial rounds as in a
recursive-halving reduction: a run has an address of ``RADIX_BITS * rounds``
bits, first that of its scan partition; round r replaces one digit of the
address by a digit of the digest, so 2^RADIX_BITS partners exchange parts of
their runs, each sorts what it gets and merges equal digests at once. Of every
group a level keeps the best row and the number of rows. Digests are sorted and
dealt by their first 64 bits; rows count as equal only if all 256 bits and the
number of characters agree.

After the last round an address holds every row of its digests. The verdict
then goes the same way back: a run finds its entries in the run it was merged
into. A group that holds a third of all rows is one entry per run from the
first merge on, in both directions, so no task ever holds a group.

Only DataFrame functions are used. The digest table is written once to shared
storage; row numbers are taken from that written table.

Defined results: NULL texts count as empty; texts that are empty or hold only
whitespace are equal to each other. Of equal texts the one with the most code
points stays, then the smallest id (NULL last), then any one of identical
rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import new_names, partitions, saved

RADIX_BITS = 4
WHITESPACE = " \t\n\x0b\x0c\r"
GROUP = ["d", "sha", "n_left"]  # what makes two texts equal: 64 leading bits, all bits, length


def squeezed(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; NULL is empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def digests(docs: DataFrame, rounds: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: (id, n_chars, d, sha, n_left, addr_0, row)."""
    size = 1 << (RADIX_BITS * rounds)
    base = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
                       squeezed(F.col(text_col)).alias("t"), F.pmod(F.spark_partition_id(), F.lit(size)).alias("addr_0"),
                       F.monotonically_increasing_id().alias("row"))
    hexed = base.select("id", "n_chars", "addr_0", "row", F.length("t").cast("long").alias("n_left"), F.sha2(F.col("t").cast("binary"), 256).alias("x"))
    return hexed.select("id", "n_chars", F.conv(F.substring("x", 1, 15), 16, 10).cast("long").alias("d"),
                        F.unhex("x").alias("sha"), "n_left", "addr_0", "row")


def best_first() -> Column:
    """Least value: the row of a group that stays."""
    return F.struct((-F.col("n_chars")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))


def next_address(level: int) -> Column:
    """The address after round ``level``: its digit number ``level`` comes from the digest."""
    shift = RADIX_BITS * level
    mask = ((1 << RADIX_BITS) - 1) << shift
    return (F.col(f"addr_{level}").bitwiseAND(F.lit(~mask))
            .bitwiseOR(F.col("d").bitwiseAND(F.lit(mask).cast("long")).cast("int"))).alias(f"addr_{level + 1}")


def merge_runs(rows: DataFrame, addr: str, n: int) -> DataFrame:
    """Every address sorts the runs sent to it and merges equal digests: one row per (address, digest)."""
    run = rows.repartition(n, addr).sortWithinPartitions(addr, *GROUP)
    return run.groupBy(addr, *GROUP).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def tree_merge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row, dropped ones too."""
    n = partitions(docs.sparkSession)
    rounds = max(1, -(-max(1, n - 1).bit_length() // RADIX_BITS))
    rows = saved(digests(docs, rounds, id_col, text_col), "digests")
    # Level 0: each scan partition's run, merged inside the partition before anything moves.
    local = rows.groupBy("addr_0", *GROUP).agg(F.min(best_first()).alias("best"), F.count("*").alias("n"))
    runs = [saved(local, "run")]
    for level in range(rounds):
        sent = runs[-1].select(*GROUP, "best", "n", next_address(level))
        runs.append(saved(merge_runs(sent, f"addr_{level + 1}", n), "run"))
    # Back down: an entry finds the entry it was merged into; at most 2^RADIX_BITS entries share one.
    verdict = runs[-1]
    for level in reversed(range(rounds)):
        down = runs[level].select(f"addr_{level}", *GROUP, next_address(level))
        verdict = down.join(verdict, [f"addr_{level + 1}", *GROUP]).select(f"addr_{level}", *GROUP, "best", "n")
    out = rows.join(verdict, ["addr_0", *GROUP])
    return out.select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
                      (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they were.

    Rows that share id and text but differ in other columns are copies too: one of them stays.
    """
    spare = new_names(docs.columns, ["sha", "id"])
    keep = tree_merge(docs, id_col, text_col).where("kept").select(F.col("text_sha256").alias(spare[0]), F.col("id").alias(spare[1]))
    tagged = docs.withColumn(spare[0], F.sha2(squeezed(F.col(text_col)).cast("binary"), 256)).withColumn(spare[1], F.col(id_col))
    same = [tagged[spare[0]] == keep[spare[0]], tagged[spare[1]].eqNullSafe(keep[spare[1]])]
    best = tagged.join(keep, reduce(Column.__and__, same), "left_semi")
    length = F.length(F.coalesce(F.col(text_col), F.lit("")))
    rest = [F.col(f"`{c}`") for c in docs.columns]
    one = best.groupBy(*spare).agg(F.max_by(F.struct(*rest), length).alias("one"))
    return one.select(*[F.col("one").getField(c).alias(c) for c in docs.columns])


#: DuckDB twin over ``documents``.
SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
