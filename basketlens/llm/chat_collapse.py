"""Chat formatting after collapsing cumulative snapshots (operator 9).

Chat logs often store a conversation again after every turn. Each turn gets a
hash of its position, role and text; the XOR of the hashes up to a turn is the
rolling hash of that turn prefix (two 64-bit lanes, plus the length). A
conversation whose whole hash equals a proper prefix of another one is a
snapshot of it. Proper prefixes are deduplicated first (a first turn shared by
a third of all logs is one row), and an anti-join keeps the maximal
conversations, one of each group of equal ones (the smallest id). These are
rendered as chat markup.

Positions and rolling hashes are two-level (blocks of BLOCK turn numbers, then
rows of a block), and a rendering is one row per BLOCK turns, so no task holds
a whole huge conversation. NULL roles and texts count as empty; turns are
ordered by number (NULL first), role and text; a NULL conversation id is one
conversation of its own; repeated rows are repeated turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import running_total

BLOCK = 1024
START, END = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns as (conv, pos, role, text, h1, h2, p1, p2): own hashes, and rolling hashes of the turns before."""
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("block", F.floor(F.col("turn") / BLOCK))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    t = running_total(t, ["conv"], "block", order, F.lit(1), "pos")
    t = t.withColumn("h1", F.xxhash64("pos", "role", "text")).withColumn("h2", F.xxhash64("text", F.lit(7), "role", "pos"))
    t = running_total(t, ["conv"], "block", ["pos"], F.col("h1"), "p1", xor=True)
    t = running_total(t, ["conv"], "block", ["pos"], F.col("h2"), "p2", xor=True)
    return t.drop("block", "turn")


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv, n_turns, copies): the conversations that are no proper prefix of another one."""
    whole = hashed.groupBy("conv").agg(F.count("*").alias("n_turns"), F.bit_xor("h1").alias("w1"), F.bit_xor("h2").alias("w2"))
    unique = whole.groupBy("n_turns", "w1", "w2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    proper = hashed.where("pos >= 1").select(F.col("pos").alias("n_turns"), F.col("p1").alias("w1"), F.col("p2").alias("w2")).distinct()
    return unique.join(proper, ["n_turns", "w1", "w2"], "left_anti").select("conv", "n_turns", "copies")


def collapse_and_render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations as (conv_col, part, n_turns, copies, rendered); part counts blocks of BLOCK turns."""
    hashed = prefix_hashes(turns, conv_col, turn_col, role_col, text_col)
    best = maximal(hashed).select(F.col("conv").alias("c"), "n_turns", "copies")
    line = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END + "\n"))
    kept = hashed.join(best, F.col("conv").eqNullSafe(F.col("c")))
    parts = kept.groupBy("conv", F.floor(F.col("pos") / BLOCK).cast("long").alias("part")).agg(
        F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "").alias("rendered"))
    return parts.withColumnRenamed("conv", conv_col)


#: DuckDB twin over ``conversations``: prefixes compared as text.
SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                  count(*) OVER (PARTITION BY conv_id) AS n
           FROM conversations),
     p AS (SELECT conv_id, pos, n, string_agg(role || chr(31) || text || chr(30), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
     u AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n - 1 GROUP BY prefix, n),
     m AS (SELECT * FROM u WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n - 1))
SELECT t.conv_id, t.pos // {BLOCK} AS part, any_value(t.n) AS n_turns, any_value(m.copies) AS copies,
       string_agg('{START}' || t.role || chr(10) || t.text || '{END}' || chr(10), '' ORDER BY t.pos) AS rendered
FROM t JOIN m ON t.conv_id = m.conv_id GROUP BY t.conv_id, t.pos // {BLOCK}
"""
