"""Conversation prefix trie by truncation peeling (operator 11).

Conversations are sequences of turns (role, text); every distinct prefix is a
node. The trie is never built top-down: ``peel`` starts at the greatest depth
and goes up one depth at a time. At a depth, the conversations that end there
join the nodes that survived from below with their last turn stripped, and one
regrouping by the truncated sequence yields the nodes of this depth, their
counts and the sums over their subtrees at once. Each depth is one written
table: it is the output of its nodes and the input of the next step.

A sequence is an array of 128-bit turn hashes, cut into blocks of BLOCK turns:
a row holds the block its last turn lies in and the hash of everything before.
When a block is used up, the rows take the block before it from their smallest
member. So a row stays small however long a conversation is. Equal
conversations become one row with a count first, and a tail of blocks that only
one distinct conversation reaches is written down without peeling, as nothing
merges there; the number of steps is the greatest depth two different
conversations share, rounded up to a block (or the greatest length within it).

A parent with more than a HOT_SHARE-th part of all nodes as children (there
are at most HOT_SHARE such parents, at every input size) finds its children by
broadcast, the others by an equi-join, so no key holds more than that part.

Identifiers of the conversations that end at a node are joined in order, in
pieces of PIECE consecutive numbers, and the pieces of a node stream through
one SHA-256 state; texts never move, only their hashes and lengths.

Defined results: NULL roles and texts are empty; turns are ordered by number
(NULL first), ties by two hashes of role and text; rows without conv_id belong
to no conversation and take no part; repeated rows are repeated turns; an
empty table has no nodes. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import partitions, running_totals, saved, shared_path

BLOCK = 16
PIECE = 4096
HOT_SHARE = 1000
TURNS_PER_BUCKET = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv, pos, a1, a2, size): position from 0, two hashes of role and text, UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    t = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a1"), F.xxhash64(F.lit(7), text, F.lit(11), role).alias("a2"),
        F.octet_length(text).cast("long").alias("size"))
    t = t.withColumn("bucket", F.floor(F.col("turn") / TURNS_PER_BUCKET))
    order = [F.col("turn").asc_nulls_first(), F.col("a1"), F.col("a2")]
    return running_totals(t, ["conv"], "bucket", order, {"pos": (F.lit(1), False)}).drop("turn", "bucket")


def shared_heads(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv) and turns rebuilt so that related ones share a head.

    Conversation c gets the first h turns of conversation ``c - c % group``
    (h = crc32 of c as text, modulo ``heads``), then its own after its first h.
    """
    turns = saved(turns, "turns")
    base = F.col("conv") - F.col("conv") % group
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = convs.select("conv", base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"))
    # At most heads - 1 rows a base, and at most 2 * group - 1 conversations share one.
    first = turns.where(f"pos < {heads - 1} and conv % {group} = 0").select(F.col("conv").alias("base"), "pos", "a1", "a2", "size")
    head = convs.join(first, "base").where("pos < h").select("conv", "pos", "a1", "a2", "size")
    moved = head.groupBy("conv").agg(F.count("*").alias("n_head"))
    rule = convs.join(moved, "conv", "left").select("conv", "h", F.coalesce("n_head", F.lit(0)).alias("n_head"))
    rest = turns.join(rule, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "a1", "a2", "size")
    return convs.select("conv"), head.unionByName(rest)


def path_blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, b1, b2, size_before, path): BLOCK turns a row; b1, b2 hash all turns before the block."""
    h1 = F.xxhash64("pos", "a1", "a2").alias("h1")
    h2 = F.xxhash64("a2", "pos", F.lit(3), "a1").alias("h2")
    t = turns.select("conv", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), F.struct("pos", h1, h2, "size").alias("turn"))
    b = t.groupBy("conv", "block").agg(F.array_sort(F.collect_list("turn")).alias("s"))
    b = b.select("conv", "block", F.transform("s", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["size"].alias("size"))).alias("path"))
    b = b.withColumn("x1", lane("path", "h1")).withColumn("x2", lane("path", "h2")).withColumn("x3", sizes("path"))
    b = b.withColumn("bucket", F.floor(F.col("block") / TURNS_PER_BUCKET))
    b = running_totals(b, ["conv"], "bucket", ["block"], {"b1": (F.col("x1"), True), "b2": (F.col("x2"), True), "size_before": (F.col("x3"), False)})
    return b.select("conv", "block", "b1", "b2", "size_before", "path")


def lane(path: str | Column, field: str) -> Column:
    return F.aggregate(path, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x[field]))


def sizes(path: str | Column) -> Column:
    return F.aggregate(path, F.lit(0).cast("long"), lambda acc, x: acc + x["size"])


def conversation_classes(convs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal conversations as one: (conv, k1, k2, length, size, n), conv the smallest; and every (conv, k1, k2, length)."""
    whole = blocks.groupBy("conv").agg(
        F.bit_xor(F.col("x1")).alias("k1"), F.bit_xor(F.col("x2")).alias("k2"),
        F.sum("n_turns").alias("length"), F.sum("x3").alias("size"))
    every = convs.join(whole, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("k1", "k2", "length", "size")])
    every = saved(every, "conversations")
    one = every.groupBy("k1", "k2", "length", "size").agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    return saved(one, "classes"), every


def end_hashes(every: DataFrame) -> DataFrame:
    """(length, k1, k2, ends): SHA-256 of the ascending identifiers of each class, comma-joined.

    Pieces are built in parallel; a class then needs one pass in one place (a
    hash of a sequence has no other way), which holds one piece at a time.
    """
    pieces = every.groupBy("length", "k1", "k2", F.floor(F.col("conv") / PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    n = partitions(every.sparkSession)
    dealt = pieces.repartition(n, "length", "k1", "k2").sortWithinPartitions("length", "k1", "k2", "piece")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for length, k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in ("length", "k1", "k2", "ids")]):
                if (length, k1, k2) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (length, k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield as_batch(done)
        if key is not None:
            yield as_batch([(*key, state.hexdigest())])

    def as_batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["length", "k1", "k2", "ends"])

    return dealt.mapInArrow(digest, "length long, k1 long, k2 long, ends string")


NODE = ["depth", "conv", "b1", "b2", "path", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def lone_tails(classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv, from_block): the first block (not block 0) from which on no other distinct conversation follows."""
    own = classes.select("conv").join(blocks.where("block >= 1"), "conv")
    lone = own.groupBy("block", "b1", "b2").agg(F.count("*").alias("c"), F.min("conv").alias("conv")).where("c = 1")
    return lone.groupBy("conv").agg(F.min("block").alias("from_block"))


def tail_nodes(classes: DataFrame, blocks: DataFrame, tails: DataFrame) -> DataFrame:
    """Nodes of the tails: one child each (none at the end), one leaf, all sums known from the conversation itself."""
    t = blocks.join(tails, "conv").where("block >= from_block").join(classes.select("conv", "length", "size", "n"), "conv")
    t = t.select("*", F.posexplode("path").alias("i", "last"))
    before = F.col("size_before") + sizes(F.slice("path", F.lit(1), F.col("i")))
    depth = F.col("block") * BLOCK + F.col("i") + 1
    return t.select(depth.cast("long").alias("depth"), "conv", "b1", "b2", F.slice("path", F.lit(1), F.col("i") + 1).alias("path"),
                    F.col("n").alias("n_convs"), (depth < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                    ((F.col("n") - 1) * (F.col("size") - before)).alias("saved_tokens"))


def peel(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes of the trie with NODE's columns, and (length, k1, k2, ends) of the classes that end at a node."""
    spark = convs.sparkSession
    raw = saved(path_blocks(turns), "blocks")
    sums = raw.select("conv", lane("path", "h1").alias("x1"), lane("path", "h2").alias("x2"), sizes("path").alias("x3"), F.size("path").alias("n_turns"))
    classes, every = conversation_classes(convs, sums)
    blocks = saved(classes.select("conv").join(raw, "conv"), "class_blocks")
    tails = saved(lone_tails(classes, blocks), "tails")

    # What enters the peeling, by depth: conversations that end there, and the first turn below which a lone tail hangs.
    last = classes.where("length >= 1").join(tails, "conv", "left").where("from_block is null")
    ended = last.withColumn("block", F.floor((F.col("length") - 1) / BLOCK)).join(blocks, ["conv", "block"]).select(
        F.col("length").alias("depth"), "conv", "b1", "b2", "path", "n", F.lit(0).cast("long").alias("child"),
        F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("below"))
    hung = tails.join(classes, "conv").withColumn("block", F.col("from_block") - 1).join(blocks, ["conv", "block"]).select(
        (F.col("from_block") * BLOCK).alias("depth"), "conv", "b1", "b2", "path", "n", F.lit(1).cast("long").alias("child"),
        F.lit(1).cast("long").alias("leaves"), ((F.col("n") - 1) * (F.col("size") - F.col("size_before") - sizes("path"))).alias("below"))
    none = classes.where("length = 0").select(
        F.lit(0).cast("long").alias("depth"), "conv", F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2"),
        F.expr("cast(array() as array<struct<h1: bigint, h2: bigint, size: bigint>>)").alias("path"), "n", *[F.lit(0).cast("long").alias(c) for c in ("child", "leaves", "below")])
    enter_path = shared_path(spark, "enter")
    entering = ended.unionByName(hung).unionByName(none)
    entering.write.partitionBy("depth").parquet(enter_path)
    entering = spark.read.schema(entering.schema).parquet(enter_path)

    top = entering.agg(F.max("depth")).first()[0]
    out = shared_path(spark, "trie")
    known = tail_nodes(classes, blocks, tails).select(NODE)
    known.write.parquet(f"{out}/tails")
    state = None
    for depth in range(int(top), -1, -1) if top is not None else ():
        rows = entering.where(F.col("depth") == depth).drop("depth")
        if state is not None:
            rows = rows.unionByName(strip(state, depth, blocks))
        regroup(rows, depth).write.parquet(f"{out}/depth_{depth}")
        state = spark.read.schema(known.schema).parquet(f"{out}/depth_{depth}")
    nodes = spark.read.schema(known.schema).option("recursiveFileLookup", "true").parquet(out)
    return nodes, end_hashes(every)


def strip(state: DataFrame, depth: int, blocks: DataFrame) -> DataFrame:
    """Nodes of ``depth + 1`` without their last turn, as children of nodes of ``depth``."""
    child = ["conv", F.col("n_convs").alias("n"), F.lit(1).cast("long").alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("below")]
    if depth and depth % BLOCK == 0:  # the block is used up: go on with the one before it
        earlier = blocks.where(F.col("block") == depth // BLOCK - 1).select("conv", "b1", "b2", "path")
        return state.drop("b1", "b2", "path").join(earlier, "conv").select("b1", "b2", "path", *child)
    return state.select("b1", "b2", F.slice("path", 1, depth % BLOCK).alias("path"), *child)


def regroup(rows: DataFrame, depth: int) -> DataFrame:
    """One node for every truncated sequence."""
    g = rows.groupBy("b1", "b2", "path").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"),
        F.sum("leaves").alias("leaves"), F.sum("below").alias("below"))
    own = (F.col("n_convs") - 1) * F.element_at("path", -1)["size"] if depth else F.lit(0)
    return g.select(F.lit(depth).cast("long").alias("depth"), "conv", "b1", "b2", "path", "n_convs", "n_children",
                    F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("below") + own).cast("long").alias("saved_tokens"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv, the smallest member of each node's parent (NULL at the root)."""
    key = ["depth", "k1", "k2"]
    n = nodes.withColumn("k1", F.col("b1").bitwiseXOR(lane("path", "h1"))).withColumn("k2", F.col("b2").bitwiseXOR(lane("path", "h2")))
    n = saved(n.select(*key, *[F.when(F.col("depth") > 0, F.col(k).bitwiseXOR(F.try_element_at("path", F.lit(-1))[h])).alias(p) for k, h, p in (("k1", "h1", "p1"), ("k2", "h2", "p2"))],
                       "conv", "n_convs", "n_children", "n_leaves", "saved_tokens"), "nodes")
    parents = n.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv"), "n_children")
    limit = F.lit(n.count()) / HOT_SHARE
    # All n_children add up to less than the number of nodes: at most HOT_SHARE rows.
    hot = parents.where(F.col("n_children") > limit).drop("n_children").withColumnRenamed("parent_conv", "hot_conv")
    up = ["depth", "p1", "p2"]
    marked = n.join(F.broadcast(hot), up, "left")
    done = marked.where("hot_conv is not null or depth = 0").withColumnRenamed("hot_conv", "parent_conv")
    rest = marked.where("hot_conv is null and depth > 0").drop("hot_conv").join(parents.drop("n_children"), up)
    return done.unionByName(rest)


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    nodes, ends = peel(convs, turns)
    full = with_parents(nodes)
    ends = ends.withColumnRenamed("length", "depth")
    return full.join(ends, ["depth", "k1", "k2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


#: DuckDB twin over ``conversations`` (5 conversations to a head, 9 head lengths): prefixes as text.
SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
     crc AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
                    lambda ch: list_concat([ascii(ch)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
                    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), 4294967295) % 9 AS h
             FROM (SELECT DISTINCT c FROM t)),
     head AS (SELECT crc.c, t.pos, t.role, t.text FROM crc JOIN t ON t.c = crc.c - crc.c % 5 AND t.pos < crc.h),
     r AS (SELECT * FROM head UNION ALL
           SELECT t.c, t.pos - crc.h + (SELECT count(*) FROM head WHERE head.c = t.c), t.role, t.text FROM t JOIN crc ON t.c = crc.c WHERE t.pos >= crc.h),
     p AS (SELECT c, pos + 1 AS d, strlen(text) AS size,
                  string_agg(role || chr(31) || text || chr(30), '') OVER (PARTITION BY c ORDER BY pos) AS key,
                  coalesce(string_agg(role || chr(31) || text || chr(30), '') OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up FROM r
           UNION ALL SELECT c, 0, 0, '', NULL FROM crc),
     len AS (SELECT c, max(d) AS n FROM p GROUP BY c),
     node AS (SELECT key, d, any_value(up) AS up, any_value(size) AS size, min(p.c) AS c, count(*) AS n_convs,
                     sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (d = len.n), '')) AS ends_sha256
              FROM p JOIN len ON p.c = len.c GROUP BY key, d),
     kid AS (SELECT up AS key, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY up, d),
     full_node AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid ON node.key = kid.key AND node.d = kid.d),
     sub AS (SELECT a.key, a.d, sum((b.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens
             FROM full_node b JOIN p a ON a.c = b.c AND a.d <= b.d GROUP BY a.key, a.d)
SELECT f.c AS conv_id, f.d AS depth, par.c AS parent_conv_id, f.n_convs, f.n_children, sub.n_leaves, sub.saved_tokens, f.ends_sha256
FROM full_node f JOIN sub ON f.key = sub.key AND f.d = sub.d
LEFT JOIN full_node par ON par.key = f.up AND par.d = f.d - 1
"""
