"""Document fingerprints by SpotSigs (operator 7, DataFrame operations only).

A spot is an anchor (a common word of the supported languages) with the chain
of the CHAIN content words that follow it, other common words skipped. The set
of hashed chains is the document's signature set; the fingerprint is that set,
sorted, eight hexadecimal digits each. Frequent boilerplate has few anchors,
so the sets follow the running text. A text without any spot has one signature
of its whole normalised text. ``fingerprints`` compares given pairs by the
Jaccard similarity of their sets; ``similar_pairs`` compares all documents.

Across the corpus, equal sets form one class first. Set lengths are cut into
partitions so wide that sets of two partitions apart cannot be similar. A class
posts its rarest signatures, as many as one of which two similar sets must
share, and meets the classes of its own and the next shorter partition there. A
pair is dropped when what is left of both sets after their first common
signature cannot reach the overlap that the lengths ask for; the sets of the rest
are intersected. No posting is cut off and no pair is lost.

NULL and empty texts have the signature of the empty text. Equal texts have
equal fingerprints. "Next" follows descending ids (NULL ids last, repeated ids
by text hash), and the last document is followed by the first. The neighbour is
found in range buckets of the id, with one boundary row per bucket, so no
window spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from basketlens.llm.common import partitions, saved

CHAIN = 2
#: Anchors, common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his if in is it its not of on or she that the their they this to was we were which will with you "
    "au aux ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "als am auch auf aus bei bin bist da das dass dem den der die ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sich sie sind so und von vor war wie wir zu zum zur "
    "al como con del el era ella ese esta este fue ha hay la las lo los más me mi muy no nos para pero por se ser si sin sobre su sus también te tu una uno y ya"
).split()
_MARK = "#"


def normalised(text: Column) -> Column:
    """Lower-cased words separated by single blanks, each anchor replaced by a mark."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " ")
    anchors = "|".join(sorted(set(ANCHORS)))
    return F.regexp_replace(words, rf"(?<![^ ])(?:{anchors})(?![^ ])", _MARK)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct chain hashes of a text (array<int>)."""

    def of(t):
        chains = F.regexp_extract_all(t, F.lit(rf"{_MARK}(?=((?:(?: {_MARK})*+ [^ {_MARK}]++){{{chain}}}))"), F.lit(1))
        hashes = F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.hash(F.replace(c, F.lit(f" {_MARK}"), F.lit(""))))))
        return F.when(F.size(hashes) > 0, hashes).otherwise(F.array(F.hash(t)))

    return F.transform(F.array(normalised(text)), of)[0]


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without intersecting when the lengths rule out ``floor``."""
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(bound < floor, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, sigs, next_text, next_sigs) with the next document in descending id order."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, high = src.agg(F.min(F.col("id").cast("double")), F.max(F.col("id").cast("double"))).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    n_buckets = 4 * partitions(spark)
    width = (high - low) / n_buckets or 1.0
    bucket = F.coalesce(F.least(F.floor((F.col("id").cast("double") - low) / width), F.lit(n_buckets - 1)), F.lit(-1)).cast("int")
    src = src.select("id", "text", bucket.alias("bucket"), signatures(F.col("text")).alias("sigs"), F.xxhash64("text").alias("tie"))
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("text")]
    src = src.withColumn("next", F.lead(F.struct("text", "sigs")).over(Window.partitionBy("bucket").orderBy(*order)))
    first = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = first.select(bucket.alias("b"), F.struct(-F.coalesce(F.col("id").cast("decimal(38,0)"), F.lit(0)), F.xxhash64("text").alias("tie"), "text").alias("k"))
    heads = first.groupBy("b").agg(F.min("k").alias("k")).select("b", F.col("k.text").alias("text"))
    # one row per bucket: the head of the next lower bucket, wrapping around
    down = Window.orderBy(F.col("b").desc())
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("b"), F.coalesce(F.lead("text").over(down), F.first("text").over(every)).alias("head"))
    heads = heads.select("b", F.struct(F.col("head").alias("text"), signatures(F.col("head")).alias("sigs")).alias("over"))
    out = src.join(heads, F.col("bucket") == F.col("b"))
    nxt = F.coalesce(F.col("next"), F.col("over"))
    return out.select("id", "text", "sigs", nxt["text"].alias("next_text"), nxt["sigs"].alias("next_sigs"))


def edited_text(text: Column, following: Column) -> Column:
    """The last third of a text replaced by as many leading characters of the following one."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprints of the text and of its edited text, and likenesses."""
    d = with_next(docs, id_col, text_col)
    edited = F.transform(F.array(edited_text(F.col("text"), F.col("next_text"))), lambda e: F.struct(F.sha2(e, 256).alias("sha"), signatures(e).alias("sigs")))[0]
    d = d.select("id", F.length("text").cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("e"))
    return d.select(F.col("id").alias(id_col), "n_chars", F.col("e.sha").alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
                    fingerprint(F.col("e.sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("e.sigs")).alias("near_edited"),
                    likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), F.size("sigs").alias("n_signatures"))


def length_bounds(percent: int, largest: int = 1 << 31) -> list[int]:
    """First set length of each partition; similar sets lie in the same partition or in neighbouring ones."""
    out = [1]
    while out[-1] < largest:
        out.append(100 * out[-1] // percent + 1)
    return out


def signature_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, class_key, sigs); documents with equal signature sets share the key (128 bits)."""
    d = docs.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("sigs"))
    return d.select("id", F.md5(F.array_join(F.transform("sigs", lambda x: x.cast("string")), ",")).alias("class_key"), "sigs")


def similar_pairs(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of all documents whose signature sets have a Jaccard similarity of ``percent`` hundredths or more.

    ``pairs`` holds (left_key, right_key, left_id, right_id, common, similarity), left_key < right_key, one row
    per two similar classes of different sets, with the smallest id of each; ``members`` holds
    (id_col, class_key, class_size), one row per document. Members of one class are similar to each
    other and to all members of classes paired with theirs.
    """
    if not 50 <= percent <= 99:
        raise ValueError("percent must lie from 50 to 99")
    rows = saved(signature_classes(docs, id_col, text_col), "spot-classes")
    sets = rows.groupBy("class_key").agg(F.min("id").alias("id"), F.any_value("sigs").alias("sigs"), F.count("*").alias("class_size"))
    sets = saved(sets.withColumn("n", F.size("sigs")), "spot-sets")
    members = rows.select("id", "class_key").join(sets.select("class_key", "class_size"), "class_key")
    members = members.select(F.col("id").alias(id_col), "class_key", "class_size")

    spots = sets.select("class_key", "n", F.explode("sigs").alias("sig"))
    spots = spots.join(spots.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    # rarest first; a signature of one class only meets nothing, but holds its place in the order
    ranked = spots.groupBy("class_key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    least = F.floor((F.lit(percent) * F.col("n") + 99) / 100).cast("int")
    bounds = F.array(*[F.lit(b).cast("long") for b in length_bounds(percent)])
    part = F.size(F.filter(bounds, lambda b: b <= F.col("n")))
    posts = ranked.select("class_key", "n", part.alias("part"), F.posexplode(F.slice("by_df", F.lit(1), F.col("n") - least + 1)).alias("at", "spot"))
    posts = saved(posts.where("spot.df > 1").select("class_key", "n", "part", "at", F.col("spot.sig").alias("sig")), "spot-posts")

    here = posts.select("sig", "part", F.col("class_key").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"))
    probe = posts.select("sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), F.col("part").alias("own"),
                         F.col("class_key").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    met = here.join(probe, ["sig", "part"]).where((F.col("own") > F.col("part")) | (F.col("a") < F.col("b")))
    met = met.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    met = met.groupBy("a", "b", "na", "nb").agg(F.min("ia").alias("ia"), F.min("ib").alias("ib"))
    reach = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    met = met.where(reach * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")

    left = sets.select(F.col("class_key").alias("a"), F.col("id").alias("id_a"), F.col("sigs").alias("sigs_a"))
    right = sets.select(F.col("class_key").alias("b"), F.col("id").alias("id_b"), F.col("sigs").alias("sigs_b"))
    out = met.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sigs_a", "sigs_b")))
    union = F.size("sigs_a") + F.size("sigs_b") - F.col("common")
    out = out.where(F.col("common") * 100 >= union * percent)
    swap = F.col("a") > F.col("b")
    pairs = out.select(F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key"),
                       F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("left_id"),
                       F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("right_id"), "common", (F.col("common") / union).alias("similarity"))
    return pairs, members
