"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches
merge (the k smallest of a union are the sketch of the concatenated parts' shingle sets), and give estimates of
resemblance, containment and the number of distinct shingles. A sketch of under k hashes is the whole set, and then
the estimates are exact.

Words are runs without ASCII white space. A text of fewer than five words, but not none, has its whole word sequence
as its one shingle; null and wordless texts have an empty sketch, alike (1.0) to another empty one and to nothing
else. Rows that share an id are each fingerprinted; as a next document they stand as the smallest of their texts. A
row without an id has an empty next document. Equal hashes count once. Very long texts are sketched whole, one row at a
time. An empty table gives an empty result; other columns aren't read, so their names may be any.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, stored, whole

K = 128
WORDS = 5
#: xxhash64 spreads over all signed longs: 2^64 values from -2^63 on.
SPAN, LEAST = float(2**64), float(-(2**63))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles of a text, repeated ones included."""
    tokens = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(parts: Column) -> Column:
        return (
            F.when(F.size(parts) >= words, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(parts, i, words))))
            .when(F.size(parts) > 0, F.array(F.xxhash64(parts)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return F.element_at(F.transform(F.array(tokens), of), 1)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return bottom_k(shingle_hashes(text, words), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return bottom_k(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes that both have."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) over the share of the hash range that the k smallest take."""
    reach = (F.element_at(a, k).cast("double") - F.lit(LEAST)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: intersection (resemblance times union size) over a's size."""
    met = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), met / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def as_text(a: Column) -> Column:
    """16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def next_ids(ids: DataFrame, doc_id: str = "doc_id", block_rows: int = 50_000) -> DataFrame:
    """(doc_id, next_id): for each distinct id the next smaller one; for the smallest the largest. Ids of any ordered
    type.

    Blocks of about block_rows ids are cut by a range partitioning, which samples the ids, so that their spread
    doesn't matter; a block is a partition of a stored table. The one ordering across blocks is over a row for each.
    """
    distinct = ids.select(F.col(doc_id).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    blocks = max(1, math.ceil(distinct.count() / block_rows))
    placed = stored(distinct.repartitionByRange(blocks, "doc_id").withColumn("block", F.spark_partition_id()), "blocks")
    ends = placed.groupBy("block").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("last"))
    line = Window.orderBy("low")
    ends = ends.select("block", F.coalesce(F.lag("last").over(line), F.max("last").over(Window.partitionBy())).alias("below"))
    within = Window.partitionBy("block").orderBy("doc_id")
    return placed.withColumn("before", F.lag("doc_id").over(within)).join(F.broadcast(ends), "block").select("doc_id", F.coalesce("before", "below").alias("next_id"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, text, n_chars, opening (of the next text, half as long as this), next_sketch.

    The texts are shuffled once by id; the openings and sketches of next documents once more.
    """
    # one shuffle serves both joins as long as both sides have the same plan, so the id isn't aliased
    texts = docs.select(F.col(doc_id) if doc_id == "doc_id" else F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    known = texts.where(F.col("doc_id").isNotNull())
    ids = stored(known.select("doc_id", F.length("text").cast("long").alias("n_chars")), "ids")
    longest = ids.groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("n"))
    wants = next_ids(ids.select("doc_id")).join(longest, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    repeated = not longest.where("n > 1").isEmpty()
    one = known.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else known
    nexts = wants.join(one, "doc_id").select(F.col("for_id").alias("doc_id"), F.expr("left(text, need)").alias("opening"), sketch(F.col("text"), k).alias("next_sketch"))
    joined = known.join(nexts, "doc_id")
    orphans = texts.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit("").alias("opening"), F.array().cast("array<bigint>").alias("next_sketch"))
    return joined.unionByName(orphans).withColumn("n_chars", F.length("text").cast("long"))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        with_next(documents(spark, sf_dir))
        .withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - cast(floor(n_chars / 2) as int))"), F.substring(F.col("opening"), F.lit(1), half)))
        .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("other"), "next_sketch")
    )
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("own")).alias("n_shingles"),
    )
