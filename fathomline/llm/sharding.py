"""Shards of near-equal bytes: minimax contiguous partition over ordered atomic groups.

Equal texts form a group, which is never cut. Groups are ordered by 16 bits of a hash of their text; the atomic
sizes of the search are the sums of the 65,536 hash buckets, so the driver holds 65,536 numbers whatever the
input. A bucket larger than an even share gets a shard of its own; over the rest, in order, the smallest feasible
capacity is found by binary search with a greedy check, and the order is cut there.

Nulls count as empty texts (size 16, crc32 0) and form a group with them. Repeated rows each get a slot. An empty
table gives an empty result. Very long texts weigh what they weigh; only hashes and sizes are shuffled. Other columns
aren't read, so their names may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, stored, whole

BUCKET_BITS = 16
ROW_BYTES = 16


def feasible(sizes: list[int], parts: int, capacity: int) -> bool:
    """Greedy check: do the ordered sizes fit into so many contiguous parts of this capacity?"""
    used, held = 1, 0
    for size in sizes:
        if size > capacity:
            return False
        if held + size > capacity:
            used, held = used + 1, 0
            if used > parts:
                return False
        held += size
    return True


def smallest_capacity(sizes: list[int], parts: int) -> int:
    """Binary search for the smallest capacity that feasible() accepts."""
    low, high = max([-(-sum(sizes) // parts), *sizes]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(sizes, parts, middle) else (middle + 1, high)
    return low


def minimax_cuts(sizes: list[int], parts: int) -> list[int]:
    """First positions of parts 1, 2, ... under the smallest capacity.

    Each part stops at its even share of what is left if the rest still fits below the capacity, so that the
    last part isn't left short; else the parts are filled greedily.
    """
    capacity = smallest_capacity(sizes, parts)
    for even in (True, False):
        cuts, held, left, fits = [], 0, sum(sizes), True
        for at, size in enumerate(sizes):
            share = (left + held) / (parts - len(cuts))
            full = held + size > capacity or (even and held + size / 2 > share)
            if held and full and len(cuts) < parts - 1:
                cuts.append(at)
                held = 0
            held += size
            left -= size
            fits = fits and held <= capacity
        if fits:
            break
    return cuts


def shard_plan(buckets: dict[int, int], shards: int) -> tuple[dict[int, int], list[int], int]:
    """(bucket: its own shard) for oversize buckets; the first buckets of the other shards after the first; the
    number of the first of those."""
    alone: dict[int, int] = {}
    rest = dict(buckets)
    while rest and len(alone) < shards - 1:
        share = sum(rest.values()) / (shards - len(alone))
        large = sorted((b for b, s in rest.items() if s > share and len(rest) > 1), key=lambda b: (-rest[b], b))
        if not large or rest[large[0]] < 1.5 * share:
            break
        alone[large[0]] = len(alone)
        del rest[large[0]]
    order = sorted(rest)
    cuts = minimax_cuts([rest[b] for b in order], shards - len(alone)) if order else []
    return alone, [order[c] for c in cuts], len(alone)


def shard_column(bucket: Column, plan: tuple[dict[int, int], list[int], int]) -> Column:
    alone, firsts, first = plan
    shard = F.lit(first)
    for cut in firsts:
        shard = shard + (bucket >= F.lit(cut)).cast("int")
    for own, number in alone.items():
        shard = F.when(bucket == F.lit(own), F.lit(number)).otherwise(shard)
    return shard.cast("int")


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot.

    Slots are numbered in cells of a shard (by a hash of the id, about 1,000 rows each), whose offsets come from a
    running sum of the cells' counts, so that no task sorts a whole shard.
    """
    body = whole(text)
    slim = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(body), 64 - BUCKET_BITS).cast("int").alias("bucket"),
        ),
        "shards",
    )
    sums = slim.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    plan = shard_plan({r["bucket"]: r["size"] for r in sums}, shards)
    rows = sum(r["n"] for r in sums)
    cell_rows = max(1000, rows // 1_000_000)
    cells = max(1, -(-rows // cell_rows))
    dealt = slim.withColumn("shard", shard_column(F.col("bucket"), plan)).withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(cells)).cast("int")).drop("bucket")
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id")
    numbered = dealt.withColumn("nth", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
