"""Benchmark decontamination by Wu-Manber search over words.

Texts become word sequences: A-Z in lower case, words are runs of digits, letters and bytes from 0x80 on. A pattern is
a window of ten consecutive words of a benchmark item (an item of fewer words, but not none, is one window). Patterns
of one length are searched together. A shift table, indexed by a hash of a block of two words, says how far the
window's end can jump (the least jump of all blocks of that hash). Where it can't, the hashes of the window's last and
first block name a bucket, and each pattern of the bucket is compared directly.

The tables are byte and number arrays over the folded benchmark text, about five bytes for each of it, so that a
worker holds one part of the benchmark (PART_BYTES). A larger benchmark is searched part after part; each row carries
its hits along, so that rows never have to meet again and the result is that of one part.

Null and empty texts have no words and are never hit; empty benchmarks and tables give no hits and no rows; repeated
rows and repeated ids are searched each; items with equal windows all count; rows of one item_id are one item; items
without an id hit words but are in no list. Very long texts are read whole. Columns keep their names and values
whatever these are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, stored, whole

WINDOW = 10
#: Bytes of benchmark text that are searched at a time.
PART_BYTES = 16_000_000

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b + 32 if 0x41 <= b <= 0x5A else b) in _WORD else 0x20 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class WuManber:
    """Shift and bucket tables for the distinct word patterns of one length."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], length: int):
        self.length, self.block = length, min(2, length)
        #: Where a block isn't in a pattern, the window can jump past it.
        self.jump = length - self.block + 1
        self.items = [item for item, _ in items]
        self.text = b"\0".join(b" ".join(words) for _, words in items)
        rows = sum(len(words) - length + 1 for _, words in items)
        size = max(1 << 10, 1 << (8 * rows).bit_length())
        self.mask = size - 1
        shift = np.full(size, self.jump, np.uint8)
        keys, starts, ends, owners = np.zeros(rows, np.uint64), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int32)
        at = base = 0
        for owner, (_, words) in enumerate(items):
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            begins = base + np.cumsum(sizes + 1) - sizes - 1
            blocks = np.fromiter(map(self.hashed, range(self.block, len(words) + 1), [words] * len(words)), np.int64, len(words) - self.block + 1)
            n = len(words) - length + 1
            for back in range(self.jump):
                np.minimum.at(shift, blocks[self.jump - 1 - back : self.jump - 1 - back + n] & self.mask, back)
            keys[at : at + n] = (blocks[self.jump - 1 :].astype(np.uint64) << np.uint64(32)) | blocks[:n].astype(np.uint64)
            starts[at : at + n], owners[at : at + n] = begins[:n], owner
            ends[at : at + n] = begins[length - 1 :] + sizes[length - 1 :]
            at += n
            base += int(sizes.sum()) + len(words)
        self.shift = shift.tobytes()
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.ends, self.owners = keys[order], starts[order], ends[order], owners[order]

    def hashed(self, end: int, words: list[bytes]) -> int:
        return crc32(words[end - 2] + b" " + words[end - 1]) if self.block == 2 else crc32(words[end - 1])

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(position of the first word, numbers of the items) of each occurrence."""
        length, block, mask, shift, hashed = self.length, self.block, self.mask, self.shift, self.hashed
        end, most = length, len(words)
        while end <= most:
            last = hashed(end, words)
            far = shift[last & mask]
            if far:
                end += far
                continue
            key = np.uint64(last << 32 | hashed(end - length + block, words))
            first = int(np.searchsorted(self.keys, key))
            if first < len(self.keys) and self.keys[first] == key:
                window = b" ".join(words[end - length : end])
                found = []
                for i in range(first, int(np.searchsorted(self.keys, key, "right"))):
                    if self.text[self.starts[i] : self.ends[i]] == window:
                        found.append(int(self.owners[i]))
                if found:
                    yield end - length, found
            end += 1


def searchers(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One table for each pattern length. items: (id as text, text)."""
    by_length: dict[int, list[tuple[str | None, list[bytes]]]] = {}
    for item, raw in items:
        if words := words_of(raw):
            by_length.setdefault(min(window, len(words)), []).append((item, words))
    return [WuManber(group, length) for length, group in sorted(by_length.items())]


def spans(words: list[bytes], tables: list[WuManber], known: list[tuple[int, int]] = ()) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [first, end) word ranges that are hit, those of known among them, and the items that hit."""
    found: list[tuple[int, int]] = list(known)
    items: set[str] = set()
    for table in tables:
        for at, owners in table.find(words):
            found.append((at, at + table.length))
            items.update(table.items[i] for i in owners)
    items.discard(None)
    merged: list[tuple[int, int]] = []
    for first, end in sorted(found):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((first, end))
    return merged, items


def benchmark_parts(benchmark: DataFrame, item_id: str, text: str, part_bytes: int) -> Iterator[tuple[bool, list[tuple[str | None, bytes]]]]:
    """(whether it is the last, (item, text) rows) of parts of about part_bytes, by a hash of the text."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), whole(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else items
        yield part == parts - 1, [(r["item_id"], r["text"].encode()) for r in chosen.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, spans (word ranges that are hit), items (ids, as text in order). A row for each of docs."""
    span = "array<struct<first:bigint,end:bigint>>"
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast(span).alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = rows.schema
    for last, items in benchmark_parts(benchmark, item_id, item_text, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(searchers(items, window))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables = shared.value
            kinds = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            for batch in batches:
                counts, ranges, owners = [], [], []
                for x, known, before in zip(batch.column(1).cast(pa.binary()), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    words = words_of(x.as_py())
                    merged, hit = spans(words, tables, [(s["first"], s["end"]) for s in known])
                    counts.append(len(words))
                    ranges.append([{"first": a, "end": b} for a, b in merged])
                    owners.append(sorted(hit.union(before)))
                made = [pa.array(counts, pa.int64()), pa.array(ranges, kinds), pa.array(owners, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["doc_id", "text", "n_words", "spans", "items"]).select(kept)

        kept = ["doc_id", "n_words", "spans", "items"] if last else schema.names
        found = rows.mapInArrow(search, rows.select(*kept).schema)
        rows = found if last else stored(found, "searched")
    return rows


def is_free(shared: Broadcast) -> Callable[[Column], Column]:
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = shared.value
        for texts in parts:
            yield pa.array([next((False for table in tables for _ in table.find(words_of(x.as_py()))), True) for x in texts.cast(pa.binary())], pa.bool_())

    return F.arrow_udf(clean, "boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of docs, all columns as they are, whose text holds no window of the benchmark. Only texts go to Python."""
    for last, items in benchmark_parts(benchmark, item_id, item_text, part_bytes):
        free = docs.where(is_free(docs.sparkSession.sparkContext.broadcast(searchers(items, window)))(whole(text)))
        docs = free if last else stored(free, "searched")
    return docs


def hit_words(ranges: str = "spans") -> Column:
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    counted = found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return counted.withColumn("contaminated", F.col("n_hit") > 0)
