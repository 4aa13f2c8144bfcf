"""Byte-level BPE encoding and decoding.

A text is cut into words by the tokenizer's pattern. Each distinct word's bytes are folded: the adjacent pair of the
lowest rank, the leftmost of equal ones, is merged until no pair has a rank. Decoding looks up each id's bytes and
concatenates them.

Two forms with the same results. NativeBPE folds with higher-order functions over a literal rank map (an array of
small maps by crc32 of the piece, since a look-up in a Spark map is a scan); use it on words, distinct ones first.
encode_documents() folds in Arrow tasks: a worker keeps its distinct words between batches and folds only new ones, so
that no word list of the whole corpus has to fit anywhere and no text is shuffled. README.md has the figures that
decide for it on whole corpora.

Null counts as the empty text: no ids. Repeated rows and ties give the same ids each; an empty table gives an empty
result; other columns aren't read, so their names may be any. Very long texts are encoded whole, one at a time; a very
long word (LONG bytes and more) is folded over a heap of its pairs.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, whole

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A worker keeps the ids of so many distinct words.
CACHE = 600_000
#: Unicode's White_Space, which the pattern means by \s; Java's \s is ASCII only.
SPACE = r"\t-\r \u0085   -     　"


#: Words of more bytes are folded with a heap.
LONG = 200
#: After every rank.
FAR = 2_000_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def java_pattern(pattern: str) -> str:
    inside = pattern.replace(r"[^\s", "[^" + SPACE)
    return inside.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def literal_map(entries: dict[str, object], kind: str) -> Callable[[Column], Column]:
    """A look-up (null if absent) in a literal array of maps, about two entries each."""
    size = 1 << max(1, (len(entries) // 2).bit_length())
    cells: list[dict[str, object]] = [{} for _ in range(size)]
    for key, value in entries.items():
        cells[zlib.crc32(key.encode()) & (size - 1)][key] = value
    literal = F.from_json(F.lit(json.dumps(cells)), f"array<map<string,{kind}>>")
    return lambda key: F.try_element_at(F.element_at(literal, (F.crc32(key).bitwiseAND(F.lit(size - 1)) + 1).cast("int")), key)


class NativeBPE:
    """Expressions for one rank map."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = literal_map({piece.hex().upper(): rank for piece, rank in ranks.items()}, "int")
        by_rank = {rank: piece for piece, rank in ranks.items()}
        size = max(by_rank) + 1
        self.bytes_of = F.from_json(F.lit(json.dumps([by_rank.get(i, b"").hex().upper() for i in range(size)])), "array<string>")
        self.words_of = F.from_json(F.lit(json.dumps([i.to_bytes(4, "little").hex().upper() for i in range(size)])), "array<string>")

    def fold(self, word: Column) -> Column:
        """Ids of one word."""
        kind = "struct<parts:array<string>,ranks:array<int>>"

        def start(raw: Column) -> Column:
            parts = F.regexp_extract_all(raw, F.lit(".."), F.lit(0))
            return F.struct(parts.alias("parts"), F.transform(F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("a"), F.slice(parts, 2, F.size(parts)).alias("b")), lambda p: F.coalesce(self.rank(F.concat(p["a"], p["b"])), F.lit(FAR))).alias("ranks")).cast(kind)

        def step(state: Column, _: Column) -> Column:
            return let(F.array_min(state["ranks"]), lambda least: F.when(least.isNull() | (least == FAR), state).otherwise(let(F.array_position(state["ranks"], least).cast("int"), lambda at: merge(state["parts"], state["ranks"], at))))

        def merge(parts: Column, ranks: Column, at: Column) -> Column:
            def joined(whole_piece: Column) -> Column:
                before = F.when(at > 1, F.array(F.coalesce(self.rank(F.concat(F.element_at(parts, F.greatest(at - 1, F.lit(1))), whole_piece)), F.lit(FAR)))).otherwise(F.array().cast("array<int>"))
                after = F.when(at + 1 < F.size(parts), F.array(F.coalesce(self.rank(F.concat(whole_piece, F.element_at(parts, F.least(at + 2, F.size(parts))))), F.lit(FAR)))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(parts, 1, at - 1), F.array(whole_piece), F.slice(parts, at + 2, F.size(parts))).alias("parts"),
                    F.concat(F.slice(ranks, 1, F.greatest(at - 2, F.lit(0))), before, after, F.slice(ranks, at + 2, F.size(parts))).alias("ranks"),
                ).cast(kind)

            return let(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)), joined)

        def folded(raw: Column) -> Column:
            own = self.rank(raw)
            merges = F.sequence(F.lit(1), F.greatest(F.length(raw) / 2 - 1, F.lit(1)).cast("int"))
            return F.when(own.isNotNull(), F.array(own)).otherwise(F.aggregate(merges, start(raw), step, lambda s: F.transform(s["parts"], self.rank)))

        return let(F.hex(F.encode(word, "utf-8")), folded)

    def decode(self, ids: Column) -> Column:
        """The bytes of ids, concatenated."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(self.bytes_of, i + 1)), ""))

    def packed(self, ids: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(self.words_of, i + 1)), ""))


class Words:
    """A worker's vocabulary and its distinct words."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        self.ranks = read_ranks(path)
        self.bytes_of = {rank: piece for piece, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.most = cache

    def fold(self, raw: bytes) -> list[int]:
        """Ids of one word."""
        own = self.ranks.get(raw)
        if own is not None:
            return [own]
        if len(raw) > LONG:
            return self.fold_long(raw)
        rank = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        order = [rank(raw[i : i + 2], FAR) for i in range(len(raw) - 1)]
        while order:
            least = min(order)
            if least == FAR:
                break
            at = order.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank(parts[at - 1] + parts[at], FAR)
            if at < len(order):
                order[at] = rank(parts[at] + parts[at + 1], FAR)
        return [self.ranks[p] for p in parts]

    def fold_long(self, raw: bytes) -> list[int]:
        """fold() in n log n steps: pieces are a linked list by their first bytes, pairs wait in a heap by rank and
        place; one whose pieces have changed since is passed over."""
        rank, end = self.ranks.get, len(raw)
        after, before, reach = list(range(1, end + 1)), list(range(-1, end - 1)), [*range(1, end + 1)]
        waiting = [(r, i, i + 2) for i in range(end - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapify(waiting)
        gone = bytearray(end)
        while waiting:
            _, at, upto = heappop(waiting)
            right = after[at]
            if gone[at] or right >= end or reach[right] != upto:
                continue
            gone[right], reach[at], after[at] = 1, upto, after[right]
            if after[at] < end:
                before[after[at]] = at
                if (r := rank(raw[at : reach[after[at]]])) is not None:
                    heappush(waiting, (r, at, reach[after[at]]))
            if (left := before[at]) >= 0 and (r := rank(raw[left:upto])) is not None:
                heappush(waiting, (r, left, upto))
        return [self.ranks[raw[i : reach[i]]] for i in range(end) if not gone[i]]

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        words = self.find(text)
        got = list(map(self.known.get, words))
        if None in got:
            for at, ids in enumerate(got):
                if ids is None:
                    ids = self.known.get(words[at])
                    if ids is None:
                        if len(self.known) >= self.most:
                            self.known.clear()
                        ids = self.known[words[at]] = np.array(self.fold(words[at].encode()), "<u4").tobytes()
                    got[at] = ids
        return b"".join(got)

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def words_of(name: str) -> Words:
    """One object per Python worker; it keeps its words between tasks."""
    import public_tokenizers

    return Words(public_tokenizers.path(name), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int)."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words_of(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                packed = [own.packed(x.as_py()) for x in part.column(1)]
                ends = np.cumsum([0, *map(len, packed)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return kept.mapInArrow(encoded, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, raw (the bytes that the ids stand for)."""
    kept = encoded.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words_of(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decoded(x) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "raw"])

    return kept.mapInArrow(decoded, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, raw binary")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of packed ids), decoded_sha256 (of the bytes decoded from these ids)."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words_of(vocabulary)
        for batch in batches:
            counts, ids_sha, raw_sha = [], [], []
            for x in batch.column(1):
                packed = own.packed(x.as_py())
                counts.append(len(packed) // 4)
                ids_sha.append(sha256(packed).hexdigest())
                raw_sha.append(sha256(own.decoded(np.frombuffer(packed, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(digested, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words_of(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                packed = [own.packed(x) for x in texts]
                same = [own.decoded(np.frombuffer(p, "<u4").tolist()) == x.encode() for p, x in zip(packed, texts, strict=True)]
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "decodes"])

    return kept.mapInArrow(encoded, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids array<int>, decodes boolean")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trip(documents(spark, sf_dir))
