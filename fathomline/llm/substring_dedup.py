"""Removal of repeated passages by relative Lempel-Ziv parsing.

Words are runs without ASCII white space, unchanged. A window is WINDOW consecutive words of a text. A word goes if a
window over it also starts anywhere else, in the same text or another.

The reference is the corpus itself, cut into blocks of PIECE words (with a margin on each side). Its index holds
anchors: in each window the gram of GRAM words with the least hash, the first of equals, so that equal windows have
equal anchors at equal places. Of all places of an anchor one is its home; the others are factored against the block
around it: a factor grows from the anchor, to both sides, as long as the words agree, and takes in the next anchors
that lie on it. A factor of WINDOW words and more is a repeated span, here and at home. At a factor's boundaries, the
windows over an anchor that reach beyond its factor may still equal such windows of other texts, which have the same
anchor and left the same home: they meet by their digests, and those that occur twice are repeated too.

Why nothing is lost: equal windows share their anchor and its home, so either all of them agree with the home's words
or none does. Each place of an anchor meets one home, not all other places, so that work grows with the input; a
passage that is in a third of all texts is split by skew joins and summed before it is shuffled.

Null texts are empty. Equal texts are one text of several copies, whose windows all start elsewhere. Texts under
WINDOW words keep everything. Repeated rows are copies. Very long texts are cut into blocks; the row itself is read
whole. Empty tables give no rows; only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_chars, documents, small_batches, stored, whole

WINDOW, GRAM, PIECE = 35, 12, 256
#: Words on each side of a block that belong to its neighbours: windows over an anchor of the block lie inside.
MARGIN = WINDOW
#: Words whose codes a worker remembers.
REMEMBERED = 500_000
#: Bytes of text that are hashed at once.
AT_ONCE = 4_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOW = np.uint64((1 << 24) - 1)


class Codes(dict):
    """64-bit codes of words, the same on all machines."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return code


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash for each run of gram words."""
    n = len(codes) - gram + 1
    out = codes[:n].copy()
    for k in range(1, gram):
        out = out * _MIX[0] + codes[k : k + n]
    return mixed(out)


def anchors(codes: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of texts that stand one after the other, with the given ends. At most 2^24 words
    at once."""
    if len(codes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_hashes(codes, gram)
    # high bits of the hash above the place: the least is the first of those with the least high bits
    packed = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    wide, reach, least, done = packed, 1, None, 0
    span = window - gram + 1
    while reach <= span:  # the least of span neighbours, from those of 1, 2, 4, ... neighbours
        if span & reach:
            least = wide if least is None else np.minimum(least[: len(wide) - done], wide[done:])
            done += reach
        wide = np.minimum(wide[:-reach], wide[reach:]) if len(wide) > reach else wide[:0]
        reach *= 2
    least = least[: len(codes) - window + 1]
    starts = np.arange(len(least))
    inside = starts + window <= ends[np.searchsorted(ends, starts, "right")]
    places = np.unique(least[inside] & _LOW).astype(np.int64)
    return places, hashes[places]


def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (h, key, pos), most copies of a text once a task."""
    codes, known = Codes(), set()
    for batch in batches:
        keys = batch.column(0).to_pylist()
        fresh = [i for i, key in enumerate(keys) if not (key in known or known.add(key))]
        if len(known) > REMEMBERED:
            known.clear()
        batch = batch.take(pa.array(fresh, pa.int64()))
        for begin, end in by_chars(batch, 1, AT_ONCE):
            part = batch.slice(begin, end - begin)
            lists = [x.as_py().split() for x in part.column(1).cast(pa.binary())]
            ends = np.cumsum([len(words) for words in lists])
            found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            if ends[-1]:
                seen = np.fromiter((codes[w] for words in lists for w in words), np.uint64, int(ends[-1]))
                step = 1 << 23
                for low in range(0, len(seen), step):  # only a text of 8 million words and more takes several steps
                    high = min(len(seen), low + step + WINDOW)
                    at = np.append(ends[(ends > low) & (ends < high)], high) - low
                    places, hashes = anchors(seen[low:high], at)
                    found[0].append(places + low)
                    found[1].append(hashes)
            places, which = np.unique(np.concatenate(found[0]), return_index=True)
            hashes = np.concatenate(found[1])[which]
            owner = np.searchsorted(ends, places, "right")
            first = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), part.column(0).take(pa.array(owner)), pa.array(places - first[owner])], ["h", "key", "pos"])


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, wanted) to (key, piece, begin, words), the wanted pieces with their margins."""
    for batch in batches:
        for key, text, wanted in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            words, key = text.as_py().split(), key.as_py()
            wanted = wanted.as_py()
            for some in range(0, len(wanted), 1024):
                chosen = wanted[some : some + 1024]
                begins = [max(0, p * PIECE - MARGIN) for p in chosen]
                cut = [b" ".join(words[b : (p + 1) * PIECE + MARGIN]) for p, b in zip(chosen, begins, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(chosen), pa.binary()), pa.array(chosen, pa.int64()), pa.array(begins, pa.int64()), pa.array(cut, pa.binary())], ["key", "piece", "begin", "words"])


def extended(own: list[bytes], at: int, other: list[bytes], there: int) -> tuple[int, int]:
    """The range of own around at whose words agree with those of other around there."""
    low, shift = at, there - at
    least = max(0, -shift)
    while low > least and own[low - 1] == other[low - 1 + shift]:
        low -= 1
    high, most = at, min(len(own), len(other) - shift)
    while high < most and own[high] == other[high + shift]:
        high += 1
    return low, high


def factors(own: list[bytes], other: list[bytes], met: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, first, end, shift) for the anchors of own, in order, that stand in other: the factor that holds it."""
    grown: dict[int, tuple[int, int]] = {}
    for at, there in sorted(met):
        shift = there - at
        first, end = grown.get(shift, (0, -1))
        if at + GRAM > end:
            first, end = grown[shift] = extended(own, at, other, there)
        yield at, first, end, shift


class Marks:
    """Places of windows as bits, 256 for each block."""

    def __init__(self) -> None:
        self.bits: dict[tuple[bytes, int], int] = {}

    def add(self, key: bytes, first: int, end: int) -> None:
        while first < end:
            piece = first // PIECE
            stop = min(end, (piece + 1) * PIECE)
            bits = ((1 << (stop - first)) - 1) << (first - piece * PIECE)
            self.bits[key, piece] = self.bits.get((key, piece), 0) | bits
            first = stop


_MASKS = ["m0", "m1", "m2", "m3"]
_FACTORED = "key binary, piece bigint, m0 bigint, m1 bigint, m2 bigint, m3 bigint, digest binary, pos bigint"


def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, begin, words, homes) to marked windows and, at boundaries, digests of windows."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        marks, digests, keys, places = Marks(), [], [], []
        for row in batch.to_pylist():
            own, begin, key = row["words"].split(), row["begin"], row["key"]
            doubtful: set[int] = set()
            for home in row["homes"]:
                other, away = home["words"].split(), home["begin"]
                for at, first, end, shift in factors(own, other, [(m["pos"] - begin, m["home_pos"] - away) for m in home["met"]]):
                    if end - first >= WINDOW:
                        marks.add(key, begin + first, begin + end - WINDOW + 1)
                        marks.add(home["key"], away + first + shift, away + end + shift - WINDOW + 1)
                    lowest, highest = max(0, at + GRAM - WINDOW), min(at, len(own) - WINDOW)
                    doubtful.update(s for s in range(lowest, highest + 1) if s < first or s + WINDOW > end)
            for s in sorted(doubtful):
                digests.append(blake2b(b" ".join(own[s : s + WINDOW]), digest_size=16).digest())
                keys.append(key)
                places.append(begin + s)
        n, masks = len(marks.bits), [[signed(bits >> (64 * k) & (1 << 64) - 1) for bits in marks.bits.values()] + [None] * len(keys) for k in range(4)]
        columns = [pa.array([k for k, _ in marks.bits] + keys, pa.binary()), pa.array([p for _, p in marks.bits] + [None] * len(keys), pa.int64()), *[pa.array(m, pa.int64()) for m in masks]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([None] * n + digests, pa.binary()), pa.array([None] * n + places, pa.int64())], ["key", "piece", *_MASKS, "digest", "pos"])


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(key, piece, m0 to m3): bits of the windows of each block that also start elsewhere. texts: key, id, text; copies
    share a key."""
    occurring = texts.select("key", "text").mapInArrow(anchors_of, "h bigint, key binary, pos bigint")
    place = F.xxhash64("key", "pos")
    # homes are written, and rows dealt out anew before copies go, so that Spark can split a frequent anchor's places in the join
    homes = stored(occurring.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first"), "homes")
    shared = stored(occurring.join(homes, "h").select("h", "key", "pos", (place == F.col("first")).alias("is_home")).repartition("key", "pos").distinct(), "anchors")
    at_home = shared.where("is_home").select("h", F.col("key").alias("home_key"), F.col("pos").alias("home_pos"))
    met = shared.where("not is_home").select("h", "key", "pos").join(at_home, "h")
    block = lambda pos: F.floor(F.col(pos) / PIECE)
    pairs = stored(met.groupBy("key", block("pos").alias("piece"), "home_key", block("home_pos").alias("home_piece")).agg(F.collect_list(F.struct("pos", "home_pos")).alias("met")), "pairs")

    wanted = pairs.select("key", "piece").union(pairs.select("home_key", "home_piece")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("piece")).alias("wanted"))
    heads = texts.groupBy("key").agg(F.min("id").alias("head"))
    readers = wanted.join(heads, "key")
    holders = texts.join(readers.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("head"))).select("key", "text", "wanted")
    pieces = stored(holders.mapInArrow(pieces_of, "key binary, piece bigint, begin bigint, words binary").dropDuplicates(["key", "piece"]), "pieces")

    there = pieces.select(F.col("key").alias("home_key"), F.col("piece").alias("home_piece"), F.col("begin").alias("home_begin"), F.col("words").alias("home_words"))
    home = F.struct(F.col("home_key").alias("key"), F.col("home_begin").alias("begin"), F.col("home_words").alias("words"), "met")
    grouped = pairs.join(there, ["home_key", "home_piece"]).groupBy("key", "piece").agg(F.collect_list(home).alias("homes"))
    made = stored(pieces.join(grouped, ["key", "piece"]).select("key", "begin", "words", "homes").mapInArrow(factored, _FACTORED), "factors")

    edges = made.where("digest is not null").select("digest", "key", "pos")
    again = edges.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest")
    bit = F.pmod("pos", F.lit(PIECE))
    at_edges = edges.join(again, "digest", "left_semi").select("key", block("pos").alias("piece"), *[F.when(F.floor(bit / 64) == k, F.expr(f"shiftleft(1L, cast(pos % 64 as int))")).otherwise(F.lit(0).cast("bigint")).alias(m) for k, m in enumerate(_MASKS)])
    return made.where("digest is null").select("key", "piece", *_MASKS).union(at_edges).groupBy("key", "piece").agg(*[F.bit_or(m).alias(m) for m in _MASKS])


def spans_of(marked: list[dict] | None, n_words: int) -> list[tuple[int, int]]:
    """Merged [first, end) ranges of words under marked windows."""
    starts: list[np.ndarray] = []
    for block in sorted(marked or [], key=lambda b: b["piece"]):
        raw = b"".join((block[m] & (1 << 64) - 1).to_bytes(8, "little") for m in _MASKS)
        starts.append(np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")) + block["piece"] * PIECE)
    if not starts:
        return []
    at = np.concatenate(starts)
    cut = np.flatnonzero(np.diff(at) > WINDOW)
    firsts, lasts = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [(int(a), min(int(b) + WINDOW, n_words)) for a, b in zip(firsts, lasts, strict=True)]


def kept_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, copied, marked) to (id, n_words, n_removed, spans, kept)."""
    kinds = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for begin, end in by_chars(batch, 1, AT_ONCE):
            part = batch.slice(begin, end - begin)
            counts, removed, spans, kept = [], [], [], []
            for text, copied, marked in zip(part.column(1).cast(pa.binary()), part.column(2).to_pylist(), part.column(3), strict=True):
                words = text.as_py().split()
                found = [(0, len(words))] if copied and len(words) >= WINDOW else spans_of(marked.as_py(), len(words))
                counts.append(len(words))
                removed.append(sum(b - a for a, b in found))
                spans.append([{"first": a, "end": b} for a, b in found])
                left, at = [], 0
                for a, b in found:
                    left += words[at:a]
                    at = b
                kept.append(b" ".join(left + words[at:]))
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "spans", "kept"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges that go), kept (the other words, joined by one space). A row for
    each of docs."""
    texts = docs.select(F.col(doc_id).alias("id"), whole(text).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    marked = repeated_windows(texts).groupBy("key").agg(F.collect_list(F.struct("piece", *_MASKS)).alias("marked"))
    copied = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
    known = marked.join(copied, "key", "full_outer")
    made = texts.join(known, "key", "left").select("id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "marked")
    kind = docs.select(F.col(doc_id).alias("id")).schema["id"].dataType.simpleString()
    return made.mapInArrow(kept_of, f"id {kind}, n_words bigint, n_removed bigint, spans array<struct<first:bigint,end:bigint>>, kept string").withColumnRenamed("id", "doc_id")


def op13_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
