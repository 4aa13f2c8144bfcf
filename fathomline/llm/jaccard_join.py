"""Similarity join on word shingle sets, with a count-vector R-tree.

A document's set is its distinct five-word shingles (A-Z in lower case; a shorter sequence, but not none, is its one
shingle). Two documents link when their sets' Jaccard similarity is at least 0.8, that is 9 * common >= 4 * (a + b).

1. Documents of equal sets form a class, which takes part once. A set's shingles are hashed into GROUPS groups; the
   group counts are its point. The sum of two points' coordinate minima bounds what the sets have in common.
2. Sets that link share one of the first n - ceil(0.8 n) + 1 shingles of each in any common order (here: frequent
   shingles last, else by hash), so pairs are sought among sets that share such a key. Unshared keys are dropped.
3. Keys with the same hub (the set whose keys are shared most) form a block of sets. Each set is verified against the
   hub that it shares most keys with, then against its other hubs where that joins components of the links so far.
4. Blocks whose sets are still in several components get an R-tree over their points: nodes whose corner bounds the
   overlap below what a link needs are skipped, surviving pairs of different components are verified on the sets.
   Large blocks are cut into cells of bounded size, each pair of cells a task of its own. No link between components
   is lost, and links inside a component change nothing.
5. The steps so far find components. jaccard_links() and joined() go on to every link: all links of a set lie in its
   component, so the texts of each component meet (in cells, if it is large), and each pair that an R-tree over their
   points lets through is verified on the sets, however the component was tied.

Pairs are verified where the text of one side, sent once for CELL pairs, meets those of the other, row by row, so that
a task holds two sets. Sets have 64-bit numbers in the joins; classes are told apart by 128-bit digests, and digests
that share a number get others (Ids).

The order of step 2 is a matter of speed only; frequent shingles are counted over all documents (those that repeat
within a batch, at most FREQUENT of them kept). Null, empty and wordless texts have empty sets, link with nothing, and
are their own components. Very long texts are one row like others: a set takes 8 bytes a distinct shingle. Rows of one
id are documents of their own that share the id; rows without an id take part, stand last in their component, and have
no component_id where no linked document has an id. Empty tables give empty results. Other columns aren't read, so
their names may be any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_chars, discard, documents, small_batches, stored, whole
from .components import components

WORDS = 5
GROUPS = 64
FREQUENT = 65_536
#: A shingle is frequent from so many documents on.
OFTEN = 40
CHUNK = 4_000_000
#: Sets of one key that a task compares at once.
CELL = 2000
#: Shingles of a cell of a component.
CELL_SHINGLES = 2_000_000
FANOUT = 32
#: Cells of so many members are compared without a tree.
LEAF = 48
#: Ids that may be broadcast to fetch texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """Random words for (position in a word modulo 64, byte)."""
    return np.random.default_rng(20240607).integers(0, 2**64, (64, 256), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Tabulation hashes of words, summed over their bytes."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    cells = byte_table().ravel()[(place & 63) * 256 + raw]
    if len(raw) and int(lengths.max()) > 64:
        cells = cells * ((place >> 6) * 2 + 1).astype(np.uint64)
    return mixed(np.add.reduceat(cells, starts) + lengths.astype(np.uint64)) if len(words) else np.zeros(0, np.uint64)


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    hashes = word_hashes(raw.lower().split())
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for at in range(width):
        total = mixed(total + hashes[at : at + len(total)] * np.uint64(2 * at + 3))
    return np.unique(total)


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts by group."""
    return np.bincount((hashes % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype("<i4")


def fine_point(hashes: np.ndarray) -> bytes:
    """Counts by groups of two to four shingles (their number is a power of two): for sets that share no passage the
    minima then sum up to 0.72 of the shingles at most, while a link needs 0.89. Empty where a count needs more than a
    byte."""
    bits = min(20, max(7, int(len(hashes)).bit_length() - 2))
    counts = np.bincount((hashes & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def fine_bound(a: bytes, b: bytes) -> float:
    """What two sets have in common at most; the finer point is folded to the other's groups."""
    if not a or not b:
        return float("inf")
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x = x.reshape(-1, len(y)).sum(0)
    elif len(y) > len(x):
        y = y.reshape(-1, len(x)).sum(0)
    return float(np.minimum(x, y).sum())


def digest(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


class Ids:
    """64-bit numbers of sets by their digests. moved: the numbers of digests whose own number another set has."""

    def __init__(self, bits: int = 64, moved: dict[bytes, int] | None = None):
        self.bits, self.moved = bits, moved or {}

    def own(self, digested: bytes) -> int:
        return int.from_bytes((int.from_bytes(digested[:8], "little") % (1 << self.bits)).to_bytes(8, "little"), "little", signed=True)

    def of(self, digested: bytes) -> int:
        found = self.moved.get(digested)
        return self.own(digested) if found is None else found


def told_apart(sets: DataFrame, bits: int) -> Ids:
    """Numbers that differ for all digests of sets (digest, sid). Of n sets, about n * n / 2^65 share theirs: these
    few go through the driver and draw again until no set has their number."""
    shared = sets.groupBy("sid").agg(F.count("*").alias("n"), F.min("digest").alias("first")).where("n > 1").select("sid", "first")
    clashing = sorted(bytes(r["digest"]) for r in sets.join(shared, "sid").where("digest <> first").select("digest").collect())
    moved: dict[bytes, int] = {}
    nth, left = 0, clashing
    while left:
        nth += 1
        drawn = {d: int.from_bytes(blake2b(d, digest_size=8, salt=nth.to_bytes(8, "little")).digest(), "little", signed=True) for d in left}
        known = sets.sparkSession.createDataFrame([(n,) for n in set(drawn.values())], "sid bigint")
        taken = {r["sid"] for r in sets.join(F.broadcast(known), "sid", "left_semi").select("sid").collect()} | set(moved.values())
        for d in left:
            if drawn[d] not in taken:
                moved[d] = drawn[d]
                taken.add(drawn[d])
        left = [d for d in left if d not in moved]
    return Ids(bits, moved)


def renumbered(df: DataFrame, ids: Ids) -> DataFrame:
    """df (digest, sid, ...) with the numbers of ids."""
    if not ids.moved:
        return df
    moved = df.sparkSession.createDataFrame([(bytearray(d), n) for d, n in ids.moved.items()], "digest binary, __moved bigint")
    return df.join(F.broadcast(moved), "digest", "left").withColumn("sid", F.coalesce("__moved", "sid")).drop("__moved")


def survey(texts: DataFrame, ids: Ids) -> DataFrame:
    """A row for each document (doc_id, mark, n, digest, sid, point), and rows of shingles that repeat within a batch
    (key, n)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in by_chars(batch, 1, CHUNK):
                part = batch.slice(first, end - first)
                sets = [shingle_set(x.as_py()) for x in part.column(1).cast(pa.binary())]
                digests = list(map(digest, sets))
                distinct = dict(zip(digests, sets, strict=True))
                keys, counts = np.unique(np.concatenate([*distinct.values(), np.zeros(0, np.uint64)]), return_counts=True)
                keys, counts = keys[counts > 1].view(np.int64), counts[counts > 1]
                own, rest = len(sets), len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([part.column(0), pa.nulls(rest, part.column(0).type)]),
                        pa.concat_arrays([part.column(2), pa.nulls(rest, pa.int64())]),
                        pa.array([*map(len, sets), *counts.tolist()], pa.int64()),
                        pa.array([*digests, *[None] * rest], pa.binary()),
                        pa.array([*map(ids.of, digests), *[None] * rest], pa.int64()),
                        pa.array([*(point(s).tobytes() for s in sets), *[None] * rest], pa.binary()),
                        pa.array([*[None] * own, *keys.tolist()], pa.int64()),
                    ],
                    ["doc_id", "mark", "n", "digest", "sid", "point", "key"],
                )

    return stored(texts.mapInArrow(surveyed, f"doc_id {kind}, mark bigint, n bigint, digest binary, sid bigint, point binary, key bigint"), "survey")


def prefix_keys(docs: DataFrame, frequent: np.ndarray, ids: Ids) -> DataFrame:
    """(key, sid): the prefix shingles of each set. frequent: sorted hashes, which come last."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            for first, end in by_chars(batch, 1, CHUNK):
                keys, owners, seen = [], [], set()
                for x in batch.slice(first, end - first).column(1).cast(pa.binary()):
                    hashes = shingle_set(x.as_py())
                    own = ids.of(digest(hashes))
                    if own in seen or not len(hashes):
                        continue
                    seen.add(own)
                    if len(late):
                        at = np.searchsorted(late, hashes)
                        often = late[np.minimum(at, len(late) - 1)] == hashes
                        hashes = np.concatenate([hashes[~often], hashes[often]])
                    keys.append(hashes[: len(hashes) - -(-4 * len(hashes) // 5) + 1])
                    owners.append(np.full(len(keys[-1]), own, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "sid"])

    return docs.select("doc_id", "text").mapInArrow(cut, "key bigint, sid bigint")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, first, sid): the sets of each key but its smallest, with the smallest. One pass over sorted rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            k, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            again = np.zeros(len(k), bool)
            again[1:] = ~new[1:] & (s[1:] == s[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            firsts = s[at]
            if last is not None and k[0] == last[0]:
                begun = at == 0
                firsts = np.where(begun, last[1], firsts)
                new[0] = False
                again[0] = s[0] == last[2]
            keep = ~new & ~again
            last = (k[-1], firsts[-1], s[-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(firsts[keep]), pa.array(s[keep])], ["key", "first", "sid"])

    return keys.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(scan, "key bigint, first bigint, sid bigint")


class RTree:
    """Points packed by size and coordinates; inner nodes keep upper corners and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1 % points.shape[1]], points[:, 0], np.round(np.log(np.maximum(sizes, 1)) * 8)))
        corner, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(corner, low, high)]
        while len(corner) > FANOUT:
            cuts = np.arange(0, len(corner), FANOUT)
            corner, low, high = np.maximum.reduceat(corner, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((corner, low, high))

    def near(self, points: np.ndarray, sizes: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) pairs whose bound reaches what a link needs, in blocks."""
        top = len(self.levels[-1][0])
        step = max(1, most // top)
        for first in range(0, len(points), step):
            ask = np.arange(first, min(first + step, len(points)))
            yield from self.descend(points, sizes, np.repeat(ask, top), np.tile(np.arange(top), len(ask)), len(self.levels) - 1, most)

    def descend(self, points: np.ndarray, sizes: np.ndarray, ask: np.ndarray, node: np.ndarray, level: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        corner, low, high = self.levels[level]
        for first in range(0, len(ask), most // 4):
            a, b = ask[first : first + most // 4], node[first : first + most // 4]
            fits = (5 * sizes[a] >= 4 * low[b]) & (5 * high[b] >= 4 * sizes[a])
            a, b = a[fits], b[fits]
            bound = np.minimum(points[a], corner[b]).sum(1)
            fits = 9 * bound >= 4 * (sizes[a] + low[b])
            a, b = a[fits], b[fits]
            if level == 0:
                if len(a):
                    yield a, self.order[b]
                continue
            below = len(self.levels[level - 1][0])
            children = (b[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            parents = np.repeat(a, FANOUT)
            yield from self.descend(points, sizes, parents[children < below], children[children < below], level - 1, most)


def cell_pairs(sides: np.ndarray, sid: np.ndarray, comp: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one cell, of different components, that the bound lets through. sides: 2 for members of a cell that
    is compared with itself, else 0 and 1 for the two cells."""
    left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    if len(np.unique(comp)) < 2 or not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree = RTree(points[left], sizes[left])
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, m in tree.near(points[right], sizes[right]):
        a, b = right[q], left[m]
        apart = comp[a] != comp[b]
        us.append(np.minimum(sid[a], sid[b])[apart])
        vs.append(np.maximum(sid[a], sid[b])[apart])
    pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def leaf_pairs(cell: np.ndarray, sid: np.ndarray, comp: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cell_pairs() of many cells of at most LEAF members, each a tree of one leaf. cell: numbers in order, -1 for
    rows that take no part."""
    found = [np.zeros((0, 2), np.int64)]
    for step in range(1, LEAF):
        a = np.flatnonzero((cell[:-step] == cell[step:]) & (cell[step:] >= 0)) if len(cell) > step else np.zeros(0, np.int64)
        if not len(a):
            break
        b = a + step
        fits = (comp[a] != comp[b]) & (5 * sizes[a] >= 4 * sizes[b]) & (5 * sizes[b] >= 4 * sizes[a])
        a, b = a[fits], b[fits]
        if len(a):
            found.append(_reaching(a, b, sid, points, sizes))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def _reaching(a: np.ndarray, b: np.ndarray, sid: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    pairs = np.stack([np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])], 1)
    _, once = np.unique(pairs, axis=0, return_index=True)
    a, b = a[once], b[once]
    return pairs[once][9 * np.minimum(points[a], points[b]).sum(1) >= 4 * (sizes[a] + sizes[b])]


def probe(members: DataFrame) -> DataFrame:
    """(u, v) of members (cell, side, sid, comp, n, point), by one R-tree a cell. Cells are of bounded size."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not len(table):
                return
            cell, side, sid, comp, n = (table.column(i).to_numpy() for i in range(5))
            points = np.frombuffer(b"".join(table.column(5).to_pylist()), "<i4").reshape(-1, GROUPS)
            cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            ends = np.append(cuts[1:], len(cell))
            u, v = leaf_pairs(np.repeat(np.where(ends - cuts <= LEAF, np.arange(len(cuts)), -1), ends - cuts), sid, comp, points, n)
            us, vs = [u], [v]
            for first, end in zip(cuts[ends - cuts > LEAF], ends[ends - cuts > LEAF], strict=True):
                at = slice(first, end)
                u, v = cell_pairs(side[at], sid[at], comp[at], points[at], n[at])
                us.append(u)
                vs.append(v)
            found = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(cell):
                continue
            tail = int(np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))[-1])
            if tail == 0:
                if held and held[-1].column(0)[-1].as_py() != cell[0]:
                    yield from flush(pa.Table.from_batches(held))
                    held = []
                held.append(batch)
                continue
            yield from flush(pa.Table.from_batches([*held, batch.slice(0, tail)]))
            held = [batch.slice(tail)]
        if held:
            yield from flush(pa.Table.from_batches(held))

    return members.repartition("cell").sortWithinPartitions("cell").select("cell", "side", "sid", "comp", "n", "point").mapInArrow(pairs, "u bigint, v bigint")


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose points' bound reaches what a link needs."""
    sized = sets.select("sid", "n", "point")
    met = pairs.join(sized.withColumnsRenamed({"sid": "u", "n": "nu", "point": "pu"}), "u").join(sized.withColumnsRenamed({"sid": "v", "n": "nv", "point": "pv"}), "v")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<i4").reshape(-1, GROUPS) for i in (2, 4))
            sizes = batch.column(3).to_numpy(zero_copy_only=False) + batch.column(5).to_numpy(zero_copy_only=False)
            yield batch.select([0, 1]).filter(pa.array(9 * np.minimum(a, b).sum(1) >= 4 * sizes))

    return met.select("u", "v", "pu", "nu", "pv", "nv").mapInArrow(reach, "u bigint, v bigint")


def texts_of(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of asked (rep, mark, ...) with the text of that id and mark. Of one id and mark there can be several
    texts, and each several times."""
    few = asked.count() <= BROADCAST_IDS
    wanted = asked.withColumnRenamed("mark", "__mark")
    return texts.join(F.broadcast(wanted) if few else wanted, texts["doc_id"].eqNullSafe(wanted["rep"]) & (texts["mark"] == wanted["__mark"])).select(*[c for c in asked.columns if c not in ("rep", "mark")], "text")


def fine_points(asked: DataFrame, texts: DataFrame, ids: Ids) -> DataFrame:
    """(sid, n, made): the fine points of the sets asked for (sid, rep, mark), made from their texts."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in by_chars(batch, 1, CHUNK):
                part = batch.slice(first, end - first)
                sets = [shingle_set(x.as_py()) for x in part.column(1).cast(pa.binary())]
                right = [ids.of(digest(s)) == sid for s, sid in zip(sets, part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([*map(len, sets)], pa.int64()), pa.array(list(map(fine_point, sets)), pa.binary())], ["sid", "n", "made"]).filter(pa.array(right, pa.bool_()))

    return texts_of(asked, texts).select("sid", "text").mapInArrow(again, "sid bigint, n bigint, made binary").dropDuplicates(["sid"])


def finely_bounded(pairs: DataFrame, sets: DataFrame, texts: DataFrame, ids: Ids) -> DataFrame:
    """Pairs (u, v) that their fine points don't rule out."""
    both = pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct()
    asked = stored(both.join(sets.select("sid", "rep", "mark"), "sid"), "asked")
    made = fine_points(asked, texts, ids)
    met = pairs.join(made.withColumnsRenamed({"sid": "u", "n": "nu", "made": "mu"}), "u").join(made.withColumnsRenamed({"sid": "v", "n": "nv", "made": "mv"}), "v")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, nu, nv, mu, mv = batch.columns
            keep = [9 * fine_bound(a.as_py(), b.as_py()) >= 4 * (x.as_py() + y.as_py()) for x, y, a, b in zip(nu, nv, mu, mv, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    near = stored(met.select("u", "v", "nu", "nv", "mu", "mv").mapInArrow(kept, "u bigint, v bigint"), "near")
    discard(asked)
    return near


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, ids: Ids) -> DataFrame:
    """Pairs (u, v) that link by their whole sets. The text of u is sent once for CELL of its pairs, and meets the
    texts of their v there."""
    cells = pairs.groupBy("u").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    of_v = pairs.join(cells, "u").select("u", F.pmod(F.xxhash64("v"), F.col("cells")).cast("int").alias("cell"), F.lit(1).alias("side"), F.col("v").alias("sid"))
    of_u = cells.select("u", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("side"), F.col("u").alias("sid"))
    asked = stored(of_u.unionByName(of_v).join(sets.select("sid", "rep", "mark"), "sid"), "asked")

    def linked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for u, cell, side, sid, x in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).cast(pa.binary()), strict=True):
                made = shingle_set(x.as_py())
                if ids.of(digest(made)) != sid:
                    continue
                if side == 0:
                    at, own = (u, cell), made
                elif at == (u, cell):
                    both = np.concatenate([own, made])
                    both.sort(kind="stable")
                    if 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both):
                        us.append(u)
                        vs.append(sid)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    dealt = texts_of(asked, texts).repartition("u", "cell").sortWithinPartitions("u", "cell", "side")
    links = stored(dealt.select("u", "cell", "side", "sid", "text").mapInArrow(linked_rows, "u bigint, v bigint").distinct(), "links")
    discard(asked)
    return links


def hub_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, sid, shared): the sets of all keys that have the same hub, with the number of these keys.

    The hub of a key is the set of the key with the largest share of its own keys shared: among near copies, the one
    that the others were made from. Sets that share a key stand in one block, and a pair of sets meets in a block
    or two instead of once a key.
    """
    rows = members.select("key", "sid").unionByName(members.groupBy("key").agg(F.min("first").alias("sid")))
    prefix = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1
    known = rows.groupBy("sid").agg(F.count("*").alias("c")).join(sets.select("sid", "n"), "sid").select("sid", F.round(F.col("c") / prefix, 4).alias("part"))
    rated = rows.join(known, "sid")
    hubs = rated.groupBy("key").agg(F.max_by("sid", F.struct("part", "sid")).alias("hub"))
    return rows.join(hubs, "key").where("sid <> hub").groupBy("hub", "sid").agg(F.count("*").alias("shared"))


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def placed(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(sid, comp)"""
    return stored(sets.select("sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("comp")), "comps")


def with_comps(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    return blocks.join(comps, "sid").join(comps.select(F.col("sid").alias("hub"), F.col("comp").alias("hub_comp")), "hub")


def bounded_rows(cell: np.ndarray, side: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell (and of both its sides) whose bound reaches what a link needs, in blocks. cell: in order."""
    cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    ends = np.append(cuts[1:], len(cell))
    small = np.repeat(np.where(ends - cuts <= LEAF, np.arange(len(cuts)), -1), ends - cuts)
    for step in range(1, LEAF):
        a = np.flatnonzero((small[:-step] == small[step:]) & (small[step:] >= 0)) if len(small) > step else np.zeros(0, np.int64)
        if not len(a):
            break
        b = a + step
        fits = ((side[a] == 2) | (side[a] != side[b])) & (5 * sizes[a] >= 4 * sizes[b]) & (5 * sizes[b] >= 4 * sizes[a])
        a, b = a[fits], b[fits]
        fits = 9 * np.minimum(points[a], points[b]).sum(1) >= 4 * (sizes[a] + sizes[b])
        yield a[fits], b[fits]
    for first, end in zip(cuts[ends - cuts > LEAF], ends[ends - cuts > LEAF], strict=True):
        left, right = (first + np.flatnonzero(side[first:end] != other) for other in (1, 0))
        if not len(left) or not len(right):
            continue
        for q, m in RTree(points[left], sizes[left]).near(points[right], sizes[right]):
            a, b = left[m], right[q]
            once = (side[a] != 2) | (a < b)
            yield a[once], b[once]


def linking(a: np.ndarray, b: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which pairs of rows link by their whole sets. ids: numbers of the rows' shingles; seen: false for each number."""
    order = np.argsort(a, kind="stable")
    keep = np.zeros(len(a), bool)
    for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else []:
        row, others = a[part[0]], b[part]
        own = ids[starts[row] : starts[row] + sizes[row]]
        held = np.concatenate([ids[starts[o] : starts[o] + sizes[o]] for o in others])
        seen[own] = True
        common = np.add.reduceat(seen[held], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        seen[own] = False
        keep[part] = 9 * common >= 4 * (sizes[row] + sizes[others])
    return keep


def compare_cells(members: DataFrame, each: bool, ids: Ids) -> DataFrame:
    """All links of members (cell, side, sid, text): as rows (u, v) where each is set, else as rows (sid, n) of a
    set's n links in a cell."""
    names = ["u", "v"] if each else ["sid", "n"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cell, side, sid = (table.column(i).to_numpy() for i in range(3))
            sets = [shingle_set(x.as_py()) for x in table.column(3).cast(pa.binary())]
            # another row of the representative's id can have another text, or the same once more
            known, right = set(), np.zeros(len(sid), bool)
            for i, key in enumerate(zip(cell.tolist(), sid.tolist(), strict=True)):
                if key not in known and ids.of(digest(sets[i])) == key[1]:
                    known.add(key)
                    right[i] = True
            cell, side, sid, sets = cell[right], side[right], sid[right], [sets[i] for i in np.flatnonzero(right)]
            if not len(sets):
                return
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            words, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            seen, count = np.zeros(len(words), bool), np.zeros(len(sid), np.int64)
            for a, b in bounded_rows(cell, side, np.stack(list(map(point, sets))), sizes):
                keep = linking(a, b, numbers, np.cumsum(sizes) - sizes, sizes, seen)
                a, b = a[keep], b[keep]
                if each and len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[a], sid[b])), pa.array(np.maximum(sid[a], sid[b]))], names)
                elif len(a):
                    count += np.bincount(np.concatenate([a, b]), minlength=len(sid))
            if (at := np.flatnonzero(count)).size:
                yield pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.array(count[at])], names)

        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(cell):
                continue
            cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])).tolist()
            if held and held[-1].column(0)[-1].as_py() != cell[0]:
                yield from flush(pa.Table.from_batches(held))
                held = []
            # whole cells of about CHUNK bytes of text at once
            begun, sizes = 0, np.cumsum(pa.compute.binary_length(batch.column(3)).to_numpy(zero_copy_only=False))
            for at in cuts[1:]:
                if at == cuts[-1] or sizes[at - 1] - (sizes[begun - 1] if begun else 0) > CHUNK:
                    yield from flush(pa.Table.from_batches([*held, batch.slice(begun, at - begun)]))
                    begun, held = at, []
            held.append(batch.slice(begun))
        if held:
            yield from flush(pa.Table.from_batches(held))

    return members.repartition("cell").sortWithinPartitions("cell").select("cell", "side", "sid", "text").mapInArrow(found, ", ".join(f"{n} bigint" for n in names))


def all_links(roots: DataFrame, sets: DataFrame, texts: DataFrame, each: bool, ids: Ids) -> DataFrame:
    """compare_cells() of all components of several classes, each cut into cells."""
    tied = roots.select(F.col("node").alias("sid"), "root").unionByName(roots.select(F.col("root").alias("sid"), "root").distinct())
    tied = stored(tied.join(sets.select("sid", "rep", "mark", "n"), "sid"), "tied")
    cells = tied.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum("n") / CELL_SHINGLES)).cast("int").alias("cells"))
    asked = stored(tied.join(cells, "root").select("sid", "rep", "mark", "root", "cells"), "asked")
    met = texts_of(asked, texts)
    dealt = met.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cell = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    links = stored(compare_cells(dealt.select(cell.alias("cell"), side.alias("side"), "sid", "text"), each, ids), "links")
    discard(tied, asked)
    return links


def linked(docs: DataFrame, doc_id: str, text: str, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, Ids]:
    """Steps 1 to 4: the texts, a row of each document, the classes, the roots of their components, and the numbers.

    mark: a hash of the text, which with the id finds a class's text again.
    """
    texts = docs.select(F.col(doc_id) if doc_id == "doc_id" else F.col(doc_id).alias("doc_id"), whole(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    surveyed = survey(texts, Ids(bits))
    own = surveyed.where(F.col("digest").isNotNull()).select("doc_id", "mark", "n", "digest", "sid", "point")
    counted = surveyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    frequent = np.sort(np.array([r["key"] for r in counted.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()], np.int64).view(np.uint64))

    classes = own.where("n > 0").groupBy("digest").agg(F.min(row_order()).alias("first"), F.count("*").alias("n_copies"), F.first("sid").alias("sid"), F.first("n").alias("n"), F.first("point").alias("point"))
    sets = stored(classes.select("digest", "sid", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "n_copies", "n", "point"), "classes")
    ids = told_apart(sets, bits)
    own, sets = renumbered(own, ids), renumbered(sets, ids)
    members = stored(shared_keys(prefix_keys(texts, frequent, ids)), "keys")
    blocks = stored(hub_blocks(members, sets), "blocks")
    discard(members)

    # each set with the hub that it shares most keys with
    closest = blocks.groupBy("sid").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    tried = stored(bounded(closest.select(F.col("hub").alias("u"), F.col("sid").alias("v")), sets), "tried")
    links = verified(tried, sets, texts, ids)
    discard(tried)
    roots = components(links)
    comps = placed(sets, roots)

    # each set with its other hubs, where that joins components
    met = with_comps(blocks, comps).where("comp <> hub_comp")
    tried = stored(bounded(ordered(met, "sid", "hub"), sets), "tried")
    if not tried.isEmpty():
        links, roots = tied(links, tried, sets, texts, ids)
        discard(comps)
        comps = placed(sets, roots)
    discard(tried)

    # all sets of the blocks that still hold several components
    met = with_comps(blocks, comps)
    open_blocks = met.groupBy("hub").agg(F.min(F.least("comp", "hub_comp")).alias("low"), F.max(F.greatest("comp", "hub_comp")).alias("high"), F.count("*").alias("n")).where("low < high")
    open_blocks = stored(open_blocks.select("hub", F.ceil((F.col("n") + 1) / CELL).cast("int").alias("cells")), "open")
    if not open_blocks.isEmpty():
        asked = blocks.join(open_blocks, "hub").select("hub", "cells", "sid").unionByName(open_blocks.select("hub", "cells", F.col("hub").alias("sid")))
        dealt = asked.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        cell = F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select(cell.alias("cell"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "sid")
        pairs = stored(probe(dealt.join(comps, "sid").join(sets.select("sid", "n", "point"), "sid")).distinct(), "pairs")
        links, roots = tied(links, pairs, sets, texts, ids)
        discard(pairs)
    discard(blocks, open_blocks, links, comps)
    return texts, own, sets, roots, ids


def row_order(doc_id: str = "doc_id", mark: str = "mark") -> Column:
    """By id, rows without one last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(mark).alias("mark"))


def tied(links: DataFrame, pairs: DataFrame, sets: DataFrame, texts: DataFrame, ids: Ids) -> tuple[DataFrame, DataFrame]:
    """links with those of pairs, and the roots of all; fine points rule out most of the other pairs, the whole
    sets decide."""
    near = finely_bounded(pairs, sets, texts, ids)
    more = verified(near, sets, texts, ids)
    both = stored(links.unionByName(more), "links")
    discard(near, more, links)
    return both, components(both)


def with_components(own: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles and the columns of jaccard_components(), with sid, and first (the row of the component
    that comes first)."""
    rooted = sets.select("sid", "rep", "mark", "n_copies").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = rooted.groupBy("root").agg(F.min(row_order("rep")).alias("first"))
    known = rooted.join(least, "root").select("sid", "n_copies", "first")
    met = own.join(known, "sid", "left")
    return met.select("sid", "doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("n_copies")).otherwise(1).alias("n_copies"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "first")


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(u, v): every link between classes, by their smallest ids."""
    texts, _, sets, roots, ids = linked(docs, doc_id, text, bits)
    links = all_links(roots, sets, texts, True, ids)
    named = lambda c: sets.select(F.col("sid").alias(c), F.col("rep").alias(f"rep_{c}"))
    return links.join(named("u"), "u").join(named("v"), "v").select(F.least("rep_u", "rep_v").alias("u"), F.greatest("rep_u", "rep_v").alias("v"))


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """jaccard_components() with n_links: the other classes that the document's class links to."""
    texts, own, sets, roots, ids = linked(docs, doc_id, text, bits)
    counted = all_links(roots, sets, texts, False, ids).groupBy("sid").agg(F.sum("n").alias("n_links"))
    made = with_components(own, sets, roots).join(counted, "sid", "left")
    return made.select("doc_id", "n_shingles", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, n_copies (documents of the same set), component_id (smallest id reachable by links)."""
    _, own, sets, roots, _ = linked(docs, doc_id, text, bits)
    return with_components(own, sets, roots).select("doc_id", "n_shingles", "n_copies", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs, all columns as they are, of the first row of each component: the one of the smallest id, rows
    without an id last. Rows are told by id and text; repeated ones of a kept id and text stay once."""
    _, own, sets, roots, _ = linked(docs, doc_id, text)
    grouped = stored(with_components(own, sets, roots).select("doc_id", "mark", "n_shingles", "first"), "groups")
    gone = grouped.where((F.col("n_shingles") > 0) & (row_order() != F.col("first"))).select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, docs[doc_id].eqNullSafe(gone["__gone"]) & (F.xxhash64(whole(text)) == gone["__mark"]), "left_anti")
    repeated = not grouped.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    return kept.dropDuplicates([doc_id, text]) if repeated else kept


def op10_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return joined(documents(spark, sf_dir))
