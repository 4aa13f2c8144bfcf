"""Phrases of two and three words, by counts kept as streams in prefix and in suffix order.

Texts are lowered (A-Z), split into pieces and words; the last words of a piece stand with gaps behind them, so that
sums over runs of one stream of three-word counts give the counts of two words as well. Each task sums its own counts
before they are shuffled, as blobs of a sorted word list and numbers, by a hash of the first two words; single words
go the same way by themselves. A word or pair that is frequent is so split over buckets or summed first. What occurs
under least times goes right after the sum: a phrase can't be more frequent than its parts.

The counts left are sorted twice over ranges: in prefix order the parts before a cut stand above a phrase, in suffix
order (words from last to first) those behind it. One walk along each order carries the counts of the last single word
and pair seen, from one range into the next by a row for each range. The two orders are merged by phrase. No count is
looked up in a table.

Null texts are empty and have no words; a null group is OTHER. Counts of repeated rows and copies add up. Very long
texts are read whole. Empty tables give no rows; only the text and group are read, so other columns may have any names.
Phrases with equal scores and counts stand in the byte order of their text. Products are decimals of 38 digits: exact
up to counts of 10^15.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_batches, stored, whole
from .substring_dedup import Codes, mixed

LEAST, TOP, OTHER = 10, 2000, "und"
#: Bytes of text for each bucket of counts.
BUCKET_BYTES = 12_000_000
#: Words that a task gathers before it sums their counts.
GATHERED = 1_500_000
#: Counts in a range of the sorted streams.
RANGE_ROWS = 1_000_000
_ENDS, _GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_FOLD = bytes(0x0A if b in _ENDS else 0x20 if b in _GAPS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Ids(dict):
    """Numbers of words in order of appearance; 0 ends a piece, 1 is nothing."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def summed(triples: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of (n, 3) numbers, sorted, with the sums of their counts."""
    if not len(triples):
        return triples, counts
    if int(triples.max()) < 1 << 21:
        keys = triples[:, 0] << np.int64(42) | triples[:, 1] << np.int64(21) | triples[:, 2]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    else:
        order = np.lexsort(triples.T[::-1])
        rows = triples[order]
        begins = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return triples[order[begins]], np.add.reduceat(counts[order], begins)


def packed(words: list[bytes], triples: np.ndarray, counts: np.ndarray) -> bytes:
    """A blob of counts whose words are numbered from 1 on in words."""
    head = b"\n".join(words)
    steps = np.diff(triples[:, 0], prepend=0)
    body = b"".join(x.astype("<u4").tobytes() for x in (steps, triples[:, 1], triples[:, 2])) + counts.astype("<u8").tobytes()
    return len(head).to_bytes(4, "little") + len(counts).to_bytes(4, "little") + len(body).to_bytes(8, "little") + head + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    heads, n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little"), int.from_bytes(blob[8:16], "little")
    body = pa.decompress(blob[16 + heads :], decompressed_size=size, codec="zstd", asbytes=True)
    steps, second, third = (np.frombuffer(body, "<u4", n, 4 * n * k).astype(np.int64) for k in range(3))
    return blob[16 : 16 + heads].split(b"\n"), np.column_stack([np.cumsum(steps), second, third]), np.frombuffer(body, "<u8", n, 12 * n).astype(np.int64)


class Gathered:
    """Words of one group of texts, and their counts by bucket."""

    def __init__(self, buckets: int, codes: Codes):
        self.buckets, self.codes = buckets, codes
        self.clear()

    def clear(self) -> None:
        self.ids, self.parts, self.n = Ids(), [], 0

    def add(self, text: bytes) -> None:
        words = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        seen = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        self.parts += [seen[seen != 1], np.zeros(1, np.int64)]
        self.n += len(words)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob); buckets of single words are numbered below 0."""
        line = np.concatenate([*self.parts, np.zeros(2, np.int64)])
        names = list(self.ids)
        order = sorted(range(2, len(names)), key=names.__getitem__)
        rank = np.zeros(len(names), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        line = rank[line]
        codes = np.array([0] + [self.codes[names[i]] for i in order], np.uint64)
        first = np.flatnonzero(line[:-2])
        one, two, three = line[first], line[first + 1], line[first + 2]
        n = np.bincount(one, minlength=len(order) + 1)
        alone = np.flatnonzero(n)
        single = np.column_stack([alone, np.zeros((len(alone), 2), np.int64)])
        pairs = two > 0
        triples = np.column_stack([one[pairs], two[pairs], np.where(two > 0, three, 0)[pairs]])
        triples, counts = summed(triples, np.ones(len(triples), np.int64))
        for sign, rows, sums, at in ((-1, single, n[alone], mixed(codes[alone])), (1, triples, counts, mixed(codes[triples[:, 0]] * np.uint64(3) + mixed(codes[triples[:, 1]])))):
            bucket = (at % np.uint64(self.buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            for part in np.split(by, cuts) if len(by) else []:
                used, inverse = np.unique(rows[part], return_inverse=True)
                own = inverse.reshape(-1, 3) + (0 if used[0] == 0 else 1)
                yield (int(bucket[part[0]]) if sign > 0 else -1 - int(bucket[part[0]])), packed([names[order[i - 1]] for i in used if i], own, sums[part])
        self.clear()


def count_blobs(buckets: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = Codes(), {}

        def flushed(group: str) -> pa.RecordBatch:
            found = list(held[group].blobs())
            return pa.RecordBatch.from_arrays([pa.array([group] * len(found), pa.string()), pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["grp", "bucket", "blob"])

        for batch in batches:
            for group, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                held.setdefault(group, Gathered(buckets, codes)).add(text.as_py())
                if sum(x.n for x in held.values()) >= GATHERED:
                    yield flushed(max(held, key=lambda g: held[g].n))
        for group in held:
            if held[group].n:
                yield flushed(group)

    return made


def merge_blobs(least: int):
    def merged(table: pa.Table) -> pa.Table:
        group, single = table.column("grp")[0].as_py(), table.column("bucket")[0].as_py() < 0
        ids, rows, sums = Ids(), [], []
        for blob in table.column("blob"):
            words, triples, counts = unpacked(blob.as_py())
            number = np.fromiter((0, *map(ids.__getitem__, words)), np.int64, len(words) + 1)
            rows.append(number[triples])
            sums.append(counts)
            if len(rows) > 64:  # keeps what is held near the distinct rows
                rows, sums = map(list, zip(summed(np.concatenate(rows), np.concatenate(sums)), strict=True))
        triples, counts = summed(np.concatenate(rows), np.concatenate(sums))
        out: list[tuple] = []
        names = list(ids)
        word = lambda i: names[i].decode() if i else None
        if single:
            out.append((None, None, None, int(counts.sum())))
        else:
            begins = np.flatnonzero(np.concatenate([[True], (triples[1:, :2] != triples[:-1, :2]).any(axis=1)]))
            pairs = np.add.reduceat(counts, begins)
            out += [(word(a), word(b), None, int(n)) for (a, b, _), n in zip(triples[begins[pairs >= least]].tolist(), pairs[pairs >= least], strict=True)]
        often = counts >= least if single else (counts >= least) & (triples[:, 2] > 0)
        out += [(word(a), word(b), word(c), int(n)) for (a, b, c), n in zip(triples[often].tolist(), counts[often], strict=True)]
        columns = [pa.array([r[k] for r in out], pa.string()) for k in range(3)]
        return pa.Table.from_arrays([pa.array([group] * len(out), pa.string()), *columns, pa.array([r[3] for r in out], pa.int64())], ["grp", "w1", "w2", "w3", "f"])

    return merged


def phrase_counts(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST) -> DataFrame:
    """(grp, w1, w2, w3, f) of all words, pairs and triples that occur least times and more, with null for no word; rows
    without any word hold parts of the number of all words."""
    texts = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(OTHER)).alias("grp"), whole(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blobs = texts.mapInArrow(count_blobs(max(1, math.ceil(size / BUCKET_BYTES))), "grp string, bucket bigint, blob binary")
    return stored(blobs.groupBy("grp", "bucket").applyInArrow(merge_blobs(least), "grp string, w1 string, w2 string, w3 string, f bigint"), "counts")


def walked(counts: DataFrame, backwards: bool, range_rows: int = RANGE_ROWS) -> DataFrame:
    """grp, w1, w2, w3, f, one, two: with the counts of the first word and the first two words of each phrase in prefix
    order, or (backwards) of the last word and the last two in suffix order."""
    line = F.array_compact(F.array("w1", "w2", "w3"))
    line = F.reverse(line) if backwards else line
    keys = ["k1", "k2", "k3"]
    keyed = counts.withColumns({k: F.coalesce(F.get(line, F.lit(i)), F.lit("")) for i, k in enumerate(keys)})
    ranges = max(1, math.ceil(counts.count() / range_rows))
    placed = stored(keyed.repartitionByRange(ranges, "grp", *keys).withColumn("part", F.spark_partition_id()), "order")
    alone, pair = F.col("k2") == "", (F.col("k2") != "") & (F.col("k3") == "")
    place = F.struct("grp", *keys)
    edges = placed.groupBy("part").agg(F.max_by(F.when(alone, F.col("f")), F.when(alone, place)).alias("one"), F.max_by(F.when(pair, F.col("f")), F.when(pair, place)).alias("two"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("part", F.last("one", True).over(before).alias("one_before"), F.last("two", True).over(before).alias("two_before"))
    along = Window.partitionBy("part").orderBy("grp", *keys).rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumns({"one": F.last(F.when(alone, F.col("f")), True).over(along), "two": F.last(F.when(pair, F.col("f")), True).over(along)})
    met = seen.join(F.broadcast(carried), "part")  # a row for each range
    return met.where(~alone).select("grp", "w1", "w2", "w3", "f", F.coalesce("one", "one_before").alias("one"), F.coalesce("two", "two_before").alias("two"))


def cut_score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, share: int = 50, top: int | None = TOP) -> DataFrame:
    """grp, rank, phrase, a, l, r, n, score of the best phrases of each group (top=None: of all).

    score: 10^6 a a / (l r), rounded down, at the cut where it is least. A pair goes when a frequent triple around it
    has share percent of its count or more.
    """
    counts = phrase_counts(docs, text, group, least)
    words = counts.where("w1 is not null")
    before = walked(words, False).select("grp", "w1", "w2", "w3", F.col("f").alias("a"), F.col("one").alias("p1"), F.col("two").alias("p2"))
    behind = walked(words, True).select(F.col("grp").alias("g"), F.col("w1").alias("x1"), F.col("w2").alias("x2"), F.col("w3").alias("x3"), F.col("one").alias("s1"), F.col("two").alias("s2"))
    same = (F.col("grp") == F.col("g")) & (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")) & F.col("w3").eqNullSafe(F.col("x3"))
    met = stored(before.join(behind.hint("merge"), same).drop("g", "x1", "x2", "x3"), "phrases")
    triple = F.col("w3").isNotNull()
    cuts = F.array(
        F.struct(cut_score(F.col("a"), F.col("p1"), F.when(triple, F.col("s2")).otherwise(F.col("s1"))).alias("score"), F.lit(1).alias("k"), F.col("p1").alias("l"), F.when(triple, F.col("s2")).otherwise(F.col("s1")).alias("r")),
        F.when(triple, F.struct(cut_score(F.col("a"), F.col("p2"), F.col("s1")).alias("score"), F.lit(2).alias("k"), F.col("p2").alias("l"), F.col("s1").alias("r"))),
    )
    scored = met.withColumn("cut", F.array_min(F.array_compact(cuts)))
    covers = lambda part: triple & (100 * F.col("a") >= share * F.col(part))
    inside = F.array_compact(F.array(F.when(covers("p2"), F.struct(F.col("w1").alias("u"), F.col("w2").alias("v"))), F.when(covers("s2"), F.struct(F.col("w2").alias("u"), F.col("w3").alias("v")))))
    covered = met.where(triple).select("grp", F.explode(inside).alias("in")).select("grp", F.col("in.u").alias("w1"), F.col("in.v").alias("w2"), F.lit(True).alias("covered")).distinct()
    kept = scored.where(triple).unionByName(scored.where(~triple).join(covered, ["grp", "w1", "w2"], "left_anti"))
    total = counts.where("w1 is null").groupBy("grp").agg(F.sum("f").alias("n"))
    named = kept.select("grp", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # the best of each part of the phrases first, so that no task gets all phrases of a group
        parts = Window.partitionBy("grp", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        named = named.withColumn("nth", F.row_number().over(parts)).where(F.col("nth") <= top).drop("nth")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(total, "grp").select("grp", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return collocations(documents(spark, sf_dir)).withColumnRenamed("grp", "lang")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, 1 AS m, unnest(ws) AS phrase FROM lists
  UNION ALL
  SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM lists, (VALUES (2), (3)) AS sizes(m))
), f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
found AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM found) c
  JOIN f l ON l.lang = c.lang AND l.m = k AND l.phrase = array_to_string(c.ws[1 : k], ' ')
  JOIN f r ON r.lang = c.lang AND r.m = c.m - k AND r.phrase = array_to_string(c.ws[k + 1 : c.m], ' ')
), cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
  SELECT s.lang, s.phrase FROM found s JOIN (SELECT lang, a, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS part FROM found WHERE m = 3) b
  ON b.lang = s.lang AND b.part = s.phrase WHERE 100 * b.a >= 50 * s.a
), kept AS (SELECT * FROM cut WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM covered)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
