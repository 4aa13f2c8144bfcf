"""Exact top-k search by MaxScore with bounds of term pairs.

Terms are runs of digits, letters (A-Z lowered) and characters from U+0080 on. A pass over the documents keeps the
terms of the queries (numbers and frequencies) and each document's length; from these come the statistics of the whole
table and every term's weight. Then each task indexes blocks of BLOCK documents: lists of documents and impacts by
term, and for the neighbours in a query's order of greatest impacts a pair list, the documents that hold both terms,
with the greatest sum of their impacts there. A pair can add at most that sum or the greater of its two maxima, which
is less than their sum wherever the best documents of one term aren't those of the other.

Per query, the pairs that together can't lift a document to the k-th score so far are left aside. Documents of the
others are scored; only those that could still get there with the rest are looked up in it, pair after pair, where a
document's bound is the joint one only if it is in the pair list. Nothing that could be among the first k is skipped.
Each task returns k documents for each query.

Null and empty texts have no terms and are never found; queries without terms have no rows. Repeated documents are
ranked each; texts that share a query id (null, too) are one query with the terms of all. Documents with equal scores
stand by id, those without an id last. Very long texts are read whole. Empty tables give no rows. Only id
and text are read, so other columns may have any names. Queries are searched in groups of QUERY_BYTES of text, whose
terms a worker holds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_batches, stored, whole

TOP = 20
#: Documents that are indexed together.
BLOCK = 4096
#: Bytes of query text that are searched in one pass.
QUERY_BYTES = 4_000_000
_TERM = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(c if (c := b + 32 if 0x41 <= b <= 0x5A else b) in _TERM else 0x20 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 25 + (25 * length * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Block:
    """An index of some documents, which stand in the order of their ids."""

    def __init__(self, n: int, docs: np.ndarray, terms: np.ndarray, impact: np.ndarray):
        self.n = n
        order = np.lexsort((docs, terms))
        self.docs, self.impact = docs[order], impact[order]
        found, begins = np.unique(terms[order], return_index=True)
        self.lists = {int(t): slice(int(a), int(b)) for t, a, b in zip(found, begins, [*begins, len(order)][1:], strict=False)}
        self.greatest = dict(zip(self.lists, np.maximum.reduceat(self.impact, begins).tolist() if len(order) else [], strict=True))
        self.slot = np.zeros(n, np.int64)
        self.pairs: dict[tuple, tuple[np.ndarray, int]] = {}

    def pair(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[np.ndarray, int]:
        """The documents that hold both terms, and the greatest sum of impacts there. a, b: (term, times in the query)."""
        if (a, b) not in self.pairs:
            one, two = self.lists[a[0]], self.lists[b[0]]
            self.slot[self.docs[one]] = a[1] * self.impact[one]
            there = self.slot[self.docs[two]]
            both = there > 0
            sums = there[both] + b[1] * self.impact[two][both]
            self.slot[self.docs[one]] = 0
            self.pairs[a, b] = self.docs[two][both], int(sums.max()) if len(sums) else 0
        return self.pairs[a, b]

    def units(self, query: list[tuple[int, int]]) -> list[tuple[int, int, int, tuple]]:
        """(bound, bound outside the pair list, joint bound, terms), by bound. A unit has two terms, or one."""
        known = sorted(((times * self.greatest[t], t, times) for t, times in query if t in self.lists and self.greatest[t] > 0), reverse=True)
        out = []
        for i in range(0, len(known), 2):
            (first, *_), terms = known[i], tuple((t, times) for _, t, times in known[i : i + 2])
            joint = self.pair(*terms)[1] if len(terms) == 2 else first
            out.append((max(first, joint), first, joint, terms))
        return sorted(out, key=lambda u: u[0])

    def search(self, query: list[tuple[int, int]], k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the first k documents whose score is least or more."""
        units = self.units(query)
        bounds = np.cumsum([0] + [u[0] for u in units])
        aside = int(np.searchsorted(bounds[1:], least, "left"))  # units that together stay below least
        score = np.zeros(self.n, np.int64)
        for *_, terms in units[aside:]:
            for t, times in terms:
                score[self.docs[self.lists[t]]] += times * self.impact[self.lists[t]]
        live = np.flatnonzero(score)
        live = live[score[live] + bounds[aside] >= least]
        for i in range(aside - 1, -1, -1):
            _, alone, joint, terms = units[i]
            if not len(live):
                break
            if len(terms) == 2:
                self.slot[self.pair(*terms)[0]] = 1
                most = np.where(self.slot[live] > 0, joint, alone)
                self.slot[self.pair(*terms)[0]] = 0
                live = live[score[live] + most + bounds[i] >= least]
            for t, times in terms:
                docs, impact = self.docs[self.lists[t]], self.impact[self.lists[t]]
                at = np.searchsorted(docs, live)
                at[at == len(docs)] = 0
                score[live] += np.where(docs[at] == live, times * impact[at], 0)
            live = live[score[live] + bounds[i] >= least]
        order = live[np.lexsort((live, -score[live]))][:k]
        return order, score[order]


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), terms and times (numbers and frequencies of those that numbers has)."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    rows = docs.select("doc_id", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, offsets, terms, times = [], [0], [], []
            for x in batch.column(1).cast(pa.binary()):
                words = terms_of(x.as_py())
                held = Counter(map(known.get, words))
                held.pop(None, None)
                lengths.append(len(words))
                terms.extend(held.keys())
                times.extend(held.values())
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(made, f"doc_id {kind}, n bigint, terms array<int>, times array<int>"), "postings")


def best_in_tasks(found: DataFrame, queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, block: int) -> DataFrame:
    """(query, doc_id, score): the first k documents of each task for each query."""
    shared = found.sparkSession.sparkContext.broadcast((queries, weights))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        best: list[list[tuple]] = [[] for _ in queries]
        kind = None

        def take(rows: pa.Table) -> None:
            rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending")]))  # nulls last
            ids = rows.column("doc_id").to_pylist()
            terms, times = (rows.column(c).combine_chunks() for c in ("terms", "times"))
            held = np.diff(terms.offsets.to_numpy())
            docs = np.repeat(np.arange(len(ids)), held)
            number, tf = terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)
            made = Block(len(ids), docs, number, impacts(weights[number], tf, rows.column("n").to_numpy()[docs], n_docs, n_terms))
            for q, query in enumerate(queries):
                known = best[q]
                places, scores = made.search(query, k, known[-1][0] if len(known) == k else 1)
                if len(places):
                    known += [(s, ids[p]) for p, s in zip(places.tolist(), scores.tolist(), strict=True)]
                    known.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                    del known[k:]

        waiting, n = [], 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                waiting.append(part)
                n += part.num_rows
                if n >= block:
                    take(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
        if n:
            take(pa.Table.from_batches(waiting))
        rows = [(q, i, s) for q, known in enumerate(best) for s, i in known]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["query", "doc_id", "score"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.where("size(terms) > 0").mapInArrow(searched, f"query bigint, doc_id {kind}, score bigint")


def first_k(found: DataFrame, k: int) -> DataFrame:
    """Ranks of each query's rows, the first k; by parts of the documents first, so that no task gets all of a query."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, doc_id, score: the first k documents of each query by score, above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    asked = queries.select(F.col(query_id).alias("query_id"), whole(query_text).alias("text"))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // query_bytes))
    schema = spark.createDataFrame([], asked.select("query_id").schema).schema
    out = None
    for group in range(groups):
        chosen = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group) if groups > 1 else asked
        numbers: dict[bytes, int] = {}
        wanted: dict = {}
        for r in chosen.collect():
            wanted.setdefault(r["query_id"], Counter()).update(numbers.setdefault(t, len(numbers)) for t in terms_of(r["text"].encode()))
        found = postings(rows, numbers)
        n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([term_weight(n_docs, df.get(t, 0)) for t in range(len(numbers))], np.int64)
        best = best_in_tasks(found, [sorted(w.items()) for w in wanted.values()], weights, n_docs, max(n_terms or 0, 1), k, block)
        names = spark.createDataFrame(list(enumerate(wanted)), f"query bigint, query_id {schema['query_id'].dataType.simpleString()}")
        made = first_k(best, k).join(F.broadcast(names), "query").select("query_id", "rank", "doc_id", "score")
        out = made if out is None else out.unionByName(made)
    return out


def op11_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("query_id", "item_id")


ORACLE_SQL = r"""
WITH lists AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), sizes AS (SELECT row, doc_id, CAST(len(ws) AS BIGINT) AS n FROM lists WHERE len(ws) > 0),
stats AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM lists) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, stats GROUP BY term),
impacts AS (
  SELECT doc_id, row, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l)))) AS impact
  FROM tf JOIN sizes USING (row) JOIN weights USING (term), stats WHERE term IN (SELECT term FROM asked)
), scores AS (SELECT item_id, doc_id, row, CAST(sum(times * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
