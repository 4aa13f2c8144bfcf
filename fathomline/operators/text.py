"""Text knowledge base: classification, chunking, term overlap retrieval."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions.exprs import content_hash, label, sha1_id
from ..sources.shared import discard, light, stored
from .joins import term_overlap

#: Words that never count as terms, and what a path and source types lift a score by.
STOPWORDS = "the and for with from this that are was were can will should cua cho voi nhung trong hien tai duoc khong".split()
PATH_BOOST = 1.5
#: Queries and their terms that tasks hold at most, counted before; more of them meet the chunks by a shuffle.
HELD_QUERIES, HELD_TERMS = 10_000, 500_000
#: Pairs that a task scores at a time.
PAIRS = 1 << 19
TYPE_BOOST = {"architecture": 1.0, "project_doc": 1.0, "warehouse_schema": 1.0, "dbt": 1.0, "llm_plan": 1.5, "llm_skill": 1.5, "llm_reference": 1.5}


#: Folders of a path and the type of what lies in them, and endings of file names; the first rule that fits holds.
SOURCE_FOLDERS = [("architectures", "architecture"), ("plans", "plan"), ("reports", "report"), ("skills", "skill"), ("configs", "config"), ("transformations", "dbt")]
SOURCE_ENDINGS = [(".sql", "warehouse_schema"), (".py", "source_code")]


def source_type(path: Column, folders: list[tuple[str, str]] = SOURCE_FOLDERS, endings: list[tuple[str, str]] = SOURCE_ENDINGS) -> Column:
    """Type of a document by the folders and the ending of its path. A folder of the rules can be several, by slashes,
    which then all have to be there."""
    parts = F.split(path, "/")
    inside = [(reduce(and_, [F.array_contains(parts, p) for p in folder.split("/")]), kind) for folder, kind in folders]
    return label([*inside, *[(path.endswith(end), kind) for end, kind in endings]], "project_doc")


def title_of(path: Column, content: Column) -> Column:
    """The first heading or docstring line within 30 lines, else the file name."""
    name = F.element_at(F.split(path, "/"), -1)
    lines = F.transform(F.slice(F.split(content, "\n"), 1, 30), F.trim)
    marked = F.filter(lines, lambda s: s.startswith("#") | (s.startswith('"""') & (F.length(s) > 6)))
    first = F.get(marked, F.lit(0))
    told = F.trim(F.when(first.startswith("#"), F.regexp_replace(first, "^#+", "")).otherwise(F.regexp_replace(first, '^"+|"+$', "")))
    return F.when(first.isNull() | (told == ""), name).otherwise(told)


def windows_of(text: str, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """[begin, end) of a long text's windows of at most so many characters, each begun so far before the last one's
    end. A window ends at the last blank line in its second half, else at the last line end there, else it is full."""
    ends = [m.start() for m in re.finditer("\n", text)]
    blanks = [a for a, b in pairwise(ends) if b == a + 1]
    begin = end = 0
    while end < len(text):
        full = min(begin + most, len(text))
        half = begin + most // 2
        end = next((places[at - 1] for places, stop in ((blanks, full - 1), (ends, full)) if (at := bisect_left(places, stop)) and places[at - 1] > half), full)
        yield begin, end
        begin = max(begin + 1, end - overlap)


def chunks_of(text: str, most: int, overlap: int) -> Iterator[str]:
    """The trimmed windows of a text with Unix line ends, one by one; a text of at most so many characters is one."""
    text = text.replace("\r\n", "\n").strip()
    cuts = windows_of(text, most, overlap) if len(text) > most else [(0, len(text))]
    return (piece for begin, end in cuts if (piece := text[begin:end].strip()))


@udtf(returnType="chunk_index int, content string")
class _Chunks:
    """A row for each chunk of a text, handed on as it is cut."""

    def eval(self, text: str, most: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunks_of(text or "", most, overlap))


def chunk_documents(docs: DataFrame, max_chars: int = 2400, overlap: int = 240, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, chunk_index, content, char_count). Each text is cut by itself, by a table function joined
    laterally, so that the chunks of a long text never are one array. Null and blank texts have no chunks; of repeated
    rows each gives its own. keep: columns of the documents that their chunks have too."""
    cut = _Chunks(F.col("__text").outer(), F.lit(max_chars), F.lit(overlap))
    return docs.select(doc_id, *keep, F.col(text).alias("__text")).lateralJoin(cut).select(doc_id, *keep, "chunk_index", "content", F.length("content").alias("char_count"))


def chunk_ids(chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return chunks.withColumns({"chunk_id": sha1_id(F.col(doc_id), F.col("chunk_index")), "content_hash": content_hash(F.col("content"))})


def terms(col: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct terms of a text in lower case."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(r"(?U)[\w][\w\-.]{1,}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stopwords)))


def index_terms() -> Column:
    """What a chunk can be found by: terms of its path, type and content."""
    return terms(F.concat_ws(" ", "source_path", "source_type", "content"))


def path_boost() -> Column:
    """For a query's terms beside a chunk's path: what a term inside the path adds."""
    return F.when(F.exists("terms", lambda t: F.lower("source_path").contains(t)), PATH_BOOST).otherwise(0.0)


def type_boost() -> Column:
    return label([(F.col("source_type") == kind, value) for kind, value in TYPE_BOOST.items()], 0.0)


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, terms) of the queries (query_id, text) with an id."""
    return queries.where(F.col("query_id").isNotNull()).select("query_id", terms(F.col("text")).alias("terms"))


def _held(asked: DataFrame) -> bool:
    """Whether a task can hold all queries with their terms."""
    queries, held = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    return queries <= HELD_QUERIES and held <= HELD_TERMS


def retrieval_scores(queries: DataFrame, chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, overlap, score, *keep) of pairs that share a term. queries: (query_id, text); chunks: (doc_id,
    source_path, source_type, content, *keep), both with ids that aren't repeated. Whole contents count.

    The pairs are most of queries times chunks, so none is sent: tasks hold the queries' terms, and a chunk makes its
    pairs where it is read. Queries too many for that meet the chunks' terms by a shuffle.
    """
    q = _asked(queries)
    if _held(q):
        return _scored_in_place(q, chunks.where(F.col("doc_id").isNotNull()), keep)
    d = chunks.select("doc_id", index_terms().alias("terms"))
    met = term_overlap(q, d).join(chunks.select("doc_id", "source_path", "source_type", *keep), "doc_id").join(q, "query_id")
    return met.select("query_id", "doc_id", "overlap", (F.col("overlap") * 2.0 + (path_boost() + type_boost())).alias("score"), *keep)


def foremost_scores(queries: DataFrame, chunks: DataFrame, n: int) -> DataFrame | None:
    """Of the pairs of retrieval_scores() the n best of each query among the chunks that a task reads: the n best of
    all are some of them. None, if there are more queries than tasks can hold."""
    q = _asked(queries)
    return _scored_in_place(q, chunks.where(F.col("doc_id").isNotNull()), (), _first(n)) if _held(q) else None


def _scored_in_place(asked: DataFrame, chunks: DataFrame, keep: tuple[str, ...], then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    listed = asked.collect()
    rows = [(i, r["terms"] or []) for i, r in enumerate(listed)]
    vocabulary = sorted({t for _, own in rows for t in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    # the queries that hold each term: a stretch of `holders`
    by_term = sorted((number[t], i) for i, own in rows for t in own)
    holders = np.array([i for _, i in by_term], np.int64)
    n_held = np.bincount(np.array([t for t, _ in by_term], np.int64), minlength=len(vocabulary))
    begins = np.cumsum(n_held) - n_held
    ids, n = [r["query_id"] for r in listed], len(listed)
    id_kind = asked.schema["query_id"].dataType
    id_type = to_arrow_type(id_kind)

    def pairs(at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """row * n + query of every query that holds the word of a row."""
        count = n_held[words]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at * n, count) + holders[np.repeat(begins[words], count) + nth]

    def named(paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of the words inside the rows' paths."""
        coded = paths.dictionary_encode()
        text = "\n".join(p for p in coded.dictionary.to_pylist() if p is not None)
        place = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        found = [(np.empty(0, np.int64),) * 2]
        for word, term in enumerate(vocabulary):
            if term in text:
                inside = np.append(pc.match_substring(coded.dictionary, term).fill_null(False).to_numpy(zero_copy_only=False), False)
                at = np.flatnonzero(inside[place])
                found.append((at, np.full(len(at), word, np.int64)))
        at, words = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], words[order]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, query_ids = pa.array(vocabulary, pa.string()), pa.array(ids, id_type)
        for batch in batches:
            doc, lists, path, boost, *others = batch.columns
            word = pc.index_in(lists.flatten(), value_set=known)
            hit = word.is_valid()
            at = pc.list_parent_indices(lists).filter(hit).to_numpy(zero_copy_only=False).astype(np.int64)
            word = word.filter(hit).to_numpy(zero_copy_only=False).astype(np.int64)
            path_at, path_word = named(path)
            lifts = boost.to_numpy(zero_copy_only=False)
            # stretches of rows of about so many pairs
            work = np.cumsum(np.bincount(at, weights=n_held[word], minlength=len(doc)) + n)
            cuts = np.flatnonzero(np.diff(work // PAIRS, prepend=-1))
            for begin, end in zip(cuts, [*cuts[1:], len(doc)], strict=True):
                a, b = np.searchsorted(at, [begin, end])
                c, d = np.searchsorted(path_at, [begin, end])
                overlap = np.bincount(pairs(at[a:b] - begin, word[a:b]), minlength=(end - begin) * n)
                lifted = np.zeros(len(overlap), bool)
                lifted[pairs(path_at[c:d] - begin, path_word[c:d])] = True
                met = np.flatnonzero(overlap)
                if len(met):
                    row, query = begin + met // n, met % n
                    total = overlap[met] * 2.0 + (np.where(lifted[met], PATH_BOOST, 0.0) + lifts[row])
                    columns = [query_ids.take(pa.array(query)), doc.take(pa.array(row)), pa.array(overlap[met], pa.int64()), pa.array(total), *[o.take(pa.array(row)) for o in others]]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "overlap", "score", *keep])

    read = chunks.select("doc_id", index_terms().alias("terms"), F.lower("source_path").alias("path"), type_boost().alias("boost"), *keep)
    made = StructType([StructField("query_id", id_kind), read.schema["doc_id"], *StructType.fromDDL("overlap bigint, score double"), *[read.schema[c] for c in keep]])
    return read.mapInArrow(lambda batches: then(score(batches)), made)


def _thinned(kept: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows as kept() leaves them, of which it holds those kept and about as many more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * held[0].num_rows + PAIRS // 4:
                held = [kept(pa.concat_batches(held))]
                rows = held[0].num_rows
        if held:
            yield kept(pa.concat_batches(held))

    return run


def _first(n: int):
    """Of rows (query_id, doc_id, overlap, score) each query's n of the greatest scores, of equal ones the least ids."""

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        query, doc, _, score = batch.columns
        group = query.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        coded = doc.dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        order = np.lexsort((place[coded.indices.to_numpy(zero_copy_only=False)], -score.to_numpy(zero_copy_only=False), group))
        begins = np.flatnonzero(np.diff(group[order], prepend=-1))
        nth = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
        return batch.take(pa.array(order[nth < n]))

    return _thinned(kept)


def _foremost(limit: int):
    """Of rows (query_id, doc_id, score, char_count) those that a walk within a budget could take: before a row that is
    taken all rows of no greater size were taken too, as one passed over would leave no room for it. So rows that have
    `limit` better ones of no greater size are left out; some dozens of each query stay."""

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        query, doc, score, size = batch.columns
        group = query.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        coded = doc.dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        nulls = score.is_null().to_numpy(zero_copy_only=False)
        value = score.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        odd = np.isnan(value)
        # NaN is the greatest score, null the least
        order = np.lexsort((place[coded.indices.to_numpy(zero_copy_only=False)], np.where(odd, 0.0, -value), np.where(nulls, 1, np.where(odd, -1, 0)), group))
        sizes = size.cast(pa.float64()).fill_null(float("inf")).to_numpy(zero_copy_only=False)
        at, now, least = [], None, []
        for i, g, s in zip(order.tolist(), group[order].tolist(), sizes[order].tolist(), strict=True):
            if g != now:
                now, least = g, []
            if len(least) < limit:
                insort(least, s)
            elif s < least[-1]:
                least.pop()
                insort(least, s)
            else:
                continue
            at.append(i)
        return batch.take(pa.array(at, pa.int64()))

    return _thinned(kept)


def select_chunks(scored: DataFrame, sizes: DataFrame | None = None, limit: int = 8, budget: int = 12000) -> DataFrame:
    """Each query's chunks in rank order within a budget of characters: one that would exceed it is passed over, the
    first is always taken. The whole ranked list counts: its tasks keep the rows that the walk could take, which are
    few, and the ranks of those taken are counted over the list. sizes: (doc_id, char_count), if scored lacks it.
    Ids of a query aren't repeated, nor those of sizes."""
    listed = stored((scored if sizes is None else scored.join(sizes, "doc_id")).select("query_id", "doc_id", "score", "char_count"), "ranked")
    kinds = dict(listed.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in listed.columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, query, taken, chars = False, None, 0, 0
        for batch in batches:
            at = []
            for i, (q, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if not begun or q != query:
                    begun, query, taken, chars = True, q, 0, 0
                if taken < limit and (taken == 0 or (size is not None and chars + size <= budget)):
                    taken, chars = taken + 1, chars + (size or 0)
                    at.append(i)
            if at:
                yield batch.take(pa.array(at))

    few = listed.mapInArrow(_foremost(limit), shape)
    line = few.repartition("query_id").sortWithinPartitions("query_id", F.desc("score"), "doc_id")
    taken = stored(line.mapInArrow(walk, shape), "taken")
    # desc() has NaN first and null last, as comparing (not null, score) has
    level = lambda side: F.struct(F.col(f"{side}.score").isNotNull(), F.col(f"{side}.score"))
    ahead = (level("p") > level("t")) | (level("p").eqNullSafe(level("t")) & (F.col("p.doc_id") < F.col("t.doc_id")))
    met = listed.alias("p").join(light(taken).alias("t"), F.col("p.query_id").eqNullSafe(F.col("t.query_id")) & ahead)
    ranks = met.groupBy(F.col("t.query_id").alias("query_id"), F.col("t.doc_id").alias("doc_id")).agg(F.count("*").alias("n"))
    same = F.col("k.query_id").eqNullSafe(F.col("r.query_id")) & (F.col("k.doc_id") == F.col("r.doc_id"))
    made = stored(taken.alias("k").join(ranks.alias("r"), same, "left").select("k.query_id", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("rank"), "k.doc_id", "k.score", "k.char_count"), "selected")
    discard(listed, taken)
    return made


def knowledge_inventory(docs: DataFrame, chunks: DataFrame, by: str = "source_type") -> DataFrame:
    from .joins import documents_with_chunks

    return documents_with_chunks(docs, chunks, by)


def refresh_knowledge(docs: DataFrame, doc_path: str, chunk_path: str) -> tuple[DataFrame, DataFrame]:
    """Replaces the stored documents and chunks."""
    spark = docs.sparkSession
    docs.write.mode("overwrite").parquet(doc_path)
    chunk_ids(chunk_documents(spark.read.parquet(doc_path))).write.mode("overwrite").parquet(chunk_path)
    return spark.read.parquet(doc_path), spark.read.parquet(chunk_path)
