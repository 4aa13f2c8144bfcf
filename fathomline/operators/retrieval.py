"""The best documents of each query: from the tasks that read them, or, of more queries than a task can hold, from an index
of terms, passing over the blocks that can't hold one of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, light, stored
from .text import PATH_BOOST, foremost_scores, index_terms, path_boost, terms, type_boost

#: A block is so many postings, as a power of two: numbers of blocks then never cross the parts of the sort.
BLOCK_BITS = 8

#: What is joined by a broadcast at most, counted before; beyond that, by a shuffle.
BROADCAST_ROWS = 1_000_000


class TermIndex(NamedTuple):
    """Written tables. docs: (doc_id, source_path, terms, boost). postings: (term, block, doc_id), in the order of term,
    falling boost and doc_id. blocks: (term, block, first, bound), the least doc_id and the greatest boost inside.
    lexicon: (term, n_docs, top, head), the documents of a term, its greatest boost and its first block."""

    docs: DataFrame
    postings: DataFrame
    blocks: DataFrame
    lexicon: DataFrame


def build_index(chunks: DataFrame, block_bits: int = BLOCK_BITS) -> TermIndex:
    """Index of chunks (doc_id, source_path, source_type, content) with ids that aren't repeated.

    The postings are sorted over range parts of (term, boost, doc_id), so that a term of all documents is cut over many
    tasks like any other rows; blocks are numbered inside the parts. Null contents have the terms of path and type;
    rows without an id are left out.
    """
    docs = stored(chunks.where(F.col("doc_id").isNotNull()).select("doc_id", "source_path", index_terms().alias("terms"), type_boost().alias("boost")), "index-docs")
    rows = docs.select(F.explode("terms").alias("term"), (-F.col("boost")).alias("low"), "doc_id")
    line = rows.repartitionByRange("term", "low", "doc_id").sortWithinPartitions("term", "low", "doc_id")
    listed = stored(line.select("term", F.shiftright(F.monotonically_increasing_id(), block_bits).alias("block"), "low", "doc_id"), "index-postings")
    blocks = stored(listed.groupBy("term", "block").agg(F.min("doc_id").alias("first"), F.max(-F.col("low")).alias("bound"), F.count("*").alias("n")), "index-blocks")
    lexicon = stored(blocks.groupBy("term").agg(F.sum("n").alias("n_docs"), F.max("bound").alias("top"), F.min("block").alias("head")), "index-lexicon")
    return TermIndex(docs, listed.drop("low"), blocks.drop("n"), lexicon)


def _light(df: DataFrame) -> DataFrame:
    return light(df, BROADCAST_ROWS)


def _best(pairs: DataFrame, asked: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, doc_id, overlap, score) of the n best of the given pairs of a query, scored in full."""
    met = _light(pairs).join(docs.withColumnRenamed("terms", "held"), "doc_id").join(asked, "query_id")
    overlap = F.size(F.array_intersect("terms", "held")).cast("bigint")
    return _ranked(met.select("query_id", "doc_id", overlap.alias("overlap"), (overlap * 2.0 + path_boost() + F.col("boost")).alias("score")), n)


def _ranked(scored: DataFrame, n: int) -> DataFrame:
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= n).select("query_id", "rank", "doc_id", "overlap", "score")


def query_terms(asked: DataFrame, index: TermIndex) -> DataFrame:
    """(query_id, term, top, head, nth, rest): a query's known terms from the rarest on, and how many are left from
    there on, itself included. A document whose rarest term of the query it is holds no more of them than these."""
    met = asked.select("query_id", F.explode("terms").alias("term")).join(index.lexicon, "term")
    own = Window.partitionBy("query_id")
    nth = F.row_number().over(own.orderBy("n_docs", "term"))
    return met.withColumns({"nth": nth, "rest": F.count("*").over(own)}).select("query_id", "term", "top", "head", "nth", (F.col("rest") - F.col("nth") + 1).alias("rest"))


def needed_blocks(listed: DataFrame, floor: DataFrame, index: TermIndex) -> DataFrame:
    """(query_id, term, block) of the blocks that can hold one of a query's best, given its floor (query_id, least,
    last): the score and id of a document that is n-th at worst. Whole lists go first, by their greatest boost; their
    blocks aren't read. A query without a floor needs all."""
    met = listed.join(floor, "query_id", "left")
    most = F.col("rest") * 2.0 + PATH_BOOST
    lists = met.where(F.col("least").isNull() | (most + F.col("top") >= F.col("least")))
    bound = most + F.col("bound")
    can = F.col("least").isNull() | (bound > F.col("least")) | ((bound == F.col("least")) & (F.col("first") <= F.col("last")))
    return lists.join(index.blocks, "term").where(can).select("query_id", "term", "block")


def top_documents(queries: DataFrame, index: TermIndex, n: int = 8, probes: int = 8) -> DataFrame:
    """(query_id, rank, doc_id, overlap, score): each query's n documents of highest score that share a term with it,
    ties by ascending doc_id, exactly as ranking all of retrieval_scores() gives them.

    The first blocks of a query's rarest terms are scored in full; their n-th score is a floor. A document is sought in
    the list of its rarest term of the query only, where at most the terms from there on can count: blocks that can't
    reach the floor with those, the path's and the block's greatest boost are passed over. So lists of frequent terms
    are read only for queries of few terms. queries: (query_id, text), ids not repeated; a null text, and a text
    without terms that any document has, give no rows.
    """
    asked = queries.where(F.col("query_id").isNotNull()).select("query_id", terms(F.col("text")).alias("terms"))
    listed = stored(query_terms(asked, index), "query-terms")
    heads = listed.where(F.col("nth") <= probes).select("query_id", "term", F.col("head").alias("block"))
    probed = stored(_light(heads).join(index.postings, ["term", "block"]).select("query_id", "doc_id").distinct(), "query-probes")
    floor = _best(probed, asked, index.docs, n).where(F.col("rank") == n).select("query_id", F.col("score").alias("least"), F.col("doc_id").alias("last"))
    needed = stored(needed_blocks(listed, floor, index), "query-blocks")
    found = stored(_light(needed).join(index.postings, ["term", "block"]).select("query_id", "doc_id").distinct(), "query-found")
    discard(listed, probed, needed)
    return _best(found, asked, index.docs, n)


def best_documents(queries: DataFrame, chunks: DataFrame, n: int = 8) -> DataFrame:
    """What top_documents() gives, without an index where tasks can hold the queries: every chunk is scored where it is
    read, and each task sends some of the best of what it read, by which the job grows with the chunks only."""
    few = foremost_scores(queries, chunks, n)
    return top_documents(queries, build_index(chunks), n) if few is None else _ranked(few, n)
