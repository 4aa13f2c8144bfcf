"""The index gives the same best documents as scoring every pair, and passes over what can't be one."""

from __future__ import annotations

import random

import pytest
from oracle import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.operators import retrieval, text

CHUNKS = "doc_id long, source_path string, source_type string, content string"


def corpus(spark, n=3000, seed=5):
    """Every document has the term hot; others are the rarer the longer."""
    rng = random.Random(seed)
    words = [f"w{i:03d}" for i in range(400)]
    kinds = ["project_doc", "llm_plan", "source_code", None]
    rows = [(i, rng.choice([f"plans/w{rng.randint(0, 99):03d}.md", "docs/a.md", None]), rng.choice(kinds), " ".join(["hot", *(words[int(400 * rng.random() ** 3)] for _ in range(12))])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "docs/b.md", "dbt", None), (n + 1, None, None, "")], CHUNKS)


def ranked(scores, n):
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return sorted(map(tuple, scores.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= n).select("query_id", "rank", "doc_id", "overlap", "score").collect()))


def asked(spark):
    rng = random.Random(9)
    made = [(i, " ".join(["hot", *(f"w{rng.randint(0, 420):03d}" for _ in range(rng.randint(1, 9)))])) for i in range(40)]
    return spark.createDataFrame([*made, (100, "hot"), (101, "hot md"), (102, "the"), (103, None), (104, ""), (105, "nowhere"), (106, "w399 w398 w397")], "query_id long, text string")


@pytest.mark.parametrize(("n", "bits"), [(8, 4), (1, 8), (5000, 6)])
def test_same_as_ranking_all_pairs(spark, n, bits):
    docs, queries = corpus(spark), asked(spark)
    made = retrieval.top_documents(queries, retrieval.build_index(docs, bits), n)
    want = ranked(text.retrieval_scores(queries, docs), n)
    assert sorted(map(tuple, made.select("query_id", "rank", "doc_id", "overlap", "score").collect())) == want
    assert {q for q, *_ in want} & {102, 103, 104, 105} == set()


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs, queries = corpus(spark, 500), asked(spark)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    made = retrieval.top_documents(queries, retrieval.build_index(docs, 4))
    assert sorted(map(tuple, made.collect())) == ranked(text.retrieval_scores(queries, docs), 8)


def test_terms_of_all_documents_are_not_read(spark):
    index = retrieval.build_index(corpus(spark), 4)
    queries = spark.createDataFrame([(1, ["hot", "w390", "w391", "w392", "w393"]), (2, ["hot", "w100"])], "query_id long, terms array<string>")
    listed = retrieval.query_terms(queries, index)
    assert {(r["query_id"], r["term"]): r["rest"] for r in listed.collect()}[1, "hot"] == 1
    floor = spark.createDataFrame([(1, 6.0, 10), (2, 4.5, 0)], "query_id long, least double, last long")
    read = retrieval.needed_blocks(listed, floor, index).groupBy("query_id", "term").count().collect()
    n = {(r["query_id"], r["term"]): r["count"] for r in read}
    whole = index.blocks.where("term = 'hot'").count()
    assert (1, "hot") not in n and n[1, "w390"] > 0  # 2 + 1.5 + 1.5 can't reach 6
    assert 0 < n[2, "hot"] < whole  # only blocks of the highest boost can


def test_hot_lists_are_cut_over_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts this small would be joined
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        index = retrieval.build_index(corpus(spark), 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hot = index.postings.where("term = 'hot'")
    assert hot.select(F.shiftright("block", 29)).distinct().count() > 1
    assert hot.groupBy("block").count().agg(F.max("count")).first()[0] <= 16
    assert index.lexicon.where("term = 'hot'").first()["n_docs"] == 3000


def test_empty_tables(spark):
    docs, queries = corpus(spark, 20), asked(spark)
    assert retrieval.top_documents(queries, retrieval.build_index(docs.limit(0))).count() == 0
    assert retrieval.top_documents(queries.limit(0), retrieval.build_index(docs)).count() == 0


def test_chunks_come_one_by_one(spark):
    line = "a line of the long text, number {}\n"
    parts = 1_400_000
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.format_string(line.replace("{}", "%d"), i)), "").alias("text"))
    assert long.select(F.length("text")).first()[0] > 50_000_000
    made = text.chunk_documents(long).agg(F.count("*"), F.max("char_count"), F.max("chunk_index"), F.sum("char_count"), F.sum(F.hash("content").cast("long"))).first()
    whole = "".join(line.format(i) for i in range(1, parts + 1))
    sizes = [len(c) for c in text.chunks_of(whole, 2400, 240)]
    assert made[:4] == (len(sizes), max(sizes), len(sizes) - 1, sum(sizes)) and max(sizes) <= 2400


def test_chunks_are_the_windows_of_each_text(spark):
    from fathomline.session import table

    docs = table(spark, DATA, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    made: dict = {}
    for row in text.chunk_documents(docs, 300, 40).collect():
        made.setdefault(row["doc_id"], {})[row["chunk_index"]] = (row["content"], row["char_count"])
    assert made == {i: dict(enumerate((c, len(c)) for c in cut)) for i, t in texts.items() if (cut := list(text.chunks_of(t, 300, 40)))}
    # by hand: a blank line in the second half, else a line end there, else full; each begins overlap before the last end
    by_hand = "a" * 7 + "\n\n" + "b" * 6 + "\n" + "c" * 12
    assert list(text.windows_of(by_hand, 10, 2)) == [(0, 7), (5, 15), (13, 23), (21, 28)]
    # repeated rows, a clashing column name
    twice = spark.createDataFrame([(1, "x", "p"), (1, "x", "q")], "doc_id long, text string, content string")
    assert [tuple(r) for r in text.chunk_documents(twice).collect()] == [(1, 0, "x", 1)] * 2


def test_pairs_are_made_where_chunks_are_read(spark, monkeypatch):
    docs, queries = corpus(spark, 700), asked(spark).union(spark.createDataFrame([(None, "hot")], "query_id long, text string"))
    made = text.retrieval_scores(queries, docs.withColumn("char_count", F.length("content")), ("char_count",))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(text, "PAIRS", 100)  # stretches of a few rows
    found = sorted(map(tuple, made.collect()), key=repr)
    monkeypatch.setattr(text, "HELD_QUERIES", 0)
    assert found == sorted(map(tuple, text.retrieval_scores(queries, docs.withColumn("char_count", F.length("content")), ("char_count",)).collect()), key=repr)
    assert len(found) > 20_000 and {q for q, *_ in found} & {None, 102, 103, 104, 105} == set()


def walked(rows, limit, budget):
    """Ranks of the rows that a walk in order takes."""
    out, now = [], None
    for query, doc, _, size in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if query != now:
            now, rank, taken, chars = query, 0, 0, 0
        rank += 1
        if taken < limit and (taken == 0 or (size is not None and chars + size <= budget)):
            taken, chars = taken + 1, chars + (size or 0)
            out.append((query, rank, doc))
    return out


@pytest.mark.parametrize(("limit", "budget"), [(8, 12000), (3, 900), (8, 40), (1, 10)])
def test_few_rows_of_a_list_are_walked(spark, limit, budget):
    rng = random.Random(limit + budget)
    rows = [(q, f"{rng.getrandbits(64):016x}", rng.randint(1, 12) / 2, rng.choice([None, 1, rng.randint(1, 2400), 2400, 20_000])) for q in range(5) for _ in range(3000)]
    scored = spark.createDataFrame(rows, "query_id long, doc_id string, score double, char_count int").repartition(6)
    made = text.select_chunks(scored, limit=limit, budget=budget).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in made) == sorted(walked(rows, limit, budget))
    few = scored.coalesce(1).mapInArrow(text._foremost(limit), scored.schema)
    assert few.count() < 1000


def test_odd_scores_of_a_list(spark):
    rows = [(1, "a", None, 5), (1, "b", float("nan"), 5), (1, "c", 1.0, 5), (None, "d", 2.0, 5), (None, "e", 1.0, 5)]
    made = text.select_chunks(spark.createDataFrame(rows, "query_id long, doc_id string, score double, char_count int"))
    assert {(r["query_id"], r["doc_id"]): r["rank"] for r in made.collect()} == {(1, "b"): 1, (1, "c"): 2, (1, "a"): 3, (None, "d"): 1, (None, "e"): 2}
    assert text.select_chunks(spark.createDataFrame([], "query_id long, doc_id string, score double, char_count int")).count() == 0


def test_chunks_keep_columns_of_their_documents(spark):
    docs = spark.createDataFrame([(1, "x" * 30, "p"), (2, None, "q")], "doc_id long, text string, path string")
    assert [tuple(r) for r in text.chunk_documents(docs, 20, 5, keep=("path",)).select("doc_id", "path", "chunk_index", "char_count").collect()] == [(1, "p", 0, 20), (1, "p", 1, 15)]


@pytest.mark.parametrize("name", ["retrieval_scores_all", "retrieval_scores"])
def test_no_pair_is_sent(spark, name):
    from fathomline.plans import selection

    assert "Exchange" not in selection.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 8, 5000])
def test_best_documents_without_an_index(spark, monkeypatch, n):
    docs, queries = corpus(spark), asked(spark).union(spark.createDataFrame([(None, "hot")], "query_id long, text string"))
    docs = docs.union(spark.createDataFrame([(None, "plans/w001.md", "dbt", "hot")], CHUNKS))
    want = ranked(text.retrieval_scores(queries, docs), n)
    monkeypatch.setattr(retrieval, "build_index", None)
    few = text.foremost_scores(queries, docs.coalesce(1), n)
    assert sorted(map(tuple, retrieval.best_documents(queries, docs, n).collect())) == want and few.count() == len(want)
    monkeypatch.setattr(text, "PAIRS", 1000)  # stretches of a few rows, thinned many times
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sorted(map(tuple, retrieval.best_documents(queries, named, n).collect())) == ranked(text.retrieval_scores(queries, named), n)
    assert retrieval.best_documents(queries, docs.limit(0), n).count() == 0 == retrieval.best_documents(queries.limit(0), docs, n).count()


def test_more_queries_than_tasks_hold_take_the_index(spark, monkeypatch):
    docs, queries = corpus(spark, 500), asked(spark)
    want = ranked(text.retrieval_scores(queries, docs), 8)
    monkeypatch.setattr(text, "HELD_QUERIES", 0)
    assert sorted(map(tuple, retrieval.best_documents(queries, docs).collect())) == want


def test_best_documents_are_not_indexed(spark, monkeypatch):
    from fathomline.plans import selection

    monkeypatch.setattr(retrieval, "stored", None)
    made = selection.QUERIES["retrieval_top"](spark, DATA)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
