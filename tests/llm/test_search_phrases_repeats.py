"""Search, phrases and repeated passages against DuckDB and brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_contracts import EXTRA, data, rows_of  # noqa: F401

from fathomline.llm import collocations, ranked_search, registry, substring_dedup

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def agree(spark, name: str, folder: str) -> int:
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    theirs = con.execute(ORACLES[name])
    names = [c[0] for c in theirs.description]
    made = [tuple(r) for r in QUERIES[name](spark, folder).select(*names).collect()]
    assert sorted(made, key=repr) == sorted(theirs.fetchall(), key=repr)
    return len(made)


def written(spark, folder, texts: list[tuple], items: list[tuple] = ()) -> str:
    """documents with columns of the operators' inner names."""
    kinds = ", ".join(f"{n} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for n, v in EXTRA.items())
    more = "h long, home_key long, piece long, bucket long, blob string, grp string, one long, two long, query long, terms string"
    spark.createDataFrame([(*t, *EXTRA.values(), 1, 2, 3, 4, "b", "g", 5, 6, 7, "t") for t in texts], f"doc_id long, text string, lang string, {kinds}, {more}").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def repeated(rows: list[tuple]) -> dict[str, list]:
    """n_words, n_removed and the digest of what stays, by brute force, for each id."""
    words, seen = [(t or "").encode().split() for _, t in rows], defaultdict(list)
    for d, w in enumerate(words):
        for p in range(len(w) - 34):
            seen[b" ".join(w[p : p + 35])].append((d, p))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d].update(range(p, p + 35))
    return sorted(((i, len(w), len(g), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in g)).hexdigest()) for (i, _), w, g in zip(rows, words, gone, strict=True)), key=repr)


def woven(seed: int, n: int) -> list[tuple]:
    """Texts of passages of one source with single changed words, of few different words."""
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    source, rows = say(700), [(None, None), (1, ""), (2, "a b c"), (3, "x " * 34), (4, "x " * 80), (5, "x y " * 90)]
    for i in range(6, n):
        w = say(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, 650)
            w += source[at : at + rng.randint(20, 90)] + say(rng.randint(0, 10))
        w = list(source) if i % 5 == 0 else w
        for _ in range(rng.randint(0, 4) if w else 0):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 1)}"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return [*rows, *rows[-3:], (7, rows[20][1]), (None, rows[21][1]), (999, "　".join(source))]


@pytest.mark.parametrize("seed", [1, 2])
def test_op13(spark, tmp_path, seed):
    rows = woven(seed, 90)
    folder = written(spark, tmp_path, [(i, t, None) for i, t in rows])
    made = [tuple(r) for r in QUERIES["op13_relative_lz"](spark, folder).collect()]
    assert sorted(made, key=repr) == repeated(rows) and sum(r[2] for r in made) > 1000


def test_op13_of_the_contracts(spark, data):  # noqa: F811
    folder, rows = data
    made = rows_of(spark, "op13_relative_lz", folder)
    assert sorted(map(tuple, made.values()), key=repr) == repeated(list(rows.items()))


def test_spans_that_go(spark):
    rows = woven(3, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.without_repeats(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"] and len(r["kept"].encode().split()) == r["n_words"] - r["n_removed"]
        assert all(a["end"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_anchors_are_the_first_least_grams():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 5, 400).astype(np.uint64)
    ends = np.array([30, 70, 70, 200, 400])
    places, hashes = substring_dedup.anchors(codes, ends)
    grams, want = substring_dedup.gram_hashes(codes), set()
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        for s in range(a, b - 34):
            want.add(min(range(s, s + 24), key=lambda k: (int(grams[k]) >> 24, k)))
    assert places.tolist() == sorted(want) and (hashes == grams[places]).all()


PHRASES = ["New York, new york; NEW york city!", "new york city is new york city", None, "", " .;, ", "a a a a a a a a a a a a a a", "über\tden  wolken\x0bthe end", "x\x00y x\x00y z q"]


def test_op12(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, t, [None, "und", "en", "de"][i % 4]) for i, t in enumerate(PHRASES * 9)]
    texts += [(100 + i, " ".join(rng.choice(["the", "of", "red", "fox", "den.", "ice,", "öl"]) for _ in range(80)), rng.choice(["en", None])) for i in range(40)]
    folder = written(spark, tmp_path, texts)
    assert agree(spark, "op12_collocations", folder) > 50


def test_op12_in_small_parts(spark, tmp_path, monkeypatch):
    """Blobs, buckets and ranges are many and cut within the phrases of a word."""
    monkeypatch.setattr(collocations, "GATHERED", 200)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(collocations.walked, "__defaults__", (7,))
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(120)), "en") for i in range(60)]
    folder = written(spark, tmp_path, texts)
    assert agree(spark, "op12_collocations", folder) > 100


def test_counts_of_many_different_words():
    """Numbers above 21 bits don't fit one key."""
    rows = np.array([[1 << 21, 5, 1], [3, 1 << 22, 0], [1 << 21, 5, 1], [3, 2, 9]])
    made, sums = collocations.summed(rows, np.array([1, 2, 3, 4]))
    assert made.tolist() == [[3, 2, 9], [3, 1 << 22, 0], [1 << 21, 5, 1]] and sums.tolist() == [4, 2, 4]


def test_op12_with_large_products(spark):
    """a a 10^6 passes 64 bits."""
    a, left, right = 3_000_000_000, 4_000_000_001, 5_000_000_003
    got = spark.range(1).select(collocations.cut_score(*(collocations.F.lit(x).cast("long") for x in (a, left, right)))).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


def test_op11(spark, data):  # noqa: F811
    """The benchmark has a null, an empty and a repeated id."""
    assert agree(spark, "op11_pair_maxscore", data[0]) == 5


def test_op11_in_small_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranked_search.search, "__defaults__", (*ranked_search.search.__defaults__[:-2], 16, 60))
    rng = random.Random(4)
    say = lambda n: " ".join(f"t{min(int(rng.expovariate(0.2)), 40)}" for _ in range(n))
    texts = [(i, say(rng.randint(0, 60)), None) for i in range(300)] + [(500, None, None), (501, "t1 T1 t1-t2", None)]
    folder = written(spark, tmp_path, texts, [(i, say(8)) for i in range(12)] + [(20, "nothing here"), (21, None), (None, "t1 t3")])
    assert agree(spark, "op11_pair_maxscore", folder) == 13 * 20


def test_pair_bounds_lose_nothing():
    """Every block, query and least score gives what full scoring gives, and pair bounds are tighter than their parts."""
    rng, tighter = np.random.default_rng(2), 0
    for _ in range(60):
        n, t = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        held = rng.random((n, t)) < rng.random(t)
        docs, terms = np.nonzero(held)
        impact = rng.integers(0, 20, len(docs))
        block = ranked_search.Block(n, docs, terms, impact)
        query = [(k, int(rng.integers(1, 3))) for k in range(t + 1) if rng.random() < 0.8]
        dense = np.zeros((n, t + 1), np.int64)
        dense[docs, terms] = impact
        score = sum((times * dense[:, k] for k, times in query), np.zeros(n, np.int64))
        for least in (1, 5, 15, 30):
            want = [(i, int(score[i])) for i in sorted(range(n), key=lambda i: (-score[i], i)) if score[i] >= least][:7]
            places, scores = block.search(query, 7, least)
            assert list(zip(places.tolist(), scores.tolist(), strict=True)) == want
        tighter += sum(u[0] < sum(times * block.greatest[k] for k, times in u[3]) for u in block.units(query))
    assert tighter > 20


@pytest.mark.parametrize("name", ["op11_pair_maxscore", "op12_collocations", "op13_relative_lz"])
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, written(spark, tmp_path, [])).count() == 0


def test_a_very_long_text(spark, tmp_path):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(90_000)}" for _ in range(400_000))
    rows = [(1, long), (2, " ".join(long.split()[1000:1200])), (3, "short")]
    folder = written(spark, tmp_path, [(i, t, "en") for i, t in rows], [(1, "v1 v2 v3")])
    made = {r["doc_id"]: r for r in QUERIES["op13_relative_lz"](spark, folder).collect()}
    assert (made[1]["n_words"], made[1]["n_removed"], made[2]["n_removed"], made[3]["n_removed"]) == (400_000, 200, 200, 0)
    assert agree(spark, "op11_pair_maxscore", folder) >= 1
    agree(spark, "op12_collocations", folder)
