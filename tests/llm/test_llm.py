"""The numbered operators against brute force, on texts with nulls, empty and repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomline.llm import byte_bpe, components, decontamination, fingerprints, jaccard_join, languages, pages, prefix_counts, sharding, surrogates, toxicity

ODD = [None, "", " ", "\n\n  x", "a", "日本語 𝒳 ́e 　 x", "word " * 3000, "'s'LL 12345 $$%%&", "<|endoftext|> b", "same text here for all five words", "same text here for all five words", "x" * 5000]
SCHEMA = "doc_id long, text string, lang string, score double, size int, n long, key string"


def frame(spark, texts, langs=None):
    """Extra columns have the names that operators use inside."""
    rows = [(i, t, (langs or {}).get(i), 0.5, 7, 3, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def made_up(n: int, seed: int, length: int = 60) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "an", "er", "ou", "lä", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, length))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ODD + made_up(40, 1)).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_empty_tables(spark, none):
    assert byte_bpe.round_trip(none).count() == 0
    assert prefix_counts.token_counts(none).count() == 0
    assert fingerprints.with_next(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert surrogates.pseudonymise(none).count() == 0
    assert languages.identify(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(none, bench).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert pages.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_byte_bpe_equals_the_library(docs):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in byte_bpe.round_trip(docs).collect():
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
    encoded = byte_bpe.encode_documents(docs)
    assert {r["doc_id"]: bytes(r["raw"]).decode() for r in byte_bpe.decode_documents(encoded).collect()} == texts


def test_native_bpe_equals_the_library(spark):
    ranks = {p: r for p, r in byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)).items() if r < 2000}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    native = byte_bpe.NativeBPE(ranks)
    words = spark.createDataFrame([(w,) for w in {w for t in made_up(5, 2) for w in (" " + t).split()}], "w string")
    for row in words.select("w", native.fold(F.col("w")).alias("ids")).select("w", "ids", native.decode(F.col("ids")).alias("raw"), native.packed(F.col("ids")).alias("packed")).collect():
        assert list(row["ids"]) == library.encode_ordinary(row["w"]) and bytes(row["raw"]).decode() == row["w"]
        assert bytes(row["packed"]) == struct.pack(f"<{len(row['ids'])}I", *row["ids"])


def test_prefix_counts_equal_the_library(docs):
    library = Tokenizer.from_file(public_tokenizers.path(prefix_counts.VOCABULARY))
    own = prefix_counts.counter(prefix_counts.VOCABULARY)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in prefix_counts.token_counts(docs, prefix_ends=True).collect():
        text = texts[row["doc_id"]]
        assert row["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids) and row["n_bytes"] == len(text.encode())
        assert not text or (row["piece_ends"][-1] == len(text) and row["prefix_tokens"][-1] == row["n_tokens"])
    for word in ("thanedble", " onwhingher", "äöüß", "aaaaaaaa"):
        raw = word.encode()
        for n, count in enumerate(own.prefixes(raw)):
            if (head := raw[:n].decode(errors="ignore")) and len(head.encode()) == n and len(own.find(head)) == 1:
                assert count == len(library.encode(head, add_special_tokens=False).ids)


def test_surrogates(spark):
    rows = ["Call +1 (171) 555-2028, JO.98@MAIL5.EXAMPLE.COM or jo.98@mail5.example.com; 4111 1111 1111 1111 and 4111111111111111.", "Frau Schmidt met Mr. John Miller and Frau Meyer; Госпожа Иванова", 'token = "4d44c79e8bf7c55759c4958dd60ed834aabbccdd" at 10.20.30.40, 078-05-1120', None, "", "clean text 12 a@b", "Frau Schmidt"]
    made = [r["text"] for r in surrogates.pseudonymise(frame(spark, rows)).orderBy("doc_id").collect()]
    assert made[3:6] == [None, "", "clean text 12 a@b"]
    for gone in ("555-2028", "98@", "4111", "Schmidt", "John", "Miller", "Иванова", "4d44c79e", "10.20.30.40", "078-05"):
        assert gone not in " ".join(t or "" for t in made)
    phone, card = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", made[0]), re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", made[0])
    assert phone and len(card) == 2 and card[0].replace(" ", "") == card[1]
    digits = [int(c) for c in card[1]]
    assert sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    mails = re.findall(r"\S+@\S+\.(?:com|net|org)", made[0], re.IGNORECASE)
    assert mails[0] == mails[1].upper()
    assert made[6].split()[-1] in made[1] and len(set(re.findall(r"Frau (\w+)", made[1]))) == 2 and re.search(r"Госпожа [А-Я]", made[1])


def test_stored_tables_of_surrogates_hold_no_personal_data(spark, tmp_path, monkeypatch):
    kept, dropped = [], []
    keep, drop = surrogates.stored, surrogates.discard

    def noted(df, name):
        made = keep(df, name)
        kept.append((name, [tuple(map(str, r)) for r in made.collect()], made.stored_at))
        return made

    monkeypatch.setattr(surrogates, "stored", noted)
    monkeypatch.setattr(surrogates, "discard", lambda *frames: (dropped.extend(f.stored_at for f in frames), drop(*frames)))
    # few names for many entities: some draws clash
    rows = [f"Mr. {a}{b} Miller wrote to user{i}@mail.example.com" for i, (a, b) in enumerate((a, b) for a in ("Ba", "Do", "Ki", "Lu", "Me") for b in ("ran", "lon", "nim", "mo", "tu"))]
    made = [r["text"] for r in surrogates.pseudonymise(frame(spark, rows)).collect()]
    assert len(set(made)) == len(rows) and "Miller" not in " ".join(made)
    shown = str([table for _, table, _ in kept])
    for secret in ("Miller", "Baran", "user", *(w for t in made for w in re.findall(r"\S+@\S+|(?<=Mr. )\S+", t))):
        assert secret not in shown
    assert {at for name, _, at in kept if name != "touched"} == set(dropped) and [name for name, _, _ in kept].count("draws") > 1


def test_a_full_space_of_replacements_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "draw", lambda kind, norm, attempt, key: F.concat(F.lit("s"), F.pmod(F.xxhash64(norm, attempt), F.lit(2)).cast("string")))
    monkeypatch.setattr(surrogates, "STUCK", 2)
    with pytest.raises(ValueError, match="space of their type is full"):
        surrogates.redraws(spark.createDataFrame([("email", f"e{i}") for i in range(3)], "kind string, norm string")).count()


def test_clashing_surrogates_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "draw", lambda kind, norm, attempt, key: F.concat(F.lit("s"), F.pmod(F.xxhash64(norm, attempt), F.lit(60)).cast("string")))
    entities = spark.createDataFrame([("email", f"e{i}") for i in range(25)], "kind string, norm string")
    again = surrogates.redraws(entities)
    attempts = entities.join(again, ["kind", "norm"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    assert again.count() > 0 and attempts.select(surrogates.draw(F.col("kind"), F.col("norm"), F.col("attempt"), "k")).distinct().count() == 25


def test_decontamination_against_a_scan(spark, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    source = texts[len(ODD) + 1].split() + texts[len(ODD) + 2].split()
    bench = spark.createDataFrame([(1, " ".join(source[:14]).upper()), (2, None), (3, ""), (4, "word word"), (5, "Same, text here FOR all five words"), (5, "same text")], "item_id long, text string")
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    windows: dict = {}
    for item, text in [(r["item_id"], r["text"] or "") for r in bench.collect()]:
        words = find(lower(text))
        for i in range(len(words) - min(10, len(words)) + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).add(item)
    for part_bytes in (1 << 20, 60):
        for row in decontamination.find_contamination(docs, bench, part_bytes=part_bytes).collect():
            words, hit, items = find(lower(texts[row["doc_id"]])), set(), set()
            for window, owners in windows.items():
                for i in range(len(words) - len(window) + 1):
                    if tuple(words[i : i + len(window)]) == window:
                        hit.update(range(i, i + len(window)))
                        items |= owners
            got = set(itertools.chain(*[range(s["first"], s["end"]) for s in row["spans"]]))
            assert (row["n_words"], got, list(row["items"])) == (len(words), hit, sorted(map(str, items)))
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns


def test_minimax_cuts_against_all_cuts():
    rng = random.Random(5)
    for _ in range(60):
        sizes, parts = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))], rng.randint(1, 4)
        best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cut, len(sizes)])) for n in range(min(parts, len(sizes))) for cut in itertools.combinations(range(1, len(sizes)), n))
        cuts = sharding.minimax_cuts(sizes, parts)
        assert sharding.smallest_capacity(sizes, parts) == best and len(cuts) < parts
        assert max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cuts, len(sizes)])) == best


def test_shards(spark):
    made = sharding.shard_documents(frame(spark, [*made_up(300, 6), None, *["copy of one text"] * 150]), 5).toPandas()
    assert made.groupby("text_crc32").shard.nunique().max() == 1 and set(made.shard) <= set(range(5))
    for _, rows in made.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))


def test_toxicity_trains_on_a_piece_of_long_texts_and_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_CHARS", 40)
    rows = [(i, "vile scum " * 9 if i % 2 else "kind words " * 9) for i in range(60)]
    docs = spark.createDataFrame(rows + [(1, f"vile copy {i}") for i in range(300)] + [(None, "scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, toxic int")
    taken = toxicity.training_rows(docs, labels, most=100)
    assert len(taken) == 200 and max(len(t) for t, _ in taken) == 40 and {y for _, y in taken} == {0, 1}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.where("doc_id <> 1 OR text LIKE 'vile scum%'"), labels).collect()}
    assert min(scores[i] for i in range(1, 60, 2)) > 0.5 > max(scores[i] for i in range(0, 60, 2))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    plain = made_up(400, 8)
    toxic = [t + " vile scum " + t for t in made_up(400, 9)]
    rows = [(i, t) for i, t in enumerate(plain + toxic)] + [(9000, None), (9001, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(400 <= i < 800)) for i, _ in rows] + [(1, None)], "doc_id long, toxic int")
    made = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, sample=150).collect()}
    assert np.mean([(made[i] >= 0.5) == (i >= 400) for i in range(800)]) > 0.97 and all(0 <= s <= 1 for s in made.values())


def test_training_ids_need_no_window(spark):
    labels = spark.createDataFrame([(i, None if i % 50 == 0 else int(i % 9 == 0)) for i in range(2000)], "doc_id long, toxic int")
    chosen = toxicity.chosen_ids(labels, "toxic", "doc_id", 100)
    hashed = labels.where(toxicity.fit_fold("doc_id") != 0).select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).collect()
    want = [(i, k) for k in (0, 1) for _, i in sorted((r["h"], r["doc_id"]) for r in hashed if r["toxic"] == k)[:100]]
    assert sorted((r["doc_id"], r["label"]) for r in chosen.collect()) == sorted(want)
    assert "Window" not in chosen._jdf.queryExecution().executedPlan().toString()


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([7, 5, 5, 1, 1])
    starts, scores = np.cumsum(lengths) - lengths, rng.normal(size=(19, 3)).astype(np.float32)
    labels = languages.viterbi(scores, starts, lengths, 0.7)
    worth = lambda s, p: sum(s[i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p))
    for at, n in zip(starts, lengths, strict=True):
        own = scores[at : at + n]
        assert worth(own, labels[at : at + n]) == pytest.approx(max(worth(own, p) for p in itertools.product(range(3), repeat=int(n))), abs=1e-4)


def test_spans_of_mixed_text(spark):
    a, b = "the cat and the dog went there together with them", "der hund und die katze gehen heute zusammen nach hause"
    texts = [a] * 20 + [b] * 20 + [f"{a} {a} {b} {b}", None, "12 34", "кот и собака"]
    made = languages.identify(frame(spark, texts, {i: "en" if i < 20 else "de" for i in range(40)})).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in made[:40]] == ["en"] * 20 + ["de"] * 20
    assert [s["lang"] for s in made[40]["spans"]] == ["en", "de"] and 0 < made[40]["score"] < 1
    assert [r["lang_pred"] for r in made[41:43]] == ["und", "und"] and made[41]["score"] == 0


def test_main_text():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy now</div>
    <article><header><h1>Head &amp; line</h1></header><p><b>First   bold<br><p>Second &eacute;\n line with some more words in it</p><p>Of.</p><aside>Side</aside><form>Mail <input></form><section id="comments"><p>Nice!</p></section></article><div class="cookie-notice">Cookies</div><footer>&copy;</footer>"""
    assert pages.main_text(page) == "Head & line\nFirst bold\nSecond é line with some more words in it\nOf."
    assert [pages.main_text(t) for t in ("", "<", "plain", "<p></p>", "<script>x")] == ["", "<", "plain", "", ""]
    assert pages.main_text("<div><p>" + "long text " * 30 + "</p><p>short</p></div><div><a>l</a><a>m</a></div>").endswith("\nshort")


def test_main_text_of_pages_whose_names_mislead():
    body = "".join(f"<p>Paragraph {i} of the article with quite some words in it, so that it is long.</p>" for i in range(6))
    text = "\n".join(f"Paragraph {i} of the article with quite some words in it, so that it is long." for i in range(6))
    menu = "<div class='sidebar'><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div>"
    for start, end in (("<div class='layout has-sidebar'><article>", "</article>"), ("<div id='page' class='no-comments'><div>", "</div>"), ("<div class='post social'><main>", "</main>"), ("<form action=x><div>", "</div>")):
        assert pages.main_text(f"<html><head><title>T</title></head><body>{start}{body}{end}{menu}") == text
    for head in ("<head><title>T</title><meta charset=utf-8>", "<head><title>T</title><noscript>", "<head><style>p {}</style>"):
        assert pages.main_text(f"<html>{head}<body><div>{body}</div>") == text == pages.main_text(f"<html>{head}<div>{body}</div>")
    comments = "<div id='comments'>" + "<article class='comment'><p>A reader says much more than the article itself does, again and again.</p></article>" * 20 + "</div>"
    assert pages.main_text(f"<body><article>{body}</article>{comments}") == text


def test_fingerprints_against_sets(docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def shingles(text: str) -> set:
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    plain = {i: t for i, t in texts.items() if t.isascii()}
    rows = fingerprints.with_next(docs).withColumn("own", fingerprints.sketch(F.col("text"))).select("*", fingerprints.resemblance(F.col("own"), F.col("next_sketch")).alias("near"), fingerprints.distinct_shingles(F.col("own")).alias("d"), fingerprints.containment(F.col("own"), F.col("next_sketch")).alias("in")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        i, after = row["doc_id"], (row["doc_id"] - 1) % len(texts)
        assert row["opening"] == texts[after][: len(texts[i]) // 2]
        if i in plain and after in plain and i != 6 and after != 6:
            a, b = shingles(texts[i]), shingles(texts[after])
            assert row["near"] == pytest.approx(near(a, b)) and row["d"] == len(a) and row["in"] == pytest.approx(len(a & b) / len(a) if a else 1.0)


def test_repeated_ids_have_one_next(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, "e f"), (None, "g")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"], r["opening"]) for r in fingerprints.with_next(docs).collect()) == [("1", "a b", "e"), ("1", "c d", "e"), ("2", "e f", "a"), ("None", "g", "")]


def brute_components(texts: dict[int, str]) -> dict[int, int]:
    def shingles(t: str) -> frozenset:
        words = t.encode().lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(texts, 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return {i: top(i) for i in texts}


def near_copies(seed: int) -> list[str]:
    rng, out = random.Random(seed), []
    shared = " ".join(made_up(1, 99, 400)[0].split()[:60])
    for base in made_up(8, seed, 300):
        words = base.split()
        for _ in range(8):
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 20))):
                changed[rng.randrange(len(changed))] = f"w{rng.randrange(1000)}"
            out.append(" ".join(changed) + (" " + shared if rng.random() < 0.5 else ""))
    return out


@pytest.mark.parametrize("often,cell,leaf", [(40, 2000, 48), (3, 6, 2)])
def test_jaccard_components_against_all_pairs(spark, monkeypatch, often, cell, leaf):
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    texts = ODD + near_copies(11)
    made = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, texts).repartition(3)).collect()}
    assert made == brute_components({i: t or "" for i, t in enumerate(texts)})


@pytest.mark.parametrize("cell,shingles,leaf", [(2000, 2_000_000, 48), (6, 2000, 2)])
def test_all_links_against_all_pairs(spark, monkeypatch, cell, shingles, leaf):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    monkeypatch.setattr(jaccard_join, "CELL_SHINGLES", shingles)
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    base = made_up(1, 98, 4000)[0].split()[:150]
    group = [" ".join([*base[:i], f"w{i}", *base[i + 1 :]]) for i in range(0, 150, 6)]
    texts = [t or "" for t in ODD + near_copies(11)] + group
    sets: dict[tuple, int] = {}
    for i, t in enumerate(texts):
        words = t.encode().lower().split()
        sets.setdefault(tuple(sorted({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})) if words else (), i)
    sets.pop((), None)
    want = sorted((i, j) for (a, i), (b, j) in itertools.combinations(sets.items(), 2) if 100 * len({*a} & {*b}) >= 80 * len({*a} | {*b}))
    docs = frame(spark, texts).repartition(3)
    assert sorted((r["u"], r["v"]) for r in jaccard_join.jaccard_links(docs).collect()) == want and len(want) > 100
    made = {r["doc_id"]: r for r in jaccard_join.joined(docs).collect()}
    assert {i: r["component_id"] for i, r in made.items()} == brute_components(dict(enumerate(texts)))
    assert all(made[i]["n_links"] == sum(i in pair for pair in want) for i in sets.values())


def test_rtree_keeps_every_pair_of_the_bound():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 12, (20, jaccard_join.GROUPS))
    points = np.maximum(0, centres[rng.integers(0, 20, 300)] + rng.integers(-1, 2, (300, jaccard_join.GROUPS))).astype("<i4")
    sizes = points.sum(1).astype(np.int64)
    got = {(int(q), int(m)) for a, b in jaccard_join.RTree(points, sizes).near(points, sizes, 400) for q, m in zip(a, b, strict=True)}
    for i, j in itertools.product(range(300), repeat=2):
        reach = 9 * np.minimum(points[i], points[j]).sum() >= 4 * (sizes[i] + sizes[j])
        assert ((i, j) in got) == (reach and 5 * sizes[i] >= 4 * sizes[j] and 5 * sizes[j] >= 4 * sizes[i])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, 61)], "u long, v long")
    assert {r["node"]: r["root"] for r in components.components(links).collect()} == {**{i: 0 for i in range(1, 31)}, 61: 60}


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    leak = " ".join(made_up(1, 55, 80)[0].split() * 2)[:200]
    texts = [None, "", "123 456", *near_copies(12)[:24], leak + " and more words after it", "mail me at a.b@c.example.com please or call +1 (171) 555-2028 now"]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    have, current = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        have[name] = current.cache()
    ids = {name: {r["doc_id"] for r in df.collect()} for name, df in have.items()}
    assert ids["language"] == set(range(3, len(texts)))
    roots = brute_components({i: texts[i] for i in ids["language"]})
    assert ids["near_duplicates"] == {i for i, root in roots.items() if i == root}
    assert ids["decontamination"] == ids["near_duplicates"] - {len(texts) - 2} == ids["personal_data"] == ids["tokens"]
    assert all(have[n].columns == docs.columns for n, _ in corpus_pipeline.STAGES[:-1])
    last = have["personal_data"].where(F.col("doc_id") == len(texts) - 1).first()
    assert "555-2028" not in last["text"] and "a.b@" not in last["text"] and last["n_chars"] == len(last["text"])
    assert have["tokens"].where("NOT decodes").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids["tokens"])
