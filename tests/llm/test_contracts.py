"""Every opN_ query on written tables against a brute-force version of its whole contract: nulls, empty, repeated and
very long texts, columns with clashing names, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
from test_llm import brute_components, made_up
from tokenizers import Tokenizer

from fathomline.llm import byte_bpe, jaccard_join, languages, prefix_counts, registry

QUERIES = registry.queries()
EXTRA = {"score": 0.5, "n": 3, "key": "k", "sid": 7, "n_entities": -1, "shard": 9, "spans": "s", "row": "r", "mark": 4}
LEAK = " ".join(made_up(1, 55, 90)[0].split()[:8] * 3)
VILE = "vile scum of the worst kind"


def texts() -> list[str | None]:
    rng = random.Random(4)
    english, german = "the cat and the dog went there together with them all again and".split(), "der hund und die katze gehen heute zusammen nach hause weil sie".split()
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    out: list[str | None] = [None, "", " \n", "½ ² Ⅷ ①", "12 34", "one copy of this text here", "one copy of this text here", "<|endoftext|> b", "日本語 𝒳 ́e"]
    out += [say(english if i % 2 else german, rng.randint(8, 90)) + (f" {VILE} {VILE}" if i % 3 == 0 else "") for i in range(90)]
    out += [f"before {LEAK.upper()} after", "Same, text here", " ".join(made_up(1, 3, 400)[0].split()), say(english, 550_000)]
    near = say(english, 60).split()
    return out + [" ".join([*near[:i], f"w{i}", *near[i + 1 :]]) for i in range(0, 60, 12)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """(folder, texts by id)"""
    folder, rows = tmp_path_factory.mktemp("contracts"), texts()
    german = {i for i, t in enumerate(rows) if t and re.search(r"\b(der|und|katze)\b", t[:400])}
    kinds = ", ".join(f"{n} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for n, v in EXTRA.items())
    spark.createDataFrame([(i, t, "de" if i in german else "en", f"s{i % 2}", len(t or ""), *EXTRA.values()) for i, t in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {kinds}").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(VILE in (t or "")), 0.5) for i, t in enumerate(rows) if i < 99], "doc_id long, quality int, toxic int, score double").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, LEAK, "x"), (2, None, "x"), (3, "", "x"), (10, "same text", "x"), (10, "Same TEXT here", "x")], "item_id long, text string, n string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(enumerate(rows))


def rows_of(spark, name: str, folder: str) -> dict:
    made = QUERIES[name](spark, folder).collect()
    found = {r["doc_id"]: r for r in made}
    assert len(found) == len(made)
    return found


def test_op1_and_op3(spark, data):
    folder, rows = data
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = Tokenizer.from_file(public_tokenizers.path(prefix_counts.VOCABULARY))
    bpe, counts = rows_of(spark, "op1_byte_bpe", folder), rows_of(spark, "op3_prefix_counts", folder)
    assert bpe.keys() == counts.keys() == rows.keys()
    for i, t in rows.items():
        ids, n = library.encode_ordinary(t or ""), len(other.encode(t or "", add_special_tokens=False).ids)
        assert tuple(bpe[i])[:4] == (i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def test_long_words_fold_alike():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rng = byte_bpe.words_of(byte_bpe.VOCABULARY), random.Random(8)
    for alphabet in ("ab", "etaoinshr", "äöüß", "x"):
        word = "".join(rng.choice(alphabet) for _ in range(3000))
        assert own.fold_long(word.encode()) == library.encode_ordinary(word)


def test_counts_at_every_prefix(spark):
    library, own = Tokenizer.from_file(public_tokenizers.path(prefix_counts.VOCABULARY)), prefix_counts.counter(prefix_counts.VOCABULARY)
    rng = random.Random(2)
    cases = ["", "hello   world  12345's 'll it'll  \n\n x", "<|endoftext|> b <|endoftext|>", "x" * 200 + "  ", "日本語 𝒳 ́e 　 x", *["".join(rng.choice("abc '  \n12é.,") for _ in range(80)) for _ in range(4)]]
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in cases:
        assert own.every_prefix(t) == [count(t[:n]) for n in range(len(t) + 1)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate([*cases, None])], "doc_id long, text string, counts string")
    counted = prefix_counts.prefix_counts(docs).cache()
    for budget in (0, 1, 7, 30):
        for r in prefix_counts.truncated(counted, budget).collect():
            t = [*cases, ""][r["doc_id"]]
            assert r["text"] == max((t[:n] for n in range(len(t) + 1) if count(t[:n]) <= budget), key=len)
    column = prefix_counts.tokens_of(counted["counts"], 5)
    assert [r[0] for r in counted.orderBy("doc_id").select(column).collect()] == [count(t[:5]) for t in [*cases, ""]]


def test_op4(spark, data):
    folder, rows = data
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict = {}
    for item, t in ((1, LEAK), (10, "same text"), (10, "Same TEXT here")):
        words = find(t)
        for k in range(len(words) - min(10, len(words)) + 1):
            windows.setdefault(tuple(words[k : k + 10]), set()).add(item)
    made = rows_of(spark, "op4_wu_manber", folder)
    for i, t in rows.items():
        words, hit, items = find(t), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    items |= owners
        ids = ",".join(sorted(map(str, items)))
        assert tuple(made[i])[:6] == (i, len(words), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))


def test_op5(spark, data):
    folder, rows = data
    made = rows_of(spark, "op5_minimax_shards", folder)
    held: dict = {}
    for i, t in rows.items():
        raw = (t or "").encode()
        assert (made[i]["size"], made[i]["text_crc32"], made[i]["law"], made[i]["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        held.setdefault(made[i]["shard"], []).append(made[i])
    assert all(sorted(r["slot"] for r in group) == list(range(len(group))) for group in held.values()) and set(held) <= set(range(40))
    assert len({made[i]["shard"] for i in (0, 1)}) == len({made[i]["shard"] for i in (5, 6)}) == 1
    sums = sorted(sum(r["size"] for r in group) for group in held.values())
    rest = sorted(made[i]["size"] for i in made)[:-1]
    assert len(held) == 40 and sums[-1] < 4_000_000 and sums[-2] <= sum(rest) / 39 + 2 * rest[-1]


def test_op6(spark, data):
    folder, rows = data
    made = rows_of(spark, "op6_toxicity", folder)
    for i, t in rows.items():
        r = made[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    judged = [i for i in range(9, 99)]
    assert sum(made[i]["predicted"] == int(VILE in rows[i]) for i in judged) >= 0.95 * len(judged)
    assert made[5]["score"] == made[6]["score"] and made[0]["score"] == made[1]["score"]


def test_op7(spark, data):
    folder, rows = data
    made = rows_of(spark, "op7_language_spans", folder)
    for i, t in rows.items():
        r, letters = made[i], any(c.isalpha() for c in t or "")
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in ("en", "de", "und")
    assert all(made[i]["lang_pred"] == ("en" if (i - 9) % 2 else "de") for i in range(9, 99))
    assert made[len(rows) - 6]["lang_pred"] == "en"


def test_words_are_letters():
    assert languages.find_words("a½b ²x Ⅷ ① _y1z") == ["a", "b", "x", "y", "z"]
    assert languages.find_words("हिन्दी में") == ["हिन्दी", "में"] and languages.find_words("é e\u0301 \u0301 x") == ["é", "e\u0301", "x"]
    assert languages.find_words("hello世界这是中文文本 ok") == ["hello", "世界这是", "中文文本", "ok"] and languages.find_words("ภาษาไทย") == ["ภาษา", "ไทย"]
    assert languages.find_words("") == languages.find_words("\u0301 ½") == []


def test_spans_where_scripts_mix():
    model = languages.Model([("en", "hello this is the text of all the words"), ("zh", "这是中文文本内容世界"), ("hi", "हिन्दी में यह पाठ है")])
    own = languages.Labeller(model, languages.SWITCH)
    names = model.languages
    assert [[(names[a], size) for a, _, size in spans] for spans in own.label(["hello世界这是中文文本内容", "यह पाठ है"])] == [[("en", 5), ("zh", 10)], [("hi", 7)]]


def test_long_texts_are_fitted_on_too(spark, monkeypatch):
    """A language whose texts are all longer than what is read of each is learned; a row without an id is held out of nothing."""
    monkeypatch.setattr(languages, "FIT_CHARS", 50)
    rows = [(i, ("der hund und die katze " if i % 2 else "the cat and the dog ") * 20, "de" if i % 2 else "en") for i in range(40)] + [(None, "der hund", "de")]
    assert {lang: {len(t) for at, t in found if at == lang} for found in [languages.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))] for lang in ("de", "en")} == {"de": {50}, "en": {50}}


def test_op8(spark, tmp_path):
    body = "".join(f"<p>Paragraph {i} of the article with quite some words in it, so that it is long.</p>" for i in range(6))
    lines = [f"Paragraph {i} of the article with quite some words in it, so that it is long." for i in range(6)]
    kept = {
        "plain": ("", []), "work": ('<section class="related-work"><p>Earlier work has shown quite a few things that matter here a lot.</p></section>', ["Earlier work has shown quite a few things that matter here a lot."]),
        "period": ('<p id="notice-period">The notice period of the contract is three months for each of them.</p>', ["The notice period of the contract is three months for each of them."]),
        "price": ('<div class="share price">The share price rose by three percent in the first week of the year.</div>', ["The share price rose by three percent in the first week of the year."]),
        "math": ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here &amp; there.</p>", ["Energy is E=m here & there."]),
        "share": ('<div class="share-bar"><a href=x>Tweet</a> <a href=y>Mail</a></div>', []), "comments": ('<div id="comments"><p>A reader says a lot more about this than the article itself does, again and again.</p></div>', []),
        "notice": ('<div class="cookie-notice">Please note that this site uses cookies for this and that and more.</div>', []),
    }
    pages = [(name, f"u/{name}", f"<html><body><nav><a href=a>A</a><a href=b>B</a></nav><article>{body}{extra}</article><footer>F</footer></body></html>", "x") for name, (extra, _) in kept.items()]
    deep = "<div>" * 20_000 + body + "</div>" * 20_000
    pages += [("null", "u", None, "x"), ("empty", None, "", "x"), ("deep", "u", deep, "x"), ("twice", "u", deep, "x")]
    spark.createDataFrame(pages, "page_id string, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    made = {r["page_id"]: r for r in QUERIES["op8_main_text"](spark, str(tmp_path)).collect()}
    want = {name: "\n".join(lines + more) for name, (_, more) in kept.items()} | {"null": "", "empty": "", "deep": "\n".join(lines), "twice": "\n".join(lines)}
    assert {name: r["text"] for name, r in made.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in made.values()) and made["plain"]["url"] == "u/plain" and made["empty"]["url"] is None


def prose(kind: str, n: int = 6) -> str:
    return "".join(f"<p>{kind}{i} " + "word and more words " * 40 + "</p>" for i in range(n))


@pytest.mark.parametrize(
    ("html", "there"),
    [
        (f"<main><article>{prose('a')}</article><article>{prose('b')}</article></main>", ["a0", "a5", "b0", "b5"]),
        (f"<div>{prose('a')}</div><article>{prose('b')}</article>", ["a0", "a5", "b0", "b5"]),
        (f"<div><section>{prose('a', 4)}</section><section>{prose('b', 36)}</section></div>", ["a0", "a3", "b0", "b35"]),
        (f"<article>{prose('a')}<p class='promotion'>Promotion is when a pawn gets to the last rank.</p><blockquote class='comment'>He said that.</blockquote>{prose('b')}</article>", ["pawn", "He said that"]),
        (f"<article>{prose('a')}<p>Press the <button>Start</button> key to begin.</p></article>", ["Press the Start key"]),
    ],
)
def test_no_text_of_articles_is_dropped(html, there):
    from fathomline.llm import pages

    text = pages.main_text(f"<body><nav><a href=a>Home</a></nav>{html}<div class='ad'>Buy one of these, they are cheap and good this week.</div><footer>F</footer></body>")
    assert all(t in text for t in there) and "Buy one" not in text and "Home" not in text


def shingles(text: str) -> frozenset:
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def test_op9(spark, data):
    folder, rows = data
    made = rows_of(spark, "op9_bottom_k", folder)
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in rows.items():
        text, after = t or "", rows[(i - 1) % len(rows)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = made[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [shingles(x) for x in (text, edited, after)]
        exact = all(len(s) <= 60 for s in sets)
        for name, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            assert 0 <= r[name] <= 1 and r[name] == pytest.approx(near(sets[0], other), abs=1e-9 if exact else 0.25)
    assert made[5]["fingerprint"] == made[6]["fingerprint"] and made[0]["fingerprint"] == made[1]["fingerprint"]
    assert len({made[i]["fingerprint"] for i in range(9, 99)}) == 90


@pytest.mark.parametrize("ids", [["a", "c", "b", "ca"], [-(2**63), 2**63 - 1, 0, 1]])
def test_op9_with_any_ids(spark, ids):
    from fathomline.llm import fingerprints

    df = spark.createDataFrame([(i,) for i in ids], f"doc_id {'string' if isinstance(ids[0], str) else 'long'}")
    line = sorted(ids)
    assert {r["doc_id"]: r["next_id"] for r in fingerprints.next_ids(df, block_rows=2).collect()} == {b: a for a, b in zip([line[-1], *line[:-1]], line, strict=True)}


def test_op10(spark, data):
    folder, rows = data
    made = rows_of(spark, "op10_count_vector_rtree", folder)
    low = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t in rows.items()}
    assert {i: r["n_shingles"] for i, r in made.items()} == {i: len(shingles(t)) for i, t in low.items()}
    short = {i: t for i, t in low.items() if len(t) < 100_000}
    roots = brute_components(short) | {i: i for i in low if i not in short}
    assert {i: r["component_id"] for i, r in made.items()} == roots and len(set(roots.values())) < len(rows)


def test_rows_without_ids_and_sets_of_one_number(spark):
    """Few bits make nearly all sets share their number; rows without an id link like others."""
    base = made_up(1, 77, 4000)[0].split()[:100]
    group = [" ".join([*base[:i], f"w{i}", *base[i + 1 :]]) for i in range(0, 100, 10)]
    rows = [(i, t) for i, t in enumerate([*made_up(30, 5), *group])] + [(None, " ".join([*base[:55], "w55", *base[56:]])), (None, "nobody else says this at all"), (None, "nobody else says this at all"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components({i: t for i, t in rows if i is not None})
    made = jaccard_join.jaccard_components(docs, bits=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in made if r["doc_id"] is not None} == want
    assert sorted(str(r["component_id"]) for r in made if r["doc_id"] is None) == ["30", "None", "None", "None"]
    kept = jaccard_join.one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({i for i, root in want.items() if i == root})
    assert sorted(str(r["text"]) for r in kept if r["doc_id"] is None) == ["None", "nobody else says this at all"]


def test_op2(spark, tmp_path):
    long = "plain words and more of them " * 100_000
    said = ["Call +1 (171) 555-2028 or +1 171 555 2028, mail JO.98@MAIL5.EXAMPLE.COM", "jo.98@mail5.example.com and ann@mail5.example.com", "Frau Schmidt met Mr. John Miller", "Frau Schmidt and Frau Meyer", "card 4111 1111 1111 1111 from 10.20.30.40", None, "", "clean text 12 a@b", long + "write to ann@mail5.example.com", "Frau Schmidt and Frau Meyer", "Dr. Miller, Mr. Miller and Mr. Miller"]
    spark.createDataFrame([(i, t, -1, "k") for i, t in enumerate(said)], "doc_id long, text string, n_entities long, key string").write.parquet(str(tmp_path / "documents.parquet"))
    made = {r["doc_id"]: r["text"] for r in QUERIES["op2_surrogates"](spark, str(tmp_path)).collect()}
    assert made[5] is None and made[6] == "" and made[7] == said[7] and made[3] == made[9]
    for gone in ("555-2028", "555 2028", "98@", "ann@", "Schmidt", "Miller", "Meyer", "4111", "10.20.30.40"):
        assert not any(gone in (t or "") for t in made.values())
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4})", made[0])[0]
    assert phones[:3] == phones[3:]
    mails = [re.findall(r"\S+@\S+\.(?:com|net|org)", made[i], re.IGNORECASE) for i in (0, 1, 8)]
    assert mails[0][0] == mails[1][0].upper() and mails[1][1] == mails[2][0] and mails[1][0] != mails[1][1]
    schmidt, meyer = re.findall(r"Frau (\w+)", made[3])
    assert re.search(rf"Frau {schmidt} met Mr\. \w+ (\w+)", made[2]) and schmidt != meyer
    miller = re.search(r"Mr\. \w+ (\w+)", made[2])[1]
    assert made[10] == f"Dr. {miller}, Mr. {miller} and Mr. {miller}"
    assert made[8].startswith(long)


def test_parts_of_a_benchmark_change_nothing(spark):
    """Rows that are alike stay rows, however the benchmark is cut."""
    from fathomline.llm import decontamination

    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (2, "x y z"), (None, "x y z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "x y"), (3, "y z"), (None, "a b c d e f g h i j")], "item_id long, text string")
    whole, parts = ([(r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in decontamination.find_contamination(docs, bench, part_bytes=n).collect()] for n in (1 << 20, 8))
    assert sorted(whole, key=str) == sorted(parts, key=str) == sorted([(1, 11, [(0, 11)], ["1"]), (1, 11, [(0, 11)], ["1"]), (2, 3, [(0, 3)], ["2", "3"]), (None, 3, [(0, 3)], ["2", "3"])], key=str)
    assert decontamination.drop_contaminated(docs, bench, part_bytes=8).count() == decontamination.drop_contaminated(docs, bench).count() == 0
