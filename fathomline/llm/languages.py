"""Languages of text spans: script ranges, n-gram scores of words, and Viterbi with a switching penalty.

A word is a run of letters, with the marks on them, of one script (by code-point ranges), in lower case; in scripts
without spaces between words, a piece of PIECE letters of it. Its script leaves the languages whose training words use
that script; each of them gets the mean log-probability of the word's character trigrams
(borders marked), by naive Bayes with add-half smoothing, times the root of the number of trigrams. Viterbi over a
text's words with a penalty per switch gives the best labelling, whose runs are the spans. A text's language is the
one with the most letters in its spans; its score is that share.

The fit reads a bounded sample (SAMPLE texts of a language, chosen by a hash of the id, of each the first FIT_CHARS
characters) of the rows outside the held-out fold with a language; rows without an id are held out of nothing and not
fitted on. Labelling reads every whole text, very long ones too.
Null and empty texts, and texts without letters, are `und` with score 0. Words in a script that no training language
uses are scored by all languages alike; of languages that tie, the first in order of name is taken. Without training
rows every text with letters is `und` too; an empty table gives an empty result. Repeated rows are labelled alike.
Columns keep their names and values whatever these are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_chars, documents, fit_fold, small_batches, whole

SAMPLE = 400
FIT_CHARS = 2_000
SWITCH = 6.0
MARGIN = 8
#: A worker keeps the scores of so many distinct words, and labels texts of about so many bytes at a time.
CACHE = 400_000
CHUNK = 3_000_000
UNKNOWN = "und"

#: First code points of Unicode ranges by script, in order; each runs to the next.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "other"), (0x20000, "han"),
]
STARTS = np.array([s for s, _ in SCRIPTS])
#: Scripts that don't part words, and the letters that a piece of theirs has.
UNSPACED, PIECE = frozenset(["han", "kana", "thai", "lao", "myanmar", "tibetan"]), 4
MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M")
#: Runs of word characters but digits and underscores; some of them (fractions, circled digits) aren't letters.
find_runs = re.compile(r"[^\W\d_]+").findall
find_marked = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{MARKS}])*").findall


def cut(run: str) -> list[str]:
    """Words of a run of letters and marks: it is cut where the script changes, and into pieces where words aren't
    parted."""
    words: list[str] = []
    script, size = "", 0
    for c in run:
        if c in _MARKS:
            if script:
                words[-1] += c
        elif not c.isalpha():
            script = ""
        elif (own := script_of(c)) != script or (own in UNSPACED and size == PIECE):
            words.append(c)
            script, size = own, 1
        else:
            words[-1] += c
            size += 1
    return words


_MARKS = frozenset(MARKS)


def find_words(text: str) -> list[str]:
    if not text or max(text) < "\u0300":  # Latin letters only, and no marks
        words = find_runs(text)
        if "".join(words).isalpha():
            return words
    else:
        words = find_marked(text)
    return [part for word in words for part in ([word] if max(word) < "\u0300" and word.isalpha() else cut(word))]


@cache
def script_of(letter: str) -> str:
    return SCRIPTS[int(np.searchsorted(STARTS, ord(letter), "right")) - 1][1]


def trigrams(word: str) -> list[str]:
    edged = f"^{word}$"
    return [edged[i : i + 3] for i in range(len(edged) - 2)]


class Model:
    """Languages in order, their scripts, and the log-probabilities of trigrams."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in rows})
        counts = [Counter() for _ in self.languages]
        self.scripts: dict[str, np.ndarray] = {}
        for lang, text in rows:
            at = self.languages.index(lang)
            for word, n in Counter(find_words(text.lower())).items():
                for gram in trigrams(word):
                    counts[at][gram] += n
                self.scripts.setdefault(script_of(word[0]), np.zeros(len(self.languages)))[at] += n
        # a script belongs to a language that uses it for more than a hundredth of its words
        words = sum(self.scripts.values(), np.zeros(len(self.languages)))
        self.scripts = {s: used for s, n in self.scripts.items() if (used := n > 0.01 * words).any()}
        seen = set().union(*counts) if counts else set()
        totals = [sum(c.values()) + 0.5 * (len(seen) + 1) for c in counts]
        self.grams = {g: [float(np.log((c[g] + 0.5) / t)) for c, t in zip(counts, totals, strict=True)] for g in seen}
        self.rest = [float(np.log(0.5 / t)) for t in totals]

    def score(self, word: str) -> list[float]:
        grams = trigrams(word)
        table, rest, scale = self.grams, self.rest, len(grams) ** -0.5
        scores = [sum(column) * scale for column in zip(*[table.get(g, rest) for g in grams], strict=True)]
        used = self.scripts.get(script_of(word[0]))
        return scores if used is None else [s if u else -1e6 for s, u in zip(scores, used, strict=True)]


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best state of each word of many texts at once. scores: a row per word; texts in order of falling length."""
    states = scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    back = np.zeros(scores.shape, np.int16)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    own = np.arange(states, dtype=np.int16)
    value = scores[starts[: alive[0]]].copy()
    for step in range(1, lengths[0]):
        live = alive[step]
        value = value[:live]
        at = starts[:live] + step
        best = value.argmax(1)
        jump = np.take_along_axis(value, best[:, None], 1) - switch
        jumped = jump > value
        back[at] = np.where(jumped, best[:, None].astype(np.int16), own)
        value = np.where(jumped, jump, value) + scores[at]
        ending = alive[step + 1] if step + 1 < lengths[0] else 0
        if ending < live:
            labels[at[ending:]] = value[ending:].argmax(1)
    first = lengths == 1
    labels[starts[first]] = scores[starts[first]].argmax(1)
    for step in range(lengths[0] - 1, 0, -1):
        at = starts[: alive[step]] + step
        labels[at - 1] = back[at, labels[at]]
    return labels


class Labeller:
    """A worker's model and its distinct words."""

    def __init__(self, model: Model, switch: float, cache: int = CACHE):
        self.model, self.switch, self.most = model, switch, cache
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        fresh = set(words).difference(self.known)
        if len(self.known) + len(fresh) > self.most and self.known:
            self.forget()
            fresh = set(words)
        if fresh:
            first = len(self.known)
            while first + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for at, word in enumerate(fresh, first):
                self.known[word] = at
                self.rows[at] = self.model.score(word)
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans (language, words, letters) of each text, in order."""
        words = [find_words(t.lower()) for t in texts]
        order = sorted((i for i in range(len(words)) if words[i]), key=lambda i: -len(words[i]))
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not order or not self.model.languages:
            return spans
        flat = [w for i in order for w in words[i]]
        lengths = np.array([len(words[i]) for i in order])
        starts = np.cumsum(lengths) - lengths
        labels = viterbi(self.scores(flat), starts, lengths, self.switch)
        letters = np.cumsum([0, *map(len, flat)])
        cut = np.ones(len(flat), bool)
        cut[1:] = labels[1:] != labels[:-1]
        cut[starts] = True
        firsts = np.flatnonzero(cut)
        ends = np.append(firsts[1:], len(flat))
        owner = np.searchsorted(starts, firsts, "right") - 1
        for text, language, n, size in zip(owner.tolist(), labels[firsts].tolist(), (ends - firsts).tolist(), (letters[ends] - letters[firsts]).tolist(), strict=True):
            spans[order[text]].append((language, n, size))
        return spans


def training_rows(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> list[tuple[str, str]]:
    """(language, text) of at most so many rows a language, those of the smallest hashes of their ids. Ids are chosen
    before texts are read. Hashes are spread evenly, so the smallest are sought among those below MARGIN times the share
    that is wanted: a few thousand rows of a language have to be ordered, however many it has."""
    asked = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.xxhash64(doc_id).alias("mark")).where(F.col("lang").isNotNull() & (fit_fold("doc_id") != 0))
    sized = asked.groupBy("lang").agg(F.count("*").alias("n"), F.min("mark").alias("least"))
    place = F.col("mark") / 2.0**64 + 0.5
    # a row for each language
    low = asked.join(F.broadcast(sized), "lang").where((place <= F.lit(float(MARGIN * most)) / F.col("n")) | (F.col("mark") == F.col("least")))
    line = Window.partitionBy("lang").orderBy("mark", "doc_id")
    chosen = low.withColumn("nth", F.row_number().over(line)).where(F.col("nth") <= most).select("doc_id").distinct()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.left(whole(text), F.lit(FIT_CHARS)).alias("text")).where(F.col("lang").isNotNull())
    # at most `most` ids a language
    return sorted((r["lang"], r["text"]) for r in texts.join(F.broadcast(chosen), "doc_id").select("lang", "text").collect())


def label_spans(docs: DataFrame, model: Model, switch: float = SWITCH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (lang, n_words, n_letters in text order)."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int64()), ("n_letters", pa.int64())]))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(shared.value, switch)
        names = own.model.languages
        for batch in batches:
            for first, end in by_chars(batch, 1, CHUNK):
                part = batch.slice(first, end - first)
                best, share, spans = [], [], []
                for found in own.label(part.column(1).to_pylist()):
                    totals = Counter()
                    for language, _, size in found:
                        totals[language] += size
                    top = min(totals, key=lambda k: (-totals[k], k)) if totals else None
                    best.append(UNKNOWN if top is None else names[top])
                    share.append(0.0 if top is None else totals[top] / sum(totals.values()))
                    spans.append([{"lang": names[a], "n_words": n, "n_letters": s} for a, n, s in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return kept.mapInArrow(labelled, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<lang:string,n_words:bigint,n_letters:bigint>>")


def identify(docs: DataFrame, **names: str) -> DataFrame:
    """Fits on docs and labels them."""
    return label_spans(docs, Model(training_rows(docs, **names)), **{k: v for k, v in names.items() if k != "lang"})


def keep_identified(docs: DataFrame, model: Model, switch: float = SWITCH, text: str = "text") -> DataFrame:
    """Rows of docs, all columns as they are, whose text has a language. Only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Labeller(shared.value, switch)
        for texts in parts:
            found: list[bool] = []
            for first, end in by_chars(pa.RecordBatch.from_arrays([texts], ["text"]), 0, CHUNK):
                found += map(bool, own.label(texts.slice(first, end - first).to_pylist()))
            yield pa.array(found, pa.bool_())

    return docs.where(F.arrow_udf(known, "boolean")(whole(text)))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return identify(documents(spark, sf_dir)).select("doc_id", F.coalesce(fit_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
