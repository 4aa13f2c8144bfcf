"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of 3 to 5 bytes of its lower-cased UTF-8 text between spaces, of
which one-in-2^18 cells record the presence. Each feature is scaled by the log of the ratio of its smoothed rates in
toxic and other training texts; a logistic regression with an L2 penalty is fitted on the scaled features by gradient
steps. The fit uses a bounded sample of labelled rows (SAMPLE of each class, chosen by a hash of the id, and of a long
text its first FIT_CHARS); scoring reads every whole text, very long ones in pieces that overlap.

Null and empty texts are scored by the same features (none but the border's). Labels other than 0 and 1 are left out
of the fit. Without both labels in the training rows every text scores the label's rate (0.5 without any). Repeated
rows are scored alike; an id labelled twice trains once for each label row, one of several documents once for each,
up to twice SAMPLE rows in all. A null id is neither trained on nor held out. Empty tables give an empty result; columns
that aren't asked for may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fit_fold, whole

BITS = 18
SIZES = (3, 4, 5)
#: Labelled rows of each class that the fit may use.
SAMPLE = 1500
#: Characters of a text that the fit may use, which bounds what the driver gets.
FIT_CHARS = 200_000
#: Texts are hashed in pieces of so many bytes, which overlap by the longest n-gram.
PIECE = 4_000_000


def grams(text: str) -> np.ndarray:
    """Sorted distinct feature cells of a text."""
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint64)
    seen = np.zeros(1 << BITS, bool)
    for first in range(0, max(1, len(raw) - max(SIZES)), PIECE):
        part = raw[first : first + PIECE + max(SIZES)]
        rolled = part.copy()
        for size in range(2, max(SIZES) + 1):
            if len(part) < size:
                break
            rolled = rolled[: len(part) - size + 1] * np.uint64(0x100000001B3) + part[size - 1 :]
            if size in SIZES:
                mixed = rolled * np.uint64(0x9E3779B97F4A7C15)
                seen[(mixed >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


def fit(texts: list[str], labels: list[int], steps: int = 120, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weight of each cell, intercept)."""
    y = np.array(labels, float)
    rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    weights = np.zeros(1 << BITS)
    if not 0 < y.sum() < len(y):
        return weights, float(np.log(rate / (1 - rate)))
    cells = [grams(t) for t in texts]
    rows = np.repeat(np.arange(len(cells), dtype=np.int32), [len(c) for c in cells])
    flat = np.concatenate(cells)
    del cells
    toxic = np.bincount(flat, y[rows], 1 << BITS) + 1
    other = np.bincount(flat, 1 - y[rows], 1 << BITS) + 1
    ratio = np.log(toxic / (y.sum() + 2)) - np.log(other / ((1 - y).sum() + 2))
    used, at = np.unique(flat, return_inverse=True)
    at = at.astype(np.int32)
    del flat
    scaled = ratio[used].astype(np.float32)[at]
    norm = np.sqrt(np.maximum(np.bincount(rows, scaled**2, len(y)), 1e-9)).mean()
    scaled /= np.float32(norm)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, bias = np.zeros(len(used)), 0.0
    speed_w, speed_b = np.zeros(len(used)), 0.0
    for _ in range(steps):
        margin = np.bincount(rows, scaled * w[at], len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * balance / len(y)
        slope = np.bincount(at, scaled * error[rows], len(used)) + penalty * w
        speed_w = 0.9 * speed_w - 4.0 * slope
        speed_b = 0.9 * speed_b - 0.5 * error.sum()
        w, bias = w + speed_w, bias + speed_b
    weights[used] = w * ratio[used] / norm
    return weights, float(bias)


def chosen_ids(labels: DataFrame, label: str, doc_id: str, most: int) -> DataFrame:
    """(doc_id, label): the ids of the smallest hashes of each class. Each partition keeps its own smallest."""
    asked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(fit_fold("doc_id") != 0)
    first = [asked.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for kind in (0, 1)]
    return first[0].unionByName(first[1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> list[tuple[str, int]]:
    """At most so many labelled texts of each class, outside the held-out fold. Ids are chosen before texts are read."""
    chosen = chosen_ids(labels, label, doc_id, most)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.left(whole(text), F.lit(FIT_CHARS)).alias("text"))
    # at most twice `most` ids; the limit is for ids with several rows
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    met = joined.orderBy(F.xxhash64("doc_id", "text", "label"), "doc_id", "label", "text").limit(2 * most).collect()
    return [(r["text"], r["label"]) for r in sorted(met, key=lambda r: (r["doc_id"], r["label"], r["text"]))]


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, score."""
    rows = training_rows(docs, labels, label, doc_id, text, sample)
    model = docs.sparkSession.sparkContext.broadcast(fit([t for t, _ in rows], [y for _, y in rows]))
    kept = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            margins = np.fromiter((weights[grams(x.as_py())].sum() for x in batch.column(1)), float, len(batch)) + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -60, 60))))], ["doc_id", "score"])

    return kept.mapInArrow(scored, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", F.coalesce(fit_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
