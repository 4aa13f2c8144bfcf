"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_dir, stored  # noqa: F401  operators take them from here


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


#: Bytes of rows that Python workers get at once.
BATCH_BYTES = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, where it allows more: whole texts and sets are long rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(key, None)
    if not (known and known.isdigit() and 0 < int(known) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def fit_fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def by_chars(batch: pa.RecordBatch, text_at: int, most: int) -> list[tuple[int, int]]:
    """Row ranges of a batch, each of about most bytes of text or of one row."""
    lengths = pa.compute.binary_length(batch.column(text_at)).fill_null(0).to_pylist()
    cuts, begun, held = [], 0, 0
    for at, size in enumerate(lengths):
        if held and held + size > most:
            cuts.append((begun, at))
            begun, held = at, 0
        held += size
    if begun < len(lengths):
        cuts.append((begun, len(lengths)))
    return cuts


Query = Callable[[SparkSession, str], DataFrame]
