"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is joined by a broadcast at most, counted before; beyond either, by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a temporary one;
    on a cluster that is an error, since other machines couldn't read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fathomline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames, which nothing reads any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def light(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """df, to be broadcast if it was counted to be small."""
    weight = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most_rows is None else most_rows) and size <= BROADCAST_BYTES else df
