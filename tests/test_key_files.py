"""Files by key: names, replacement of older ones, failures that change nothing, keys larger than a task."""

from __future__ import annotations

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fathomline.sources.key_files import key_name, write_key_files

SCHEMA = "symbol string, day date, v long"
FIRST = date(2024, 1, 1)


def names(path) -> list[str]:
    return sorted(p.name for p in Path(path).iterdir())


def rows_of(spark, path):
    return sorted(((r["symbol"] or "", r["day"], r["v"]) for r in spark.read.schema(SCHEMA).parquet(str(path)).collect()), key=str)


def test_names_replacement_and_failure(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(s, FIRST + timedelta(i + j), i) for j, s in enumerate(["A", "A_B", "é/x.y", None]) for i in range(5)]
    write_key_files(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(path), "symbol", "day", date(2024, 2, 1))
    assert rows_of(spark, path) == sorted(((s or "", d, v) for s, d, v in rows), key=str)
    stems = {n.split("_")[0] for n in names(path)}
    assert stems == {"A", "A%5FB", "%C3%A9%2Fx%2Ey", "%null"} == {key_name(s) for s in ("A", "A_B", "é/x.y", None)}
    assert "A_20240101_20240201.parquet" in names(path) and all(n.endswith("_20240201.parquet") for n in names(path))
    # the files of A go, those of A_B stay
    new = [("A", FIRST - timedelta(1), 7)]
    write_key_files(spark.createDataFrame(new, SCHEMA), str(path), "symbol", "day", date(2024, 2, 2))
    want = sorted(((s or "", d, v) for s, d, v in [*new, *(r for r in rows if r[0] != "A")]), key=str)
    assert rows_of(spark, path) == want and [n for n in names(path) if n.startswith("A_")] == ["A_20231231_20240202.parquet"]
    # on the same day over the same name
    write_key_files(spark.createDataFrame([("A", FIRST - timedelta(1), 8)], SCHEMA), str(path), "symbol", "day", date(2024, 2, 2))
    assert ("A", FIRST - timedelta(1), 8) in rows_of(spark, path) and len(rows_of(spark, path)) == len(want)
    # a write that fails on its way changes nothing
    before = names(path), rows_of(spark, path)
    bad = spark.createDataFrame([("A_B", FIRST + timedelta(i), i) for i in range(400)], SCHEMA).withColumn("v", F.when(F.col("v") == 399, F.raise_error("halfway").cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="halfway"):
        write_key_files(bad, str(path), "symbol", "day")
    assert (names(path), rows_of(spark, path)) == before
    write_key_files(spark.createDataFrame([], SCHEMA), str(path), "symbol", "day")
    assert (names(path), rows_of(spark, path)) == before


def test_a_large_key_is_split_by_time(spark, tmp_path):
    many = spark.range(40_000).select(F.lit("HOT").alias("symbol"), F.date_add(F.lit(FIRST), (F.col("id") / 10).cast("int")).alias("day"), F.col("id").alias("v"))
    all_rows = many.unionByName(spark.createDataFrame([(f"S{i}", FIRST, i) for i in range(20)], SCHEMA)).repartition(8)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        write_key_files(all_rows, str(tmp_path / "h"), "symbol", "day", date(2024, 2, 1))
    finally:
        spark.conf.set(setting, before)
    hot = [n for n in names(tmp_path / "h") if n.startswith("HOT_")]
    read = spark.read.parquet(str(tmp_path / "h"))
    assert len(hot) > 1 and len(set(hot)) == len(hot) and read.count() == 40_020 == read.distinct().count()
    # each file begins where its name says
    for name in hot:
        start = spark.read.parquet(str(tmp_path / "h" / name)).agg(F.min("day")).first()[0]
        assert name.split("_")[1] == f"{start:%Y%m%d}"
