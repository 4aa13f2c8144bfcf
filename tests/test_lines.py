"""Line numbers of split files, and streams that stop and go on inside a file."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathomline.sources import lines as ln
from fathomline.sources import tables as src

GOOD = '{"event_id": "%d", "event_ts": "2024-01-01T00:00:00", "event_type": "x"}'


def numbers_of(frame):
    return sorted((r["source_file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in frame.collect())


def test_numbers_of_lines_in_split_files(spark, tmp_path):
    rng = random.Random(5)
    want = []
    for name in ("a", "b", "none"):
        texts = ["" if rng.random() < 0.1 else f"{name}{i} " + "é" * rng.randint(0, 60) for i in range(0 if name == "none" else 900)]
        (tmp_path / name).write_text("".join(t + "\n" for t in texts))
        want += [(name, i + 1, t) for i, t in enumerate(texts)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines, starts = ln.split_lines(spark, str(tmp_path))
        assert starts.count() > 10
        assert numbers_of(ln.numbered(lines, starts)) == sorted(want)
        some = lines.where(F.length("value") % 7 == 0)
        assert numbers_of(ln.numbered(some, starts)) == sorted(w for w in want if len(w[2]) % 7 == 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dead_letters_name_file_and_line_and_stay_whole(spark, tmp_path):
    long = "[" + "9" * 100_000
    (tmp_path / "a.jsonl").write_text("\n".join([GOOD % 1, "", '{"event_id": "2"}', long]))
    (tmp_path / "b.jsonl").write_text("\r\n".join(["{bad", GOOD % 3]))
    good, dead = src.read_events(spark, str(tmp_path))
    assert sorted(r["event_id"] for r in good.collect()) == ["1", "3"]
    got = sorted((r["source_file"].rsplit("/", 1)[1], r["line"], r["raw_line"], r["error"]) for r in dead.collect())
    assert got == [("a.jsonl", 3, '{"event_id": "2"}', "missing event_ts, event_type"), ("a.jsonl", 4, long, "not a JSON object"), ("b.jsonl", 1, "{bad", "not a JSON object")]


@pytest.mark.parametrize("lost", [False, True])
def test_stream_goes_on_inside_a_file(spark, tmp_path, monkeypatch, lost):
    logs, marks, out = tmp_path / "logs", tmp_path / "marks", str(tmp_path / "out")
    logs.mkdir()

    def run():
        rows = ln.line_stream(spark, str(logs), str(marks))
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return numbers_of(spark.read.schema("source_file string, value string, line bigint").parquet(out))

    (logs / "a.jsonl").write_bytes(b"one\ntwo\nthr")
    (logs / "_tmp").write_bytes(b"hidden\n")
    assert run() == [("a.jsonl", 1, "one"), ("a.jsonl", 2, "two")]
    with (logs / "a.jsonl").open("ab") as f:
        f.write("ee\r\n\né".encode()[:-1])  # half a letter
    (logs / "b.jsonl").write_bytes(b"x" * 3_000_000)
    if lost:
        for mark in marks.iterdir():
            mark.unlink()
    second = [("a.jsonl", 1, "one"), ("a.jsonl", 2, "two"), ("a.jsonl", 3, "three"), ("a.jsonl", 4, "")]
    assert run() == second
    with (logs / "a.jsonl").open("ab") as f:
        f.write("é".encode()[-1:] + b"\n")
    with (logs / "b.jsonl").open("ab") as f:
        f.write(b"y\nz\n")
    third = [*second, ("a.jsonl", 5, "é"), ("b.jsonl", 1, "x" * 3_000_000 + "y"), ("b.jsonl", 2, "z")]
    assert run() == third
    assert run() == third
    (logs / "a.jsonl").write_bytes(b"new\n")  # begun anew
    assert run() == sorted([*third, ("a.jsonl", 1, "new")])


def test_pieces_cover_a_file_once(tmp_path, monkeypatch):
    monkeypatch.setattr(ln, "BLOCK", 7)
    rng = random.Random(8)
    texts = ["w" * rng.randint(0, 30) for _ in range(200)]
    (tmp_path / "f").write_text("".join(t + "\n" for t in texts) + "open")
    size = (tmp_path / "f").stat().st_size
    stream = ln.LineStream(str(tmp_path / "f"), str(tmp_path / "marks"))
    cuts = sorted({0, size, *(rng.randrange(size) for _ in range(60))})
    got = [(n, t) for a, b in zip(cuts, cuts[1:]) for _, t, n in stream.read(ln.Piece(str(tmp_path / "f"), a, b))]
    assert got == list(enumerate(texts, 1))
    stream.commit({str(tmp_path / "f"): cuts[1]})
    stream.commit({str(tmp_path / "f"): cuts[2]})
    assert len(list((tmp_path / "marks").iterdir())) == len(cuts) - 2
