"""Lines of text files with their file and line number, as a table and as a stream that goes on inside a file.

The table is read by Spark's text source, which splits large files; a line's number is its place in its split plus the
lines of the file's earlier splits, so that only a row a split is summed up in order.

The stream is a data source of its own, since Spark's file streams know whole files only. Its offset is a byte position
for each file; a batch takes the lines whose ends lie between two positions, so a line that is still being written
waits, and none is cut or read twice. The driver lists files and sizes and reads no line. A file is one task of a
batch, which holds one line and one block of bytes at a time. Line numbers go on from a mark, the count of line ends
before a position, which the task of the batch before has written beside the stream's checkpoint; where a mark is lost,
the task counts anew from the file's beginning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "numbered_lines"
#: Bytes that a task reads at once.
BLOCK = 1 << 20


def split_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, starts): value, source_file, __split and __at of each line, and for each split of a file (source_file,
    __split) what its lines' __at must be lessened by to be line numbers. See numbered()."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"))
    splits = lines.groupBy("source_file", "__split").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy("source_file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    before = F.coalesce(F.sum("__n").over(earlier), F.lit(0))
    return lines, splits.select("source_file", "__split", (F.col("__first") - before - 1).alias("__shift"))


def numbered(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows with the number of each line, from 1, in its file. rows: some of split_lines()' lines, with any columns."""
    return rows.join(starts, ["source_file", "__split"]).withColumn("line", F.col("__at") - F.col("__shift")).drop("__split", "__at", "__shift")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, value, line) of all lines, blank ones too."""
    return numbered(*split_lines(spark, path))


@dataclass
class Piece(InputPartition):
    """The lines of a file whose ends lie in [begin, end)."""

    file: str
    begin: int
    end: int


class LineStream(DataSourceStreamReader):
    def __init__(self, path: str, marks: str):
        self.path, self.marks = path, marks
        self.done: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The size of each file. Files whose names begin with a dot or an underscore are left out."""
        files, root = fs.FileSystem.from_uri(self.path)
        if files.get_file_info(root).type == fs.FileType.NotFound:
            return {}
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "._"}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """What each file has got since start. A file that has become shorter was begun anew and is read from 0."""
        known = {file: start.get(file, 0) if start.get(file, 0) <= size else 0 for file, size in end.items()}
        return [Piece(file, known[file], size) for file, size in end.items() if known[file] < size]

    def read(self, piece: Piece) -> Iterator[tuple[str, str, int]]:
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(piece.file) as raw:
            number = self.line_ends(raw, piece)
            held: list[bytes] = [self.open_line(raw, piece.begin)]
            at = piece.begin
            while at < piece.end and (block := raw.read_at(min(BLOCK, piece.end - at), at)):
                at += len(block)
                first, *rest = block.split(b"\n")
                held.append(first)
                for part in rest:
                    number += 1
                    yield piece.file, b"".join(held).removesuffix(b"\r").decode(errors="replace"), number
                    held = [part]
        self.write_mark(piece.file, piece.end, number)

    @staticmethod
    def open_line(raw, begin: int) -> bytes:
        """The bytes before begin of the line that begin lies in."""
        found: list[bytes] = []
        while begin:
            size = min(BLOCK, begin)
            block = raw.read_at(size, begin - size)
            cut = block.rfind(b"\n") + 1
            found.append(block[cut:])
            if cut:
                break
            begin -= size
        return b"".join(reversed(found))

    def line_ends(self, raw, piece: Piece) -> int:
        """How many lines end before the piece."""
        marked = self.read_mark(piece.file, piece.begin)
        if marked is not None:
            return marked
        return sum(raw.read_at(min(BLOCK, piece.begin - at), at).count(b"\n") for at in range(0, piece.begin, BLOCK))

    def mark(self, file: str, at: int) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.marks)
        files.create_dir(root, recursive=True)
        return files, f"{root}/{hashlib.sha256(file.encode()).hexdigest()}-{at}"

    def read_mark(self, file: str, at: int) -> int | None:
        files, name = self.mark(file, at)
        if at == 0 or files.get_file_info(name).type == fs.FileType.NotFound:
            return 0 if at == 0 else None
        with files.open_input_stream(name) as f:
            text = f.read()
        return int(text) if text.endswith(b"\n") else None

    def write_mark(self, file: str, at: int, count: int) -> None:
        """Over an older one; a task that is run twice writes the same. A mark without its line end isn't whole."""
        files, name = self.mark(file, at)
        with files.open_output_stream(name) as f:
            f.write(b"%d\n" % count)

    def commit(self, end: dict) -> None:
        """Marks that no later batch begins at go."""
        for file, at in self.done.items():
            if at and end.get(file) != at:
                files, name = self.mark(file, at)
                if files.get_file_info(name).type == fs.FileType.File:
                    files.delete_file(name)
        self.done = dict(end)


class NumberedLines(DataSource):
    """Options: path, a file or folder that all machines see; marks, a folder for line counts, beside the checkpoint."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source_file string, value string, line bigint"

    def streamReader(self, schema: StructType) -> LineStream:
        return LineStream(self.options["path"], self.options["marks"])


def line_stream(spark: SparkSession, path: str, marks: str) -> DataFrame:
    """(source_file, value, line) of the finished lines of a folder's files, as they grow."""
    spark.dataSource.register(NumberedLines)
    return spark.readStream.format(FORMAT).option("marks", marks).load(path)


def not_blank(value: str = "value") -> Column:
    return F.trim(F.col(value)) != ""
