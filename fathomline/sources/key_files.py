"""A sink of files by key, named by key, coverage start and snapshot date, which take the place of the key's older ones.

Rows are dealt out and sorted by (key, time), so a key's rows lie side by side: a small key is one file, a key of many
rows is split over tasks into one file for each range of its time, named by where that range begins. Tasks write
into a staging folder that readers don't see. Only when all of them are done does the commit move the files to their
names and remove older files of the same keys; other keys' files stay. A write that fails removes its staging folder
and leaves everything as it was. The driver gets one short message for each file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "key_files"


@dataclass
class Written(WriterCommitMessage):
    """(key as in names, first day, staged file) of each file of a task."""

    files: list[tuple[str, str, str]] = field(default_factory=list)


def key_name(key: object) -> str:
    """The key in file names; no two keys share one, and none holds what separates the parts of a name."""
    return "%null" if key is None else quote(str(key), safe="").replace("_", "%5F").replace(".", "%2E")


def day_name(first: object) -> str:
    return "none" if first is None else f"{first:%Y%m%d}"


def runs(column: pa.Array) -> Iterator[tuple[object, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    encoded = pc.run_end_encode(column)
    begin = 0
    for value, end in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist()):
        yield value, begin, end
        begin = end


class KeyFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, time: str, snapshot: str):
        self.path, self.key, self.time, self.snapshot = path, key, time, snapshot
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def place(self) -> tuple[fs.FileSystem, str, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root, f"{root}/{self.staging}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, staging = self.place()
        files.create_dir(staging, recursive=True)
        done = Written()
        writer, at, key, first = None, "", None, None
        try:
            for batch in iterator:
                for value, begin, end in runs(batch.column(self.key)):
                    if writer is None or value != key:
                        if writer is not None:
                            writer.close()
                            done.files.append((key_name(key), day_name(first), at))
                        at, key, first = f"{uuid.uuid4().hex}.parquet", value, None
                        writer = pq.ParquetWriter(f"{staging}/{at}", batch.schema, filesystem=files)
                    part = batch.slice(begin, end - begin)
                    writer.write_batch(part)
                    least = pc.min(part.column(self.time)).as_py()
                    first = least if first is None else first if least is None else min(first, least)
        finally:
            if writer is not None:
                writer.close()
        if writer is not None:
            done.files.append((key_name(key), day_name(first), at))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, root, staging = self.place()
        made = sorted(f for m in messages if m is not None for f in m.files)
        taken: set[str] = set()
        for key, first, at in made:
            name, n = f"{key}_{first}_{self.snapshot}.parquet", 1
            while name in taken:  # ranges of a key that begin on one day
                n += 1
                name = f"{key}_{first}_{self.snapshot}.{n}.parquet"
            taken.add(name)
            if files.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                files.delete_file(f"{root}/{name}")
            files.move(f"{staging}/{at}", f"{root}/{name}")
        keys = {key for key, _, _ in made}
        if made:
            for old in files.get_file_info(fs.FileSelector(root)):
                if old.base_name.endswith(".parquet") and old.base_name.split("_")[0] in keys and old.base_name not in taken:
                    files.delete_file(old.path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, staging = self.place()
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


class KeyFiles(DataSource):
    """Options: path, a folder that all machines see; key and time, columns; snapshot, a day as yyyymmdd."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> KeyFilesWriter:
        return KeyFilesWriter(self.options["path"], self.options["key"], self.options["time"], self.options["snapshot"])


def write_key_files(df: DataFrame, path: str, key: str, time: str, snapshot: date | None = None) -> None:
    """The keys of df replace theirs under path. snapshot: the day in the names, by default today."""
    df.sparkSession.dataSource.register(KeyFiles)
    dealt = df.repartitionByRange(key, time).sortWithinPartitions(key, time)
    dealt.write.format(FORMAT).mode("append").options(key=key, time=time, snapshot=f"{snapshot or date.today():%Y%m%d}").save(path)
