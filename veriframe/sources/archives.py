"""CSV files in ZIP archives as a Spark data source: members are read and written as streams.

    archives.read(spark, folder, ["id", "text"])          # every CSV file of every archive, a task each
    archives.write(df, folder)                            # an archive a task

Archives lie on a store that pyarrow opens by its address (a shared folder, HDFS, object stores). For other
stores that Spark reads there is readers.zipped_csv, which holds a whole archive in one cell."""

from __future__ import annotations

import csv
import io
import json
import sys
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "zipped_csv"
#: Rows and characters of a batch; a row that is longer is a batch of its own.
BATCH_ROWS, BATCH_CHARS = 2000, 1 << 22
#: Characters after which a task begins a new member.
MEMBER_CHARS = 1 << 26
#: Which CSV files of an archive are read.
FIRST, ONLY, ALL = "first", "only", "all"


def csv_members(z: zipfile.ZipFile, which: str) -> list[str]:
    """Names of the CSV files to read, in the archive's order; resource forks are none. FIRST needs one at least, ONLY
    just one; under ALL an archive may have none."""
    names = [n for n in z.namelist() if n.lower().endswith(".csv") and not n.startswith("__MACOSX")]
    if which != ALL and (not names or (which == ONLY and len(names) > 1)):
        raise ValueError(f"expected {'one' if which == ONLY else 'a'} CSV file in the archive, found {names}")
    return names if which == ALL else names[:1]


def archive_paths(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The archive that path names, or those in the folder that it names, by name. Hidden files are left out."""
    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return store, [at]
    files = store.get_file_info(fs.FileSelector(at))
    return store, sorted(f.path for f in files if f.type == fs.FileType.File and f.base_name.lower().endswith(".zip") and f.base_name[0] not in "._")


@dataclass
class Member(InputPartition):
    path: str
    name: str | None


def batches(lines: Iterator[list[str]], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows under a header line by the names of its fields; a field that a row or the file lacks is empty."""
    header = next(lines, [])
    at = [header.index(c) if c in header else len(header) for c in columns]
    rows: list[list[str]] = []
    chars = 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in zip(*rows, strict=True)], names=list(columns))
    for line in lines:
        if not line:  # a blank line
            continue
        row = [line[i] if i < len(line) and i < len(header) else "" for i in at]
        size = sum(map(len, row))
        if rows and (len(rows) == BATCH_ROWS or chars + size > BATCH_CHARS):
            yield pack()
            rows, chars = [], 0
        rows.append(row)
        chars += size
    if rows:
        yield pack()


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: Sequence[str], which: str):
        self.path, self.columns, self.which = path, columns, which

    def partitions(self) -> list[Member]:
        """A task for each archive, or under ALL for each member, for which the archives' directories are read here."""
        store, paths = archive_paths(self.path)
        if self.which != ALL:
            return [Member(p, None) for p in paths]
        out = []
        for p in paths:
            with store.open_input_file(p) as f, zipfile.ZipFile(f) as z:
                out += [Member(p, n) for n in csv_members(z, ALL)]
        return out

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no archives
            return
        csv.field_size_limit(sys.maxsize)
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            name = partition.name or csv_members(z, self.which)[0]
            with z.open(name) as raw:
                yield from batches(csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")), self.columns)


@dataclass
class Written(WriterCommitMessage):
    part: str | None


class Writer(DataSourceArrowWriter):
    """Each task writes an archive under a hidden name of its own; those of the tasks that count get their names
    at the end, so a task that was lost or ran twice leaves no rows behind."""

    def __init__(self, path: str, columns: Sequence[str], member_chars: int):
        self.path, self.columns, self.member_chars = path, columns, member_chars

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        part, n, chars, member = f"{folder}/.{uuid.uuid4().hex}.zip", 0, 0, None
        with store.open_output_stream(part) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in iterator:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if member is None or chars >= self.member_chars:
                        if member is not None:
                            member.close()
                        member, n, chars = io.TextIOWrapper(z.open(f"{n:05}.csv", "w", force_zip64=True), encoding="utf-8", newline=""), n + 1, 0
                        lines = csv.writer(member, quoting=csv.QUOTE_ALL)
                        lines.writerow(self.columns)
                    lines.writerow(["" if v is None else v for v in row])
                    chars += sum(len(v or "") for v in row)
            if member is not None:
                member.close()
        if member is None:
            store.delete_file(part)
        return Written(part if member is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        job = uuid.uuid4().hex
        for i, m in enumerate(m for m in messages if m and m.part):
            store.move(m.part, f"{folder}/{job}-{i:06}.zip")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.part:
                store.delete_file(m.part)


class ZippedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(f"`{c.replace('`', '``')}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], schema.fieldNames(), self.options.get("members", ALL))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("archives are only added")
        return Writer(self.options["path"], schema.fieldNames(), int(self.options.get("member_chars", MEMBER_CHARS)))


def read(spark: SparkSession, path: str, columns: Sequence[str], members: str = ALL) -> DataFrame:
    """Rows of the CSV files in the archive that path names or in all archives of a folder, all columns strings.

    members says which files of an archive: ALL of them, a task each, or the FIRST or ONLY one, a task for each
    archive. A byte order mark is left out; fields may have line ends; a column that a file lacks is empty, one
    that isn't named is not read; a folder without archives and a file of a header alone have no rows; a damaged
    member is an error. A task holds one batch, whatever the size of an archive or member."""
    if members not in (FIRST, ONLY, ALL):
        raise ValueError(f"members is one of {FIRST}, {ONLY}, {ALL}")
    spark.dataSource.register(ZippedCsv)
    return spark.read.format(NAME).option("columns", json.dumps(list(columns))).option("members", members).load(path)


def write(df: DataFrame, path: str, member_chars: int = MEMBER_CHARS) -> None:
    """Adds an archive for each task of df that has rows to a folder. Values are written as strings, nulls as empty ones."""
    df.sparkSession.dataSource.register(ZippedCsv)
    strings = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    strings.write.format(NAME).option("member_chars", str(member_chars)).mode("append").save(path)
