"""Files of Arrow record batches (feather version 2) as a data source of Spark's: ``spark.read.format("record_batches")``.

The driver reads schemas and footers only. A task reads the record batches dealt to it, and of those the wanted columns,
so neither the driver nor a task holds a file. Tasks write files of their own, which are moved to their place together
when all are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

FORMAT, SUFFIXES = "record_batches", (".feather", ".arrow", ".ipc")

#: Bytes of a file that a task reads, as far as batches allow: batches of one file count as equally large.
TASK_BYTES = 64 << 20


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it. A path without a scheme is local."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """A file itself, or all files of a folder that end as such files do, in order of name. Hidden ones and those that a stopped write left behind are none."""
    fs, at = _place(path)
    found = fs.get_file_info(at)
    if found.type == pyarrow.fs.FileType.File:
        return [at]
    if found.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted(i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(at)) if i.is_file and i.base_name.endswith(SUFFIXES) and not i.base_name.startswith(("_", ".")))


def _plain(t: pa.DataType) -> pa.DataType:
    """The type a column is read as: dictionaries are their values, times are of microseconds."""
    if pa.types.is_dictionary(t):
        return _plain(t.value_type)
    if pa.types.is_timestamp(t):
        return pa.timestamp("us", t.tz)
    if pa.types.is_large_string(t) or pa.types.is_large_binary(t):
        return pa.string() if pa.types.is_large_string(t) else pa.binary()
    return t


def _as(column: pa.Array, t: pa.DataType, zone: str) -> pa.Array:
    """A column as type ``t``; times without a zone are of the session's zone, and fractions of a microsecond are cut off."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if pa.types.is_timestamp(t):
        column = pc.cast(column, pa.timestamp("us", column.type.tz), safe=False)
        return column if column.type.tz else pc.assume_timezone(column, zone, ambiguous="earliest", nonexistent="latest")
    return column if column.type == t else column.cast(t)


@dataclass
class Part(InputPartition):
    path: str
    first: int
    after: int


class RecordBatches(DataSource):
    """Options: ``path``, a file or folder; ``columns``, comma-joined names to read; ``zone``, of times without one; ``task_bytes``.

    All files have the columns and types of the first by name; one that lacks a column is an error, further columns are left
    out. Files of version 1 have no record batches and are refused. A folder without files needs a schema.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _fields(self) -> pa.Schema:
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no record batches in {self.options['path']}")
        fs, _ = _place(self.options["path"])
        with fs.open_input_file(files[0]) as f:
            fields = pa.ipc.open_file(f).schema
        names = self.options["columns"].split(",") if self.options.get("columns") else fields.names
        return pa.schema([pa.field(n, _plain(fields.field(n).type)) for n in names])

    def schema(self) -> StructType:
        return from_arrow_schema(self._fields())

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"], self._fields(), self.options.get("zone", "UTC"), int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BatchWriter(self.options["path"], overwrite)


class BatchReader(DataSourceReader):
    def __init__(self, path: str, fields: pa.Schema, zone: str, task_bytes: int):
        self.path, self.fields, self.zone, self.task_bytes = path, fields, zone, task_bytes

    def partitions(self) -> Sequence[InputPartition]:
        fs, _ = _place(self.path)
        out = []
        for file in _files(self.path):
            with fs.open_input_file(file) as f:
                n, size = pa.ipc.open_file(f).num_record_batches, f.size()
            step = max(1, self.task_bytes * n // max(1, size))
            out += [Part(file, i, min(n, i + step)) for i in range(0, n, step)]
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.first == part.after:
            return
        fs, _ = _place(self.path)
        with fs.open_input_file(part.path) as f:
            # Fields left out are not read from the file, so their places must be known first.
            there = pa.ipc.open_file(f).schema.names
            missing = [c for c in self.fields.names if c not in there]
            if missing:
                raise ValueError(f"{part.path} has no {missing}")
            wanted = pa.ipc.IpcReadOptions(included_fields=sorted(there.index(c) for c in self.fields.names))
            opened = pa.ipc.open_file(f, options=wanted)
            for i in range(part.first, part.after):
                batch = opened.get_batch(i)
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([_as(batch.column(c), self.fields.field(c).type, self.zone) for c in self.fields.names], names=self.fields.names)


@dataclass
class Done(WriterCommitMessage):
    file: str | None
    rows: int


class BatchWriter(DataSourceArrowWriter):
    """Every attempt of a task writes a file of its own under a hidden folder; those of the attempts that count are moved to the folder in the end, others go."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def _staging(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        fs, at = _place(self.path)
        return fs, at.rstrip("/"), f"{at.rstrip('/')}/_staging-{self.run}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _, staging = self._staging()
        fs.create_dir(staging, recursive=True)
        name, rows, sink, out = f"part-{uuid.uuid4().hex}.arrow", 0, None, None
        try:
            for b in batches:
                if out is None:
                    sink = fs.open_output_stream(f"{staging}/{name}")
                    out = pa.ipc.new_file(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(b)
                rows += b.num_rows
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Done(name if out is not None else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder, staging = self._staging()
        before = _files(self.path) if self.overwrite and fs.get_file_info(folder).type == pyarrow.fs.FileType.Directory else []
        for m in messages:
            if m is not None and m.file:
                fs.move(f"{staging}/{m.file}", f"{folder}/{m.file}")
        for old in before:
            fs.delete_file(old)
        self._clear(fs, staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _, staging = self._staging()
        self._clear(fs, staging)

    @staticmethod
    def _clear(fs: pyarrow.fs.FileSystem, staging: str) -> None:
        if fs.get_file_info(staging).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(staging)


def read_batches(spark: SparkSession, path: str, columns: Sequence[str] = (), task_bytes: int = TASK_BYTES) -> DataFrame:
    """Record batches of a file or folder as a table; ``columns`` are all that is read of them."""
    spark.dataSource.register(RecordBatches)
    reader = spark.read.format(FORMAT).option("zone", spark.conf.get("spark.sql.session.timeZone")).option("task_bytes", task_bytes)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def write_batches(df: DataFrame, path: str, mode: str = "append") -> None:
    """A table as a folder of files of record batches, one for each task that has rows. ``overwrite`` replaces the files there."""
    df.sparkSession.dataSource.register(RecordBatches)
    df.write.format(FORMAT).mode(mode).save(path)
