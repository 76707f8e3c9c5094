"""Arrow IPC files (Feather version 2) as a Spark data source.

A file ends in a footer that lists its record batches, so a reader may start at any of them: a
partition is a file and a range of its batches, of about ``PARTITION_BYTES``. The column choice is
part of the source's schema, so only those columns are decoded and handed to Spark. A writer puts
one file per task into a staging folder; they appear in the table when the job commits, and an
attempt that was lost or failed leaves nothing there.

Files are opened by workers through Arrow's own file systems: local paths, and the stores it knows
by their scheme.
"""

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

FORMAT, SUFFIXES = "arrow_file", (".arrow", ".feather", ".ipc")
PARTITION_BYTES = 64 << 20
# Footers read at a time while a scan is planned.
FOOTER_THREADS = 32
# Arrow types that Spark lacks, and what they are read as.
WIDER = {
    pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32(),
    pa.date64(): pa.date32(), pa.null(): pa.string(),
}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_in(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The Arrow files of a folder and the folders below, by name; or the one file. What begins with _ or . is passed over."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return fs, [info]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    below = len(at.rstrip("/")) + 1
    hidden = lambda f: any(part[:1] in "_." for part in f.path[below:].split("/"))
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith(SUFFIXES) and not hidden(f)), key=lambda f: f.path)


def readable(kind: pa.DataType) -> pa.DataType:
    """The type that Spark reads an Arrow type as, where it has to be another."""
    if pa.types.is_dictionary(kind):
        return readable(kind.value_type)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(readable(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, readable(f.type), f.nullable) for f in kind])
    return WIDER.get(kind, kind)


def spark_schema(schema: pa.Schema, columns: Sequence[str] | None = None) -> StructType:
    names = schema.names if columns is None else list(columns)
    if missing := [c for c in names if c not in schema.names]:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(schema.names)}")
    return from_arrow_schema(pa.schema([pa.field(c, readable(schema.field(c).type)) for c in names]))


@dataclass
class BatchRange(InputPartition):
    """Record batches first..last (exclusive) of a file."""

    path: str
    first: int
    last: int


class ArrowFileReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.schema, self.partition_bytes = path, schema, partition_bytes

    def partitions(self) -> list[BatchRange]:
        fs, files = files_in(self.path)

        def ranges(info: pafs.FileInfo) -> list[BatchRange]:
            with fs.open_input_file(info.path) as f:
                n = ipc.open_file(f).num_record_batches
            each = max(1, round(n * self.partition_bytes / max(1, info.size)))
            return [BatchRange(info.path, a, min(a + each, n)) for a in range(0, n, each)]

        with ThreadPoolExecutor(FOOTER_THREADS) as pool:
            return [r for some in pool.map(ranges, files) for r in some] or [BatchRange("", 0, 0)]

    def read(self, partition: BatchRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        want = to_arrow_schema(self.schema)
        with opened(self.path)[0].open_input_file(partition.path) as f:
            names = ipc.open_file(f).schema.names
            known = [c for c in want.names if c in names]
            file = ipc.open_file(f, options=ipc.IpcReadOptions(included_fields=sorted(names.index(c) for c in known)))
            for i in range(partition.first, partition.last):
                batch = file.get_batch(i)
                columns = [_as(batch.column(c), want.field(c).type) if c in known else pa.nulls(batch.num_rows, want.field(c).type) for c in want.names]
                yield pa.RecordBatch.from_arrays(columns, schema=want) if columns else batch.select([])


def _as(column: pa.Array, kind: pa.DataType) -> pa.Array:
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    return column if column.type == kind else column.cast(kind, safe=False)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class ArrowFileWriter(DataSourceArrowWriter):
    """Files are staged by tasks and moved into the table by the commit."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, compression: str | None):
        self.path, self.schema, self.overwrite, self.compression = path, schema, overwrite, compression
        self.job = uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return posixpath.join(opened(self.path)[1], f"_staging-{self.job}")

    def _write(self, name: str, batches: Iterator[pa.RecordBatch]) -> int:
        fs, _ = opened(self.path)
        fs.create_dir(self.staging, recursive=True)
        rows, schema = 0, to_arrow_schema(self.schema)
        options = ipc.IpcWriteOptions(compression=self.compression)
        with fs.open_output_stream(posixpath.join(self.staging, name)) as f, ipc.new_file(f, schema, options=options) as out:
            for batch in batches:
                out.write_batch(batch.cast(schema))
                rows += batch.num_rows
        return rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filled = (b for b in iterator if b.num_rows)
        first = next(filled, None)
        if first is None:
            return Written(None, 0)
        # Every attempt has a name of its own, so two of the same task do not meet.
        name = f"part-{uuid.uuid4().hex}.arrow"

        def batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from filled

        return Written(name, self._write(name, batches()))

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        if not names:
            # An empty table still has its schema.
            names = [f"part-{self.job}.arrow"]
            self._write(names[0], iter(()))
        old = files_in(self.path)[1] if self.overwrite else []
        for name in names:
            fs.move(posixpath.join(self.staging, name), posixpath.join(at, name))
        for info in old:
            fs.delete_file(info.path)
        fs.delete_dir(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        if fs.get_file_info(self.staging).type == pafs.FileType.Directory:
            fs.delete_dir(self.staging)


class ArrowFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        fs, files = files_in(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Arrow file in {self.options['path']}")
        with fs.open_input_file(files[0].path) as f:
            columns = self.options.get("columns")
            return spark_schema(ipc.open_file(f).schema, json.loads(columns) if columns else None)

    def reader(self, schema: StructType) -> ArrowFileReader:
        return ArrowFileReader(self.options["path"], schema, int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArrowFileWriter:
        compression = self.options.get("compression", "lz4")
        return ArrowFileWriter(self.options["path"], schema, overwrite, None if compression == "none" else compression)


def read_arrow(spark: SparkSession, path: str, columns: Sequence[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """An Arrow or Feather file, or a folder of them, of which only ``columns`` are read.

    The schema is that of the first file by name; a column that another file lacks reads as NULL
    there. Dictionaries are read as their values, unsigned numbers as the next wider type.
    """
    spark.dataSource.register(ArrowFileSource)
    reader = spark.read.format(FORMAT).option("partitionBytes", str(partition_bytes))
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    return reader.load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "error", compression: str = "lz4") -> str:
    """Write Arrow files, every task its own. ``mode`` is error, append or overwrite; compression lz4, zstd or none."""
    df.sparkSession.dataSource.register(ArrowFileSource)
    fs, at = opened(path)
    exists = fs.get_file_info(at).type != pafs.FileType.NotFound
    if mode == "error" and exists and files_in(path)[1]:
        raise FileExistsError(path)
    fs.create_dir(at, recursive=True)
    df.write.format(FORMAT).option("compression", compression).mode("overwrite" if mode == "overwrite" else "append").save(path)
    return path
