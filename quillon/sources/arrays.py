"""Array files (.npy, .npz) as a data source that reads them in ranges of rows and writes one file a task.

``spark.read.format("arrays").load(path)`` gives file, member, row and vec of the two-dimensional arrays in the files below ``path`` (one-dimensional ones count
as a column). A partition reads its rows by their place in the file, so a file of any size is shared by many tasks. Members of an .npz
are split likewise if they are stored as they are; a compressed one is one partition, read as a stream.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of an array that one partition reads, if the option ``bytes`` says nothing else; rows of a batch.
PART_BYTES = 32 << 20
BATCH_ROWS = 4_096

SCHEMA = "file string, member string, row long, vec array<double>"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


@dataclass
class Header:
    """Of an array: where its numbers begin, their kind, rows and columns, and whether columns lie together."""

    start: int
    dtype: str
    rows: int
    columns: int
    by_column: bool

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * self.columns


def header(f) -> Header:
    """Reads the beginning of an .npy stream."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(f)
    if dtype.hasobject or dtype.kind not in "fiub" or not 1 <= len(shape) <= 2:
        raise ValueError(f"no array of numbers in rows: {dtype} of shape {shape}")
    return Header(f.tell(), dtype.str, shape[0], shape[1] if len(shape) == 2 else 1, by_column and len(shape) == 2)


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``stop`` of an array; ``packed`` members are decompressed from their beginning."""

    file: str
    member: str
    head: Header
    first: int
    stop: int
    packed: bool = False


def _arrays(store: pafs.FileSystem, path: str) -> Iterator[tuple[str, Header, bool]]:
    """member, header (start within the file, or within a packed member), packed."""
    with store.open_input_file(path) as f:
        if not path.endswith(".npz"):
            yield "", header(f), False
            return
        with zipfile.ZipFile(f) as z:
            for info in z.infolist():
                with z.open(info) as m:
                    h = header(m)
                if packed := info.compress_type != zipfile.ZIP_STORED:
                    yield info.filename.removesuffix(".npy"), h, packed
                    continue
                f.seek(info.header_offset + 26)  # the name and the extra field stand before the member's bytes
                name, extra = struct.unpack("<HH", f.read(4))
                h.start += info.header_offset + 30 + name + extra
                yield info.filename.removesuffix(".npy"), h, packed


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bytes = options["path"], int(options.get("bytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, path = filesystem(self.path)
        found = store.get_file_info(path)
        if found.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [path] if found.is_file else sorted(x.path for x in store.get_file_info(pafs.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith((".npy", ".npz")) and not x.base_name.startswith(("_", ".")))
        out: list[InputPartition] = []
        for file in files:
            for member, h, packed in _arrays(store, file):
                step = h.rows if packed else max(1, self.bytes // max(1, h.row_bytes))
                out += [Rows(file, member, h, a, min(h.rows, a + step), packed) for a in range(0, h.rows, max(1, step))]
        return out or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Rows):
            return
        store, _ = filesystem(self.path)
        with store.open_input_file(part.file) as f:
            if part.packed:
                with zipfile.ZipFile(f) as z, z.open(part.member + ".npy") as m:
                    header(m)
                    if part.head.by_column:  # its first row ends with the file
                        x = np.frombuffer(m.read(), part.head.dtype).reshape(part.head.columns, -1).T
                        yield from (self._batch(part, a, x[a : a + BATCH_ROWS]) for a in range(0, len(x), BATCH_ROWS))
                        return
                    for a in range(part.first, part.stop, BATCH_ROWS):
                        n = min(BATCH_ROWS, part.stop - a)
                        yield self._batch(part, a, np.frombuffer(m.read(n * part.head.row_bytes), part.head.dtype).reshape(n, -1))
                return
            for a in range(part.first, part.stop, BATCH_ROWS):
                yield self._batch(part, a, self._rows(f, part.head, a, min(BATCH_ROWS, part.stop - a)))

    @staticmethod
    def _rows(f: pa.NativeFile, h: Header, first: int, n: int) -> np.ndarray:
        if not h.by_column:
            return np.frombuffer(f.read_at(n * h.row_bytes, h.start + first * h.row_bytes), h.dtype).reshape(n, -1)
        size = np.dtype(h.dtype).itemsize
        return np.stack([np.frombuffer(f.read_at(n * size, h.start + (c * h.rows + first) * size), h.dtype) for c in range(h.columns)], 1)

    @staticmethod
    def _batch(part: Rows, first: int, x: np.ndarray) -> pa.RecordBatch:
        n = len(x)
        vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel()))
        return pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array([part.member] * n), pa.array(np.arange(first, first + n)), vec], ["file", "member", "row", "vec"])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, under temporary and final names."""

    moves: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Each task writes its rows' ``vec`` as one .npy file; all get their final names when the last task is done, none if one fails.

    A task writes to a file of its own, whose header leaves room for the number of rows, so it never holds them.
    """

    ROOM = 128

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = filesystem(self.path)
        name = uuid.uuid4().hex
        temp = posixpath.join(path, f"_{self.job}", name)
        store.create_dir(posixpath.dirname(temp), recursive=True)
        rows, columns = 0, None
        with store.open_output_stream(temp + ".body") as out:
            for b in batches:
                vec = b.column(b.schema.names.index("vec")).cast(pa.list_(pa.float64()))
                sizes = pa.compute.list_value_length(vec).unique().to_pylist()
                if vec.null_count or len(sizes) > 1 or columns is not None and sizes and sizes != [columns] or vec.flatten().null_count:
                    raise ValueError("vectors of one size without nulls are asked for")
                if sizes:
                    columns = sizes[0]
                    out.write(vec.flatten().to_numpy(zero_copy_only=False).tobytes())
                    rows += len(vec)
        if not rows:
            store.delete_file(temp + ".body")
            return Written([])
        with store.open_output_stream(temp + ".npy") as out, store.open_input_file(temp + ".body") as body:
            np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (rows, columns)})
            while chunk := body.read(8 << 20):
                out.write(chunk)
        store.delete_file(temp + ".body")
        return Written([(temp + ".npy", posixpath.join(path, name + ".npy"))])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        finish(self.path, self.job, [m for x in messages if x for m in x.moves])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        finish(self.path, self.job, [])


def finish(path: str, job: str, moves: list[tuple[str, str]]) -> None:
    """Renames files into place, each at once over what had its name, and removes the job's folder."""
    store, root = filesystem(path)
    for a, b in moves:
        store.move(a, b)
    folder = posixpath.join(root, f"_{job}")
    if store.get_file_info(folder).type != pafs.FileType.NotFound:
        store.delete_dir(folder)


class Arrays(DataSource):
    """The data source ``arrays``; options: path, and bytes that a partition reads."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def read_arrays(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """file, member, row, vec of all .npy and .npz files at or below ``path``, in partitions of about so many bytes."""
    spark.dataSource.register(Arrays)
    return spark.read.format("arrays").option("bytes", part_bytes).load(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """The column ``vec`` of ``df`` as .npy files below ``path``, one for each task that has rows."""
    df.sparkSession.dataSource.register(Arrays)
    df.select("vec").write.format("arrays").mode("append").save(path)
