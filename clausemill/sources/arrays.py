"""Vectors and matrices in npy and npz files, as a Spark data source.

    spark.dataSource.register(arrays.ArraySource)
    rows = spark.read.format("arrays").option("rowsPerTask", 100_000).load(folder)   # file, member, row, vector
    rows.select("row", "vector").write.format("arrays").mode("append").save(folder)

Reading plans by the headers alone: each file (or uncompressed npz member) is cut into ranges of
rows, and a task reads its range of bytes, so one large matrix is read by many tasks.  A compressed
member can only be read from its start and is one task, which streams it.  Writing makes files of
at most ``rowsPerFile`` rows a task, under names of their own; they get their final names when the
job commits, so an attempt that fails or runs twice leaves nothing.  Paths are those of
``pyarrow.fs``, in a folder that all executors share.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, member string, row long, vector array<double>"
#: Bytes that a task reads at once.
STEP = 8_000_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    """What the header of an array tells: data type, rows, values of a row, bytes before the data."""

    kind: str
    rows: int
    width: int
    start: int


def header(stream, name: str) -> Header:
    """Reads a header; only rows of numbers or booleans, one after the other, can be cut into ranges."""
    version = np.lib.format.read_magic(stream)
    shape, columns_first, dtype = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](stream)
    if dtype.hasobject or dtype.kind not in "biuf":
        raise ValueError(f"{name}: values of type {dtype} are not numbers")
    if len(shape) not in (1, 2) or columns_first and len(shape) == 2 and shape[0] > 1 and shape[1] > 1:
        raise ValueError(f"{name}: only vectors, and matrices stored by rows")
    return Header(dtype.str, shape[0], shape[1] if len(shape) == 2 else 1, stream.tell())


@dataclass
class Range(InputPartition):
    """Rows of one array: bytes at a place in a file, or, with ``start`` negative, a whole compressed member."""

    def __init__(self, file: str, member: str | None, kind: str, width: int, first: int, rows: int, start: int):
        super().__init__(None)
        self.file, self.member, self.kind, self.width, self.first, self.rows, self.start = file, member, kind, width, first, rows, start


class Reader(DataSourceReader):
    def __init__(self, path: str, rows_per_task: int):
        self.path, self.rows_per_task = path, rows_per_task

    def _files(self) -> list[str]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".npy", ".npz")) and not any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/") if f.path != path))

    def partitions(self) -> list[InputPartition]:
        system, _ = opened(self.path)
        out: list[InputPartition] = []
        for file in self._files():
            with system.open_input_file(file) as stream:
                if file.endswith(".npy"):
                    out += self._ranges(file, None, header(stream, file), 0)
                    continue
                with zipfile.ZipFile(stream) as held:
                    for item in held.infolist():
                        with held.open(item) as member:
                            own = header(member, f"{file}/{item.filename}")
                        name = item.filename.removesuffix(".npy")
                        if item.compress_type == zipfile.ZIP_STORED:
                            stream.seek(item.header_offset)
                            at = item.header_offset + 30 + sum(struct.unpack("<HH", stream.read(30)[26:30]))
                            out += self._ranges(file, name, own, at)
                        else:
                            out.append(Range(file, name, own.kind, own.width, 0, own.rows, -own.start))
        return out

    def _ranges(self, file: str, member: str | None, own: Header, at: int) -> list[InputPartition]:
        step = self.rows_per_task
        return [Range(file, member, own.kind, own.width, first, min(step, own.rows - first), at + own.start + first * own.width * np.dtype(own.kind).itemsize) for first in range(0, own.rows, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        size = max(1, partition.width * np.dtype(partition.kind).itemsize)
        with system.open_input_file(partition.file) as stream:
            if partition.start >= 0:
                stream.seek(partition.start)
                yield from self._batches(partition, stream, size)
            else:
                with zipfile.ZipFile(stream) as held, held.open(f"{partition.member}.npy") as member:
                    member.read(-partition.start)
                    yield from self._batches(partition, member, size)

    def _batches(self, own: Range, stream, size: int) -> Iterator[pa.RecordBatch]:
        done = 0
        while done < own.rows:
            n = min(own.rows - done, max(1, STEP // size))
            data = stream.read(n * size)
            if len(data) < n * size:
                raise OSError(f"{own.file}: ends within its data")
            values = np.frombuffer(data, own.kind).astype(np.float64)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * own.width, pa.int32()), pa.array(values))
            rows = pa.array(np.arange(own.first + done, own.first + done + n))
            yield pa.RecordBatch.from_arrays([pa.array([own.file] * n), pa.array([own.member] * n, pa.string()), rows, vectors], ["file", "member", "row", "vector"])
            done += n


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, by their temporary and final names."""

    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Files of the vectors of the column ``vector``, which must be of one length in a file; float64, or float32 by the option ``kind``."""

    def __init__(self, path: str, rows_per_file: int, kind: str, overwrite: bool):
        self.path, self.rows_per_file, self.kind, self.overwrite = path, rows_per_file, kind, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = opened(self.path)
        system.create_dir(f"{path}/_temporary", recursive=True)
        files: list[tuple[str, str]] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            rows = np.concatenate(held)
            name = f"part-{uuid.uuid4().hex}.npy"
            out = io.BytesIO()
            np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(rows.dtype), "fortran_order": False, "shape": rows.shape})
            with system.open_output_stream(f"{path}/_temporary/{name}") as stream:
                stream.write(out.getvalue())
                for i in range(0, len(rows), max(1, STEP // max(1, rows[:1].nbytes))):
                    stream.write(rows[i : i + max(1, STEP // max(1, rows[:1].nbytes))].tobytes())
            files.append((f"{path}/_temporary/{name}", f"{path}/{name}"))
            held.clear()

        for batch in batches:
            column = batch.column("vector")
            if column.null_count or column.flatten().null_count:
                raise ValueError("null vectors and null values have no place in a matrix")
            sizes = np.diff(column.offsets.to_numpy())
            width = int(sizes[0]) if len(sizes) else 0
            if (sizes != width).any() or held and held[0].shape[1] != width:
                raise ValueError("vectors of one matrix must have one length")
            values = column.flatten().to_numpy(zero_copy_only=False).astype(self.kind).reshape(-1, width)
            while len(values):
                room = self.rows_per_file - sum(map(len, held))
                held.append(values[:room])
                values = values[room:]
                if sum(map(len, held)) == self.rows_per_file:
                    flush()
        if held:
            flush()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File and f.path.endswith((".npy", ".npz")):
                    system.delete_file(f.path)
        for message in messages:
            for temporary, final in message.files if message else ():
                system.move(temporary, final)
        system.delete_dir(f"{path}/_temporary")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = opened(self.path)
        if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary")


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rowsPerTask", 100_000)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("rowsPerFile", 100_000)), self.options.get("kind", "float64"), overwrite)
