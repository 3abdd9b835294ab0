"""Matrix files as a data source: spark.read.format("matrix").load(path).

A file (or all of a folder) is NumPy's .npy, with rows or columns first, or a .mat file of level 5. The header tells the shape and
the kind of numbers; rows are dealt into splits of about ``split_bytes``, and a task reads its rows alone, so a file may be larger
than any task. A compressed variable of a .mat file can only be read from its beginning: it is one split (such files end at 2 GB). Rows
are (file, id from 1 in each file, x). Paths are those of a file system that all tasks see, or URIs that pyarrow opens.

Options: ``variable`` (of .mat files; the first numeric matrix), ``split_bytes``. Writing makes .npy files of at most ``file_rows`` rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPLIT_BYTES = 64 << 20
#: Fixed values of the .mat format: numbers by type code, classes of numeric matrices, codes of compressed data and of matrices.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
NUMERIC = range(6, 16)
COMPRESSED, MATRIX = 15, 14


@dataclass(frozen=True)
class Layout:
    """Where a matrix lies in a file. packed: the bytes from ``offset`` on are compressed, and the matrix begins ``inside`` them."""

    path: str
    rows: int
    columns: int
    kind: str
    offset: int
    columns_first: bool
    packed: int = 0
    inside: int = 0


def opened(path: str):
    system, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))
    return system, name


def files_of(path: str) -> list[str]:
    """path, or the matrix files of the folder it is, in order of name."""
    system, name = opened(path)
    info = system.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    found = sorted(f.base_name for f in system.get_file_info(pafs.FileSelector(name)) if f.base_name.endswith((".npy", ".mat")))
    return [f"{path.rstrip('/')}/{f}" for f in found]


def npy_layout(f, path: str) -> Layout:
    version = np.lib.format.read_magic(f)
    shape, columns_first, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if dtype.hasobject or dtype.kind not in "biuf" or len(shape) > 2:
        raise ValueError(f"{path}: not a matrix of numbers")
    rows, columns = shape if len(shape) == 2 else (shape[0], 1) if shape else (1, 1)
    return Layout(path, rows, columns, dtype.str, f.tell(), columns_first)


def element(head: bytes, order: str) -> tuple[int, int, int]:
    """Type, size in bytes and length of the tag; small elements have their data in the tag."""
    kind, size = struct.unpack(f"{order}II", head[:8])
    return (kind & 0xFFFF, kind >> 16, 4) if kind >> 16 else (kind, size, 8)


def matrix_head(data: bytes, order: str) -> tuple[str, int, tuple[int, ...], str, int] | None:
    """Name, class, shape, kind of numbers and place of the numbers, of the parts of a matrix element."""
    at, parts = 0, []
    for _ in range(3):
        kind, size, tag = element(data[at:], order)
        parts.append(data[at + tag : at + tag + size])
        at += 8 if tag == 4 else tag + -(-size // 8) * 8
    kind, _, tag = element(data[at:], order)
    cls = struct.unpack(f"{order}I", parts[0][:4])[0] & 0xFF
    shape = struct.unpack(f"{order}{len(parts[1]) // 4}i", parts[1])
    return (parts[2].decode("latin-1"), cls, shape, order + KINDS[kind], at + tag) if kind in KINDS else None


def mat_layout(f, path: str, size: int, variable: str | None) -> Layout:
    head = f.read(128)
    order = "<" if head[126:128] == b"IM" else ">"
    if struct.unpack(f"{order}H", head[124:126])[0] != 0x0100:
        raise ValueError(f"{path}: not a .mat file of level 5")
    at = 128
    while at + 8 <= size:
        f.seek(at)
        kind, length, tag = element(f.read(8), order)
        data, packed = f.read(min(length, 4096)), 0
        if kind == COMPRESSED:
            packed, data = length, zlib.decompressobj().decompress(data, 4096)
            kind, _, inner = element(data, order)
            data = data[inner:]
        found = matrix_head(data, order) if kind == MATRIX else None
        if found and found[1] in NUMERIC and len(found[2]) == 2 and variable in (None, found[0]):
            _, _, (rows, columns), numbers, start = found
            return Layout(path, rows, columns, numbers, at + tag + (0 if packed else start), True, packed, inner + start if packed else 0)
        at += tag + (length if packed else -(-length // 8) * 8)
    raise ValueError(f"{path}: no numeric matrix{f' named {variable}' if variable else ''}")


def layout(path: str, variable: str | None) -> Layout:
    system, name = opened(path)
    with system.open_input_file(name) as f:
        return mat_layout(f, path, f.size(), variable) if path.endswith(".mat") else npy_layout(f, path)


def rows_of(m: Layout, first: int, last: int) -> np.ndarray:
    """Rows first to last (without it) of a matrix; only they are read, unless it is compressed."""
    dtype, n = np.dtype(m.kind), last - first
    system, name = opened(m.path)
    with system.open_input_file(name) as f:
        if m.packed:
            f.seek(m.offset)
            data = zlib.decompress(f.read(m.packed))
            return np.frombuffer(data, dtype, m.rows * m.columns, m.inside).reshape(m.columns, m.rows)[:, first:last].T
        if not m.columns_first:
            f.seek(m.offset + first * m.columns * dtype.itemsize)
            return np.frombuffer(f.read(n * m.columns * dtype.itemsize), dtype).reshape(n, m.columns)
        out = np.empty((n, m.columns), dtype)
        for c in range(m.columns):
            f.seek(m.offset + (c * m.rows + first) * dtype.itemsize)
            out[:, c] = np.frombuffer(f.read(n * dtype.itemsize), dtype)
        return out


def column_type(kind: str) -> tuple[str, pa.DataType]:
    dtype = np.dtype(kind)
    if dtype.kind == "f":
        return ("float", pa.float32()) if dtype.itemsize <= 4 else ("double", pa.float64())
    return ("long", pa.int64()) if dtype.itemsize == 8 or dtype.str[1:] == "u4" else ("int", pa.int32())


class Rows(InputPartition):
    def __init__(self, matrix: Layout, first: int, last: int):
        self.matrix, self.first, self.last = matrix, first, last


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, variable: str | None, split_bytes: int):
        self.path, self.variable, self.split_bytes = path, variable, split_bytes

    def partitions(self) -> list[Rows]:
        out = []
        for path in files_of(self.path):
            m = layout(path, self.variable)
            step = m.rows if m.packed else max(1, self.split_bytes // max(1, m.columns * np.dtype(m.kind).itemsize))
            out += [Rows(m, a, min(a + step, m.rows)) for a in range(0, m.rows, max(1, step))]
        return out or [Rows(Layout("", 0, 0, "<f8", 0, False), 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        m = partition.matrix
        kind = column_type(m.kind)[1]
        step = max(1, (4 << 20) // max(1, 8 * m.columns)) if not m.packed else max(1, m.rows)
        for a in range(partition.first, partition.last, step):
            z = min(a + step, partition.last)
            x = rows_of(m, a, z)
            for u in range(0, z - a, 8192):
                part = x[u : u + 8192]
                flat = pa.array(np.ascontiguousarray(part).astype(kind.to_pandas_dtype()).ravel(), kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * m.columns, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([m.path] * len(part)), pa.array(np.arange(a + u + 1, a + u + 1 + len(part))), lists], names=["file", "id", "x"])


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class MatrixWriter(DataSourceArrowWriter):
    """A task's rows (column x, in their order) as .npy files; files of tasks that are given up are removed."""

    def __init__(self, path: str, file_rows: int):
        self.path, self.file_rows = path, file_rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        at, held, files = TaskContext.get(), [], []
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)

        def put() -> None:
            rows = pa.concat_arrays([h for h in held if len(h)])
            name = f"{folder}/part-{at.partitionId():05}-{at.taskAttemptId()}-{len(files):05}.npy"
            with system.open_output_stream(name) as out:
                np.save(out, rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
            files.append(name)
            held.clear()

        for b in iterator:
            x = b.column(b.schema.get_field_index("x"))
            while len(x):
                room = self.file_rows - sum(map(len, held))
                held.append(x.slice(0, room))
                x = x.slice(room)
                if sum(map(len, held)) >= self.file_rows:
                    put()
        if any(len(h) for h in held):
            put()
        return Written(files)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for name in [n for m in messages if m for n in m.files]:
            system.delete_file(name)


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        kinds = sorted({column_type(layout(f, self.options.get("variable")).kind)[0] for f in files_of(self.options["path"])})
        if len(kinds) > 1:
            raise ValueError(f"files of different kinds of numbers: {', '.join(kinds)}")
        return f"file string, id bigint, x array<{kinds[0] if kinds else 'double'}>"

    def reader(self, schema) -> MatrixReader:  # noqa: ARG002
        return MatrixReader(self.options["path"], self.options.get("variable"), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:  # noqa: ARG002
        return MatrixWriter(self.options["path"], int(self.options.get("file_rows", 1 << 16)))


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session; once is enough, more does no harm."""
    spark.dataSource.register(MatrixSource)
    return spark
