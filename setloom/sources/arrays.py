"""Dense and sparse arrays from NumPy archives and tensor files, read in ranges of rows by many tasks.

Both kinds of file are zip archives whose large members are stored as they are, so a row lies at a place that the small
members tell: the header of an array (shape, order, element type), or the description of a tensor (offset, size, strides).
``spark.read.format("array_rows")`` reads these few bytes when a scan is planned and gives each task a range of rows, of
which it reads nothing but the bytes that the rows take: one span where a row's elements lie close together, a span for each
column where they don't (a transposed tensor). Archives that are compressed are one range, read whole by one task.

Tensor files are read without their library: the pickle inside is opened by an unpickler that builds nothing but tensor
descriptions.
"""

from __future__ import annotations

import io
import pickle
import sys
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from setloom.sources.members import _place, files

#: Storage names of tensor files and their element types.
STORAGES = {"FloatStorage": np.dtype("<f4"), "HalfStorage": np.dtype("<f2"), "DoubleStorage": np.dtype("<f8")}
ROWS, RANGE_ROWS = 4096, 1 << 16


class _Tensors(pickle.Unpickler):
    """Builds descriptions of tensors; any other class is refused."""

    def find_class(self, module: str, name: str):
        if name in STORAGES:
            return STORAGES[name]
        if name in ("_rebuild_tensor_v2", "_rebuild_tensor"):
            return lambda storage, offset, size, stride, *_: (storage, offset, size, stride)
        if name == "OrderedDict":
            return dict
        if name == "_rebuild_parameter":
            return lambda data, *_: data
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed here")

    def persistent_load(self, key):
        return key[1], key[2]


class Strided:
    """A two-dimensional array in a file: element type, place of the first element, shape, and strides in elements. ``raw``: the bytes, where the file itself can't be read by place."""

    def __init__(self, kind: np.dtype, start: int, shape: tuple[int, int], strides: tuple[int, int], raw: bytes | None = None):
        self.kind, self.start, self.shape, self.strides, self.raw = kind, start, shape, strides, raw

    def rows(self, f, a: int, b: int) -> np.ndarray:
        """Rows from ``a`` to ``b``, of the bytes that they take."""
        (_, width), (down, right), size = self.shape, self.strides, self.kind.itemsize
        if a >= b or not width:
            return np.zeros((max(0, b - a), width), self.kind)

        def span(first: int, last: int) -> np.ndarray:
            at = self.start + first * size
            data = self.raw[at : at + (last - first + 1) * size] if self.raw is not None else _at(f, at, (last - first + 1) * size)
            return np.frombuffer(data, self.kind)

        if down >= right:
            data = span(a * down, (b - 1) * down + (width - 1) * right)
            return np.lib.stride_tricks.as_strided(data, (b - a, width), (down * size, right * size))
        return np.stack([span(a * down + c * right, (b - 1) * down + c * right)[::down] if down else np.repeat(span(c * right, c * right), b - a) for c in range(width)], axis=1)


def _at(f, start: int, n: int) -> bytes:
    f.seek(start)
    return f.read(n)


def _stored(f, archive: zipfile.ZipFile, name: str) -> tuple[int, bytes | None]:
    """Where the bytes of a member begin in the file, or the bytes if they are compressed."""
    info = archive.getinfo(name)
    if info.compress_type != zipfile.ZIP_STORED:
        return 0, archive.read(name)
    head = _at(f, info.header_offset, 30)
    return info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), None


def _array(f, archive: zipfile.ZipFile, name: str) -> Strided:
    """An array of an archive, one of one dimension as a column."""
    start, raw = _stored(f, archive, name + ".npy")
    head = io.BytesIO(raw if raw is not None else _at(f, start, 1 << 12))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if kind.hasobject:
        raise ValueError(f"{name} holds objects")
    shape = (shape[0], 1) if len(shape) == 1 else shape
    return Strided(kind, start + head.tell(), shape, (1, shape[0]) if fortran else (shape[1], 1), raw)


def _tensor(f, archive: zipfile.ZipFile) -> Strided:
    """The first tensor of a zipped tensor file; it has two dimensions."""
    inner = next(n for n in archive.namelist() if n.endswith("data.pkl"))
    found = _Tensors(io.BytesIO(archive.read(inner))).load()
    if isinstance(found, dict):
        found = next(iter(found.values()))
    (kind, key), offset, size, stride = found
    start, raw = _stored(f, archive, inner.removesuffix("data.pkl") + f"data/{key}")
    return Strided(kind, start + offset * kind.itemsize, tuple(size), tuple(stride), raw)


def tensor(content: bytes) -> np.ndarray:
    """The one two-dimensional float tensor of a zipped tensor file."""
    f = io.BytesIO(content)
    with zipfile.ZipFile(f) as archive:
        found = _tensor(f, archive)
        return found.rows(f, 0, found.shape[0]).copy()


def _vectors(ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    part = np.ascontiguousarray(matrix, dtype=np.float32)
    ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))], names=["item_id", "embedding"])


class ArrayRows(DataSource):
    """Format ``array_rows``: ``kind`` is archive (ids and embeddings), tensor, or sparse; ``range_rows`` the rows of a task."""

    @classmethod
    def name(cls) -> str:
        return "array_rows"

    def schema(self) -> str:
        return "row long, col long, value double" if self.options["kind"] == "sparse" else "item_id long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["kind"], int(self.options.get("range_rows", RANGE_ROWS)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, range_rows: int):
        self.path, self.kind, self.range_rows = path, kind, range_rows

    def open(self, path: str):
        store, at = _place(path)
        return store.open_input_file(at)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, _ in files(self.path):
            with self.open(path) as f, zipfile.ZipFile(f) as archive:
                main = _tensor(f, archive) if self.kind == "tensor" else _array(f, archive, "embeddings" if self.kind == "archive" else "row" if "row.npy" in archive.namelist() else "indptr")
                n = main.shape[0] - (self.kind == "sparse" and "row.npy" not in archive.namelist())
                step = self.range_rows if main.raw is None else max(1, n)
            out += [InputPartition((path, a, min(n, a + step))) for a in range(0, n, step)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, first, last = partition.value
        with self.open(path) as f, zipfile.ZipFile(f) as archive:
            if self.kind == "sparse":
                yield from self.coordinates(f, archive, first, last)
                return
            matrix = _tensor(f, archive) if self.kind == "tensor" else _array(f, archive, "embeddings")
            ids = _array(f, archive, "ids") if self.kind == "archive" else None
            for a in range(first, last, ROWS):
                b = min(last, a + ROWS)
                yield _vectors(np.arange(a, b) if ids is None else ids.rows(f, a, b)[:, 0], matrix.rows(f, a, b))

    def coordinates(self, f, archive: zipfile.ZipFile, first: int, last: int) -> Iterator[pa.RecordBatch]:
        """Entries of a matrix: of a coordinate list by place, of a compressed one by rows or columns."""
        kind = archive.read("format.npy")
        kind = np.lib.format.read_array(io.BytesIO(kind)).item()
        kind = kind.decode() if isinstance(kind, bytes) else kind
        data = _array(f, archive, "data")
        names = ["row", "col", "value"]
        batch = lambda row, col, value: pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(col.astype(np.int64)), pa.array(value.astype(np.float64))], names=names)
        if kind == "coo":
            row, col = _array(f, archive, "row"), _array(f, archive, "col")
            for a in range(first, last, 1 << 16):
                b = min(last, a + (1 << 16))
                yield batch(*(x.rows(f, a, b)[:, 0] for x in (row, col, data)))
            return
        ends, minor = _array(f, archive, "indptr").rows(f, first, last + 1)[:, 0].astype(np.int64), _array(f, archive, "indices")
        for a in range(int(ends[0]), int(ends[-1]), 1 << 16):
            b = min(int(ends[-1]), a + (1 << 16))
            major = first + np.searchsorted(ends, np.arange(a, b), side="right") - 1
            other, value = minor.rows(f, a, b)[:, 0], data.rows(f, a, b)[:, 0]
            yield batch(major, other, value) if kind == "csr" else batch(other, major, value)


def _scan(spark: SparkSession, path: str, kind: str, range_rows: int) -> DataFrame:
    spark.dataSource.register(ArrayRows)
    return spark.read.format("array_rows").options(kind=kind, range_rows=range_rows).load(path)


def npz_vectors(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (item_id, embedding) of an archive with ``ids`` and ``embeddings``."""
    return _scan(spark, path, "archive", range_rows)


def sparse_matrix(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Coordinates (row, col, value) of a saved compressed or coordinate matrix."""
    return _scan(spark, path, "sparse", range_rows)


def tensor_vectors(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (item_id, embedding); an item's id is its row."""
    return _scan(spark, path, "tensor", range_rows)


def aligned(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (item_id) with its vectors and whether there is one."""
    return wanted.select("item_id").join(vectors, "item_id", "left").withColumn("present", F.col("embedding").isNotNull())


cloudpickle.register_pickle_by_value(sys.modules[__name__])
