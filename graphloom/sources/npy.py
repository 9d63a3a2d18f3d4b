"""``npy``: arrays in NumPy's file format as a data source, read by ranges of rows and written in parts.

Headers are read when the query is planned; each task then reads the bytes of its rows from the store. Paths are files or folders of files, which are
read in the order of their names, on any store that Arrow reaches from the executors (local, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of rows that a task reads, and that a written part holds, at most.
BYTES = 32 << 20


@dataclass
class Header:
    path: str
    shape: tuple[int, ...]
    dtype: np.dtype
    offset: int

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 0

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def headers(path: str) -> list[Header]:
    """Of the file, or of all .npy files in the folder, by name. Arrays have one axis or two, rows first."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [at] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(".npy"))
    out = []
    for name in files:
        with store.open_input_file(name) as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, columns_first, dtype = read(f)
            if len(shape) not in (1, 2) or columns_first and len(shape) == 2 and min(shape) > 1:
                raise ValueError(f"{name}: needs rows of one array, not shape {shape}{' by columns' if columns_first else ''}")
            h = Header(name, shape, dtype, f.tell())
            if not dtype.hasobject and info.is_file and info.size < h.offset + h.rows * h.row_bytes:
                raise ValueError(f"{name}: shorter than its header says")
            out.append(h)
    kinds = {(h.dtype.kind, h.shape[1:]) for h in out}
    if len(kinds) > 1:
        raise ValueError(f"{path}: files of several kinds, {sorted(map(str, kinds))}")
    return out


class _Texts(pickle.Unpickler):
    """Reads pickled arrays of texts, and refuses all else that a pickle may name."""

    def find_class(self, module: str, name: str):
        if module.startswith("numpy") and name in ("_reconstruct", "ndarray", "dtype", "scalar", "str_"):
            return super().find_class(module, name)
        raise ValueError(f"an array of names must not hold {module}.{name}")


class Rows(InputPartition):
    def __init__(self, header: Header, start: int, n: int, first: int):
        self.header, self.start, self.n, self.first = header, start, n, first


class NpyReader(DataSourceReader):
    def __init__(self, path: str, most: int, double: bool):
        self.path, self.most, self.double = path, most, double

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        for h in headers(self.path):
            step = h.rows if h.dtype.hasobject else max(1, self.most // max(1, h.row_bytes))  # a pickle can't be read in parts
            out += [Rows(h, a, min(step, h.rows - a), first + a) for a in range(0, h.rows, max(1, step))]
            first += h.rows
        return out or [Rows(None, 0, 0, 0)]

    def read(self, rows: Rows) -> Iterator[pa.RecordBatch]:
        if not rows.n:
            return
        h = rows.header
        store, _ = _store(self.path)
        with store.open_input_file(h.path) as f:
            f.seek(h.offset)
            if h.dtype.hasobject:
                a = _Texts(io.BytesIO(f.read())).load()
            else:
                f.seek(h.offset + rows.start * h.row_bytes)
                a = np.frombuffer(f.read(rows.n * h.row_bytes), h.dtype).reshape(rows.n, *h.shape[1:])
        index = pa.array(range(rows.first, rows.first + rows.n), pa.int64())
        if len(h.shape) == 1:
            texts = [x.decode() if isinstance(x, bytes) else None if x is None else str(x) for x in a.tolist()]
            yield pa.RecordBatch.from_arrays([index, pa.array(texts, pa.string())], ["row_idx", "name"])
            return
        flat = pa.array(a.astype(np.float64 if self.double else np.float32).ravel())
        ends = pa.array(np.arange(0, rows.n + 1, dtype=np.int32) * h.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([index, pa.ListArray.from_arrays(ends, flat)], ["row_idx", "v"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpyWriter(DataSourceArrowWriter):
    """Parts of bounded size, whose names keep the order of partitions and of rows within them. A failed task's parts go."""

    def __init__(self, path: str, column: str, most: int, double: bool):
        self.path, self.column, self.most, self.kind = path, column, most, np.float64 if double else np.float32

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        part, mark, files = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], []

        def flush(rows: list[np.ndarray]) -> None:
            name = f"{at}/part-{part:05d}-{len(files):05d}-{mark}.npy"
            with store.open_output_stream(name) as f:
                np.lib.format.write_array(f, np.stack(rows), allow_pickle=False)
            files.append(name)

        held: list[np.ndarray] = []
        for batch in batches:
            for row in batch.column(batch.schema.get_field_index(self.column)).to_pylist():
                held.append(np.array(row, dtype=self.kind))
                if len(held) * held[0].nbytes >= self.most:
                    flush(held)
                    held = []
        if held:
            flush(held)
        return Written(files)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for name in m.files if m else []:
                store.delete_file(name)


class NpySource(DataSource):
    """Options: ``path``; ``bytes``, of a task's rows or a written part; ``column``, to write."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        found = headers(self.options["path"])
        if found and len(found[0].shape) == 1:
            return "row_idx long, name string"
        return f"row_idx long, v array<{'double' if found and found[0].dtype.itemsize > 4 else 'float'}>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("bytes", BYTES)), "double" in schema.simpleString())

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        column = self.options.get("column", schema.names[-1])
        return NpyWriter(self.options["path"], column, int(self.options.get("bytes", BYTES)), "double" in schema[column].dataType.simpleString())


def read_npy(spark: SparkSession, path: str, most: int = BYTES) -> DataFrame:
    """(row_idx, v) of a matrix, or (row_idx, name) of a list of texts. An array without rows gives none."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("bytes", most).load(path)


def write_npy(vectors: DataFrame, path: str, column: str = "v", most: int = BYTES) -> None:
    """``column`` of all rows as .npy parts in the new folder ``path``, in the order of rows; vectors have one length and no nulls."""
    vectors.sparkSession.dataSource.register(NpySource)
    vectors.select(column).write.format("npy").option("bytes", most).option("column", column).mode("append").save(path)


def read_named(spark: SparkSession, matrix: str, names: str, most: int = BYTES) -> DataFrame:
    """(row_idx, name, v): rows of a matrix with those of a list of names, joined by their place; an error if there are not as many."""
    a, b = (sum(h.rows for h in headers(p)) for p in (matrix, names))
    if a != b:
        raise ValueError(f"{b} names for {a} rows")
    return read_npy(spark, names, most).join(read_npy(spark, matrix, most), "row_idx").select("row_idx", "name", "v")
