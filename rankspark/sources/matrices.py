"""Binary matrices as a data source: .npy files and chunks of interleaved float16 pairs, read and written by the executors.

    spark.dataSource.register(MatrixSource)
    spark.read.format("matrix").option("layout", "npy").load(path)             row, values
    spark.read.format("matrix").option("layout", "pairs").option("columns", n).load(folder)   row, first, second

A partition is a range of bytes of one file, at most `bytes` long (whole rows). Named rows (the option rows: numbers and commas), and
with spark.sql.python.filterPushdown.enabled filters on row (equality, IN, bounds), prune files and ranges, so that reading one row
seeks to it and reads nothing else. A folder's files are ordered by the number at the end of their stems,
and a row's number counts on from file to file. Writing needs rows dealt by chunk (see write_matrix): a task writes whole chunks
of `rows` rows under temporary names, which the commit renames; a task that runs twice writes its files anew.

Defined results: a file without rows has none; a row that misses in a chunk, comes twice, or is of another length than the first one,
is refused; null values are stored as NaN; an empty table writes no file, and a folder without files can't be read.
"""

from __future__ import annotations

import ast
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

RANGE_BYTES = 8 << 20
_MAGIC = b"\x93NUMPY"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def chunk_files(path: str, ending: str) -> list[tuple[str, int]]:
    """(file, size) of a file or of a folder's files, by the number that ends the stem."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(place, info.size)]
    found = [f for f in store.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.base_name.endswith(ending) and f.base_name[0] not in "._"]
    if not found:
        raise FileNotFoundError(f"no {ending} file in {path}")

    def number(f: fs.FileInfo) -> tuple[int, str]:
        digits = re.search(r"(\d+)\.[^.]*$", f.base_name)
        return (int(digits[1]) if digits else -1, f.base_name)

    return [(f.path, f.size) for f in sorted(found, key=number)]


def npy_shape(store: fs.FileSystem, path: str) -> tuple[int, np.dtype, int, int]:
    """Where a .npy file's numbers begin, their type, rows and columns. Only its header is read."""
    with store.open_input_file(path) as f:
        if f.read(6) != _MAGIC:
            raise ValueError(f"{path} is not a .npy file")
        wide = f.read(2)[0] > 1
        size = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
        head = ast.literal_eval(f.read(size).decode("latin1"))
        kind = np.dtype(head["descr"])
        if head["fortran_order"] or kind.kind not in "fiu" or len(head["shape"]) not in (1, 2):
            raise ValueError(f"{path} is not a matrix of numbers in row order")
        return f.tell(), kind, head["shape"][0], head["shape"][1] if len(head["shape"]) == 2 else 1


@dataclass
class Range(InputPartition):
    """Rows `first` to `first + rows` of all, in a file from byte `at` on."""

    path: str
    at: int
    first: int
    rows: int
    columns: int
    kind: str


@dataclass
class Chunks(WriterCommitMessage):
    files: list[tuple[str, str]]


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "row long, values array<double>" if self.options.get("layout", "npy") == "npy" else "row long, first array<float>, second array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_PruningReader if self.options.get("prune") == "true" else _Reader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.least, self.most = options, 0, None
        named = options.get("rows")
        self.rows = None if named is None else {int(r) for r in named.split(",") if r}

    def _wanted(self, first: int, rows: int) -> Iterator[tuple[int, int]]:
        """Runs of rows of a file that pass the filters, counted from its first."""
        lo, hi = max(self.least - first, 0), rows if self.most is None else min(rows, self.most + 1 - first)
        if self.rows is None:
            if lo < hi:
                yield lo, hi
            return
        # neighbours are one run
        some = np.array(sorted(r - first for r in self.rows if r is not None and lo <= r - first < hi), np.int64)
        for run in np.split(some, np.flatnonzero(np.diff(some) > 1) + 1):
            if len(run):
                yield int(run[0]), int(run[-1]) + 1

    def partitions(self) -> list[Range]:
        path, layout = self.options["path"], self.options.get("layout", "npy")
        store, most = opened(path)[0], int(self.options.get("bytes", RANGE_BYTES))
        out, first = [], 0
        for file, size in chunk_files(path, ".npy" if layout == "npy" else ".f16"):
            if layout == "npy":
                begin, kind, rows, columns = npy_shape(store, file)
            else:
                begin, kind, columns = 0, np.dtype("<f2"), 2 * int(self.options["columns"])
                rows = size // (2 * columns)
            wide = max(kind.itemsize * columns, 1)
            step = max(most // wide, 1)
            for lo, hi in self._wanted(first, rows):
                out += [Range(file, begin + wide * k, first + k, min(step, hi - k), columns, kind.str) for k in range(lo, hi, step)]
            first += rows
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store = opened(self.options["path"])[0]
        kind = np.dtype(partition.kind)
        with store.open_input_file(partition.path) as f:
            f.seek(partition.at)
            raw = f.read(partition.rows * partition.columns * kind.itemsize)
        held = np.frombuffer(raw, kind).reshape(partition.rows, partition.columns)
        numbers = pa.array(np.arange(partition.first, partition.first + partition.rows))

        def lists(values: np.ndarray, to: type) -> pa.Array:
            ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values, to).reshape(-1)))

        if self.options.get("layout", "npy") == "npy":
            yield pa.RecordBatch.from_arrays([numbers, lists(held, np.float64)], names=["row", "values"])
        else:
            yield pa.RecordBatch.from_arrays([numbers, lists(held[:, 0::2], np.float32), lists(held[:, 1::2], np.float32)], names=["row", "first", "second"])


class _PruningReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on row narrow what is read; Spark applies them again to the rows of the ranges."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                if isinstance(f, (EqualTo, In)):
                    some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.rows = some if self.rows is None else self.rows & some
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    most = f.value - isinstance(f, LessThan)
                    self.most = most if self.most is None else min(self.most, most)
            yield f


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.mark = options, overwrite, uuid.uuid4().hex

    def _bytes(self, rows: list[np.ndarray]) -> bytes:
        kind = "<f2" if self.options.get("layout", "npy") == "pairs" else self.options.get("type", "<f8")
        held = np.stack(rows).astype(kind)
        if kind == "<f2" and self.options.get("layout") == "pairs":
            return held.tobytes()
        head = f"{{'descr': '{np.dtype(kind).str}', 'fortran_order': False, 'shape': {held.shape}, }}"
        head = head.ljust(117 if len(head) < 118 else -(-(len(head) + 11) // 64) * 64 - 11) + "\n"
        return _MAGIC + b"\x01\x00" + struct.pack("<H", len(head)) + head.encode() + held.tobytes()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Chunks:
        store, place = opened(self.options["path"])
        size, pairs = int(self.options["rows"]), self.options.get("layout", "npy") == "pairs"
        store.create_dir(place, recursive=True)
        files, held, number = [], [], None

        def close() -> None:
            name = f"{place}/chunk-{number}.{'f16' if pairs else 'npy'}"
            temporary = f"{place}/.{self.mark}-{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(self._bytes(held))
            files.append((temporary, name))

        for batch in batches:
            columns = [batch.column(c) for c in (("first", "second") if pairs else ("values",))]
            for k, row in enumerate(batch.column("row").to_pylist()):
                if number is not None and row // size != number:
                    close()
                    held, number = [], None
                number = row // size if number is None else number
                values = [np.array([np.nan if x is None else x for x in c[k].as_py()]) for c in columns]
                line = np.stack(values, axis=1).reshape(-1) if pairs else values[0]
                if row != number * size + len(held) or held and len(line) != len(held[0]):
                    raise ValueError(f"row {row} is not the next one of chunk {number}, or not as long as the others")
                held.append(line)
        if held:
            close()
        return Chunks(files)

    def commit(self, messages: list[Chunks | None]) -> None:
        store, place = opened(self.options["path"])
        ready = [f for m in messages if m for f in m.files]
        if self.overwrite:
            keep = {t for t, _ in ready}
            for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path not in keep and info.base_name.startswith("chunk-"):
                    store.delete_file(info.path)
        for temporary, name in ready:
            store.move(temporary, name)

    def abort(self, messages: list[Chunks | None]) -> None:
        store, place = opened(self.options["path"])
        for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if info.base_name.startswith(f".{self.mark}-"):
                store.delete_file(info.path)


def write_matrix(rows: DataFrame, path: str, layout: str = "npy", chunk: int = 1024, **options: str) -> None:
    """rows (row from 0 without gaps, values; or row, first, second) as files of `chunk` rows each, written by the executors."""
    rows.sparkSession.dataSource.register(MatrixSource)
    columns = ["row", "values"] if layout == "npy" else ["row", "first", "second"]
    placed = rows.select(*columns).withColumn("_chunk", F.floor(F.col("row") / chunk))
    dealt = placed.repartition("_chunk").sortWithinPartitions("row").select(*columns)
    dealt.write.format("matrix").options(layout=layout, rows=str(chunk), **options).mode("overwrite").save(path)


def read_matrix(spark: SparkSession, path: str, layout: str = "npy", rows: list[int] | None = None, **options: str) -> DataFrame:
    """(row, values), or (row, first, second) of pairs with the option columns; the named rows alone, or those that filters leave."""
    spark.dataSource.register(MatrixSource)
    named = {} if rows is None else {"rows": ",".join(map(str, rows))}
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("matrix").options(layout=layout, prune=prune, **named, **options).load(path)
