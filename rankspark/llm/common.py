"""Shared pieces of the training-data operators: tables, shared folders, Arrow batches and byte-level text kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder is set only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="rankspark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=codec)
    return spark.read.schema(schema).parquet(path)


SALTS = 256


def salt(*columns: str) -> Column:
    """A number under SALTS that spreads the rows of one key."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def lookup(rows: DataFrame, key: str, held: DataFrame, spread_by: str, how: str = "inner") -> DataFrame:
    """rows with the columns of held, which has one row a key. However many rows share a key (or have none), no task gets more
    than a SALTS-th of them: held is copied to the salts in which the key occurs. Sort-merge joins at every size, as neither
    side has a proven bound."""
    salted = rows.withColumn("_salt", salt(spread_by))
    places = salted.select(F.col(key).alias("_key"), "_salt").where(F.col(key).isNotNull()).distinct()
    copies = places.join(held.hint("merge"), F.col("_key") == held[key]).drop("_key")
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default: texts can be very long. A setting of the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` text bytes each; a longer single text is a part of its own."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, places, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def _lower_table() -> np.ndarray:
    """Maps A-Z to a-z and leaves the rest."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


LOWER = _lower_table()
#: Bytes of words: after lower-casing, 0-9, a-z and everything above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of words that only space and 0x09-0x0D part.
SOLID = np.ones(256, bool)
SOLID[0x09:0x0E] = SOLID[0x20] = False


def word_spans(values: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all texts, and the word number at which each text begins, with the total last. No word crosses two texts."""
    mask = inside[values]
    first, last = mask.copy(), mask.copy()
    if len(mask):
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(mask))]
        first[cuts] = mask[cuts]
        last[cuts - 1] = mask[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BLOCK = 1 << 19
_PRIME = 0x9E3779B97F4A7C55
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        up, down = np.full(_BLOCK + 1, _PRIME, np.uint64), np.full(_BLOCK + 1, pow(_PRIME, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by prefix sums of a polynomial over blocks of bounded length."""
    up, down = _powers()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + _BLOCK, side="right"))
        if to <= at:  # one word longer than a block
            total, power = 0, 1
            word = values[base : ends[at]]
            for k in range(0, len(word), _BLOCK):
                part = word[k : k + _BLOCK].astype(np.uint64) + np.uint64(1)
                total = (total + power * int(np.sum(part * up[: len(part)]))) % (1 << 64)
                power = power * int(up[len(part)]) % (1 << 64)
            out[at] = total
            at += 1
            continue
        part = values[base : int(ends[to - 1])].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words; runs that cross texts are in it too."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, length):
        out *= _STEP
        out += hashes[k : n + k]
    return mix(out)
