"""Vector caches and similarity blocks: imports from NumPy and pickle files, keep-last merges, blocks that are read row by row."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "side string, version string, row_idx long, vector array<float>"


def from_npz(spark: SparkSession, path: str) -> DataFrame:
    """(side, version, row_idx, vector) of an archive with arrays named <query|document>_<version>; a file on the driver, read
    array by array."""
    out = spark.createDataFrame([], VECTORS)
    with np.load(path) as held:
        for name in sorted(held.files):
            side, _, version = name.partition("_")
            rows = held[name]
            part = spark.createDataFrame([(side, version, i, v) for i, v in enumerate(rows.astype(np.float32).tolist())], VECTORS)
            out = out.unionByName(part)
    return out


def keyed_by_text(vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """vectors (side, version, row_idx, vector) and texts (side, version, row_idx, text) to a cache (side, text, vector)."""
    return vectors.join(texts, ["side", "version", "row_idx"]).select("side", "text", "vector")


def from_pickle(spark: SparkSession, path: str, trusted: bool = False) -> DataFrame:
    """(side, text, vector) of a pickled dict {(side, text): vector}. Unpickling can run code: the caller must trust the file."""
    if not trusted:
        raise ValueError("a pickle can run code: pass trusted=True for a file of your own")
    with open(path, "rb") as file:
        held = pickle.load(file)
    return spark.createDataFrame([(side, text, np.asarray(v, np.float32).tolist()) for (side, text), v in held.items()], "side string, text string, vector array<float>")


def merged(old: DataFrame, new: DataFrame, keys: Iterable[str] = ("side", "text")) -> DataFrame:
    """Both caches; of equal keys the new one stays."""
    keys = list(keys)
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*keys, "_r.*")


def write_blocks(similarities: DataFrame, folder: str, size: int) -> None:
    """(i, j, bma, jaccard), halved in precision, in one folder for each `size` rows i; sorted, so that a row is a short range."""
    rows = similarities.select("i", "j", F.col("bma").cast("float").alias("bma"), F.col("jaccard").cast("float").alias("jaccard"), block(F.col("i"), size).alias("block"))
    rows.repartition("block").sortWithinPartitions("block", "i", "j").write.mode("overwrite").partitionBy("block").parquet(folder)


def block(i: Column, size: int) -> Column:
    return F.floor(i / size).cast("long")


def read_rows(spark: SparkSession, folder: str, ids: list[int], size: int, metric: str | None = None) -> DataFrame:
    """The similarities of some rows: only their blocks' folders and row groups are read, and one metric if named."""
    blocks = sorted({i // size for i in ids})
    found = spark.read.parquet(folder).where(F.col("block").isin(blocks) & F.col("i").isin(ids))
    return found.select("i", "j", *([metric] if metric else ["bma", "jaccard"]))


def blocks_in(spark: SparkSession, folder: str) -> list[int]:
    """The blocks that are there, in order of their numbers."""
    return [r[0] for r in spark.read.parquet(folder).select("block").distinct().orderBy("block").collect()]


def write_rankings(rankings: DataFrame, folder: str) -> None:
    """(model, row, ranking array) as Parquet, positions in small integers."""
    rankings.select("model", F.col("row").cast("int").alias("row"), F.col("ranking").cast("array<smallint>").alias("ranking")).write.mode("overwrite").parquet(folder)


def fingerprinted(cache: DataFrame, fingerprint: str) -> DataFrame:
    """A cache's entries made by the same recipe; others count as missing."""
    return cache.where(F.col("fingerprint") == fingerprint).drop("fingerprint")


def missing_texts(texts: DataFrame, cache: DataFrame, key: str = "text") -> DataFrame:
    """Distinct texts without an entry, to be computed once each."""
    return texts.select(key).distinct().join(cache.select(key), key, "left_anti")
