"""Run files and their bookkeeping: scan, best run, merge-upsert, shard merge, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import run_name


def scan_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A row a result file: the parts of its name, its text and its time. Unreadable JSON stays as text for the reader."""
    rows = spark.read.option("wholetext", True).text(f"{folder}/*.json").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"))
    stem = F.regexp_replace(F.url_decode("file"), r"\.json$", "")
    return rows.withColumn("r", run_name(stem)).select("file", "mtime", "r.*", "value")


def best_runs(runs: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of each key the run with the largest tuple of the order columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def merge_upsert(old: DataFrame, new: DataFrame, keys: list[str], is_error: Column) -> DataFrame:
    """Rows of both; per key the new one wins, but an error never replaces a good row."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(is_error.cast("int"), F.desc("_v"))
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_v")


def merge_shards(parts: DataFrame, key: str) -> DataFrame:
    """Disjoint union of shards; a key in two of them raises."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("shards overlap at "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return parts.withColumn("_ok", checked).where("_ok").drop("_ok")


def complete_sets(runs: DataFrame, keys: list[str], shard: str, shards: str) -> DataFrame:
    """The keys of which all shards are there."""
    return runs.groupBy(*keys).agg(F.countDistinct(shard).alias("n"), F.max(shards).alias("wanted")).where("n = wanted").select(*keys)


def gaps(indices: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """What is missing of low..high."""
    return indices.sparkSession.range(low, high + 1).withColumnRenamed("id", column).join(indices, column, "left_anti")


def unseen(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Resume: the rows without a checkpoint entry."""
    return rows.join(done, list(keys), "left_anti")


def coverage(expected: DataFrame, found: DataFrame, keys: list[str], count: str, wanted: int) -> DataFrame:
    """expected keys with status: missing, short, null or ok."""
    joined = expected.join(found, keys, "left")
    status = F.when(F.col(count).isNull(), "missing").when(F.col(count) < wanted, "short").when(F.col("nulls") > 0, "null").otherwise("ok")
    return joined.select(*keys, status.alias("status"))


def pivot_cells(cells: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A grid of formatted cells, '-' where there is none."""
    wide = cells.groupBy(row).pivot(column, columns).agg(F.first(F.format_string("%.3f", F.col(value))))
    return wide.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit("-")).alias(c) for c in columns])
