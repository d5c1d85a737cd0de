"""Tables, multi-split tables and row positions (the scans)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return found.select(*columns) if columns else found


def load_placed(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """load() with (file, row), the place where the table holds a row: files by their names' order, rows of a file from 0."""
    rows = load(spark, folder, name, [*columns, "_metadata.file_path", F.col("_metadata.row_index").alias("row")])
    files = rows.select("file_path").distinct().withColumn("file", F.row_number().over(Window.orderBy("file_path")))  # a row a file
    return rows.join(F.broadcast(files), "file_path").drop("file_path")


def stream(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """A Parquet table's files as a stream. The last letter of the name is a pattern, since a stream's path is a folder or a
    pattern and the table may be one file."""
    kinds = load(spark, folder, name, columns).schema
    return spark.readStream.schema(kinds).parquet(f"{folder}/{name}.parque[t]")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or where that is unset (tests), a temporary one."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="rankspark-")
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def union_splits(*splits: DataFrame) -> DataFrame:
    """UNION ALL of splits in order, with split_no."""
    return reduce(DataFrame.unionByName, [s.withColumn("split_no", F.lit(i)) for i, s in enumerate(splits)])


def with_row_idx(df: DataFrame, *order: str, start: int = 0, buckets: int = 64, sampled: int = 4096) -> DataFrame:
    """df with row_idx, its gapless position in the given order (which must be total), without one task ordering all rows:
    rows go to ranges of the whole key, are numbered within, and ranges are offset by the counts before them. Ranges end at
    quantiles of some `sampled` keys that a hash picks, so keys of any type that can be ordered and hashed have them."""
    kinds = dict(df.dtypes)
    each = max(df.count() // sampled, 1)
    keys = df.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(each)) == 0).distinct().orderBy(*order).collect()
    ends = [keys[len(keys) * i // buckets] for i in range(1, buckets)] if keys else []
    bounds = [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, key, strict=True)]) for key in dict.fromkeys(ends)]
    part = F.size(F.filter(F.array(*bounds), lambda b: b < F.struct(*order))) if bounds else F.lit(0)
    placed = df.withColumn("_part", part)
    counts = placed.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_nth", within).join(F.broadcast(before), "_part").withColumn("row_idx", F.col("_before") + F.col("_nth") - 1 + start).drop("_part", "_nth", "_before")
