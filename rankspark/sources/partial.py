"""Tables that are rewritten in part, and shards that are merged only when whole.

A table is kept in parts by a hash of its key. A patch rewrites the parts that its keys fall in and no other: what is untouched stays file
for file. A merge checks what each shard says about itself before it reads one row of them.

Defined results: a patch's null values set null (rows replace rows); of a patch's rows with one key the last by `order` counts; keys that are
new are added; an empty patch changes nothing; columns that a patch lacks are kept from the old row, or null for new keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def write_parts(rows: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """rows as a table in `parts` folders by key."""
    placed = rows.withColumn("part", part_of(key, parts))
    placed.repartition("part").sortWithinPartitions("part", key).write.mode("overwrite").partitionBy("part").parquet(path)


def patch(spark: SparkSession, path: str, changes: DataFrame, key: str, parts: int = 64, order: str | None = None) -> int:
    """Replaces or adds rows by key; returns how many parts were rewritten. The new parts are whole in the shared folder before the old
    ones go, as Spark can't overwrite what it reads."""
    kinds = spark.read.parquet(path).drop("part").schema
    given = [f.name for f in kinds if f.name in changes.columns and f.name != key]
    by = F.col(order) if order else F.lit(0)
    rows = changes.groupBy(key).agg(F.max_by(F.struct(*given), by).alias("_new")).withColumn("part", part_of(key, parts))
    staged = shared_folder(spark, "patch")
    rows.write.parquet(f"{staged}/changes")
    rows = spark.read.schema(rows.schema).parquet(f"{staged}/changes")
    touched = [r["part"] for r in rows.select("part").distinct().collect()]  # at most `parts` numbers
    if not touched:
        return 0
    old = spark.read.parquet(path).where(F.col("part").isin(touched)).withColumn("_old", F.lit(True))
    both = old.join(rows, ["part", key], "full")
    columns = [F.col(key) if f.name == key else F.when(F.col("_new").isNotNull(), F.col(f"_new.{f.name}")).otherwise(F.col(f.name)).alias(f.name) if f.name in given else F.col(f.name) for f in kinds]
    both.select(*columns, "part").write.parquet(f"{staged}/parts")
    ready = spark.read.parquet(f"{staged}/parts").select(*[f.name for f in kinds], "part")
    ready.repartition("part").sortWithinPartitions("part", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return len(touched)


class IncompleteShards(ValueError):
    """Shards that can't be merged, with the reasons."""


def shard_faults(shards: DataFrame, same: list[str]) -> DataFrame:
    """Per run, why its shards (run, shard, shards, n_rows, n_stated and the columns in `same`) can't be merged: null for whole ones. Fields
    that describe the run must be alike, its numbers must be 0 to shards - 1, once each, and each shard must hold the rows it states."""
    counts = shards.groupBy("run").agg(
        F.count("*").alias("n"),
        F.count_distinct("shard").alias("distinct"),
        F.max("shards").alias("most"),
        F.min("shards").alias("least"),
        F.min("shard").alias("first"),
        F.max("shard").alias("last"),
        F.sum((~F.col("n_rows").eqNullSafe(F.col("n_stated"))).cast("int")).alias("short"),
        *[(F.count_distinct(F.struct(c)) > 1).alias(f"mixed_{c}") for c in same],
    )
    mixed = F.filter(F.array(*[F.when(F.col(f"mixed_{c}"), c) for c in same]) if same else F.array().cast("array<string>"), lambda x: x.isNotNull())
    fault = (
        F.when((F.col("most") != F.col("least")) | F.col("most").isNull(), "shards disagree on how many they are")
        .when(F.size(mixed) > 0, F.concat(F.lit("shards differ in "), F.array_join(mixed, ", ")))
        .when(F.col("n") > F.col("distinct"), "a shard is there twice")
        .when((F.col("distinct") < F.col("most")) | (F.col("first") != 0) | (F.col("last") != F.col("most") - 1), F.concat(F.lit("shards are missing: "), (F.col("most") - F.col("distinct")).cast("string")))
        .when(F.col("short") > 0, F.concat(F.lit("shards without all their rows: "), F.col("short").cast("string")))
    )
    return counts.select("run", F.col("most").alias("shards"), fault.alias("fault"))


def merge_shards(shards: DataFrame, rows: DataFrame, path: str, same: list[str], by: str = "row") -> None:
    """Writes the rows (run, shard, `by`, ..) of whole runs to path, a folder a run; raises IncompleteShards, and writes nothing, if any
    run has a fault or a row comes twice."""
    faults = shard_faults(shards, same).where("fault is not null").orderBy("run").limit(20).collect()
    if faults:
        raise IncompleteShards("; ".join(f"{r['run']}: {r['fault']}" for r in faults))
    twice = rows.groupBy("run", by).count().where("count > 1").limit(1).collect()
    if twice:
        raise IncompleteShards(f"{twice[0]['run']}: {by} {twice[0][by]} is in more than one shard")
    rows.drop("shard").repartition("run").sortWithinPartitions("run", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
