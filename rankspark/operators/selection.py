"""Thresholds, buckets, seeded samples, quotas and index remaps of the construction side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import portable_hash


def order_statistic(rows: DataFrame, value: str, p: float) -> DataFrame:
    """The ceil(p * n)-th smallest finite value, in one pass over value counts."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return finite.agg(F.expr(f"percentile_disc({p}) within group (order by {value})").alias("threshold"))


def histogram(rows: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """(bucket, n, upto) of equal widths over [low, high]: bucket -1 is below, `buckets` above; upto is the running count."""
    width = (high - low) / buckets
    bucket = F.when(F.col(value) < low, -1).when(F.col(value) > high, buckets).when(F.col(value) == high, buckets - 1).otherwise(F.floor((F.col(value) - low) / width))
    counts = rows.where(F.col(value).isNotNull()).groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def buckets(pairs: DataFrame, bma: float | Column, jac: float | Column, i: str = "i", j: str = "j") -> DataFrame:
    """pairs (i, j, bma, jac) with bucket: 'bma' (only that is high), 'jaccard', 'both'; others and self-pairs go."""
    high_b, high_j = F.col("bma") >= bma, F.col("jac") >= jac
    name = F.when(high_b & ~high_j, "bma").when(~high_b & high_j, "jaccard").when(high_b & high_j, "both")
    return pairs.where(F.col(i) != F.col(j)).withColumn("bucket", name).where(F.col("bucket").isNotNull())


def viable(bucketed: DataFrame, least: int, i: str = "i") -> DataFrame:
    """The targets that have at least `least` candidates in each of the three buckets."""
    counts = [F.sum(F.when(F.col("bucket") == b, 1).otherwise(0)).alias(b) for b in ("bma", "jaccard", "both")]
    return bucketed.groupBy(i).agg(*counts).where((F.col("bma") >= least) & (F.col("jaccard") >= least) & (F.col("both") >= least)).select(i)


def hashed_sample(rows: DataFrame, groups: list[str], n: int, seed: str, *keys: str) -> DataFrame:
    """n rows of each group without replacement (all, if it has fewer), by a hash of seed and keys."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(portable_hash(seed, *[F.col(k) for k in keys]), *keys))
    return rows.withColumn("_rn", place).where(F.col("_rn") <= n).drop("_rn")


def quota_sample(rows: DataFrame, stratum: str, quotas: dict[str, int], seed: str, key: str) -> DataFrame:
    """As many rows of each stratum as its quota says, by hash; a stratum that cannot fill its quota raises."""
    known = rows.sparkSession.createDataFrame(list(quotas.items()), f"{stratum} string, quota int")
    w = Window.partitionBy(stratum)
    ranked = rows.join(F.broadcast(known), stratum).withColumn("_rn", F.row_number().over(w.orderBy(portable_hash(seed, F.col(key)), key))).withColumn("_n", F.count("*").over(w))
    enough = F.when(F.col("_n") < F.col("quota"), F.raise_error(F.concat(F.lit("quota not filled: "), F.col(stratum))).cast("boolean")).otherwise(F.col("_rn") <= F.col("quota"))
    return ranked.where(enough).drop("_rn", "_n", "quota")


def strided_shard(rows: DataFrame, index: str, shards: int, shard: int) -> DataFrame:
    return rows.where(F.pmod(F.col(index), F.lit(shards)) == shard)


def remap(lists: DataFrame, key: str, array: str) -> DataFrame:
    """lists with the old indices of `array` replaced by dense ones, in ascending order of the old over all lists; order kept.
    Dense numbers come from range-partitioned counts, not from one sorted task."""
    from ..sources.tables import with_row_idx

    used = lists.select(F.explode(array).alias("old")).distinct()
    dense = with_row_idx(used, "old").withColumnRenamed("row_idx", "new")
    long = lists.select(key, F.posexplode(array).alias("pos", "old")).join(dense, "old")
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("z")).select(key, F.transform("z", lambda x: x["new"]).alias(array))
