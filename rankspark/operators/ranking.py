"""Ranking, gains and top-k. Judgments are rows of (query, pos, score, relevance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(relevance: Column, variant: str = "exponential", scale: float = 1.0) -> Column:
    if variant == "linear":
        return relevance * scale
    if variant == "exponential":
        return F.pow(F.lit(2.0), relevance * scale) - 1
    raise ValueError(f"unknown gain {variant!r}")


def ranked(judgments: DataFrame, by: str = "score", out: str = "rk", query: str = "query") -> DataFrame:
    """Positions from 1 by descending `by`, ties by candidate position."""
    return judgments.withColumn(out, F.row_number().over(Window.partitionBy(query).orderBy(F.desc(by), "pos")))


def ndcg(judgments: DataFrame, k: int = 10, variant: str = "exponential", scale: float = 1.0, query: str = "query") -> DataFrame:
    """(query, ndcg): discounted gain of the first k by score over that of the first k by relevance; 0 without any gain.
    Both orders share one shuffle by query."""
    both = ranked(ranked(judgments, "score", "rk", query), "relevance", "irk", query)
    g = gain(F.col("relevance"), variant, scale)
    dcg = F.sum(F.when(F.col("rk") <= k, g / F.log2(F.col("rk") + 1.0)))
    ideal = F.sum(F.when(F.col("irk") <= k, g / F.log2(F.col("irk") + 1.0)))
    return both.groupBy(query).agg(dcg.alias("dcg"), ideal.alias("ideal")).select(query, F.when(F.coalesce("ideal", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def branch_means(scores: DataFrame, value: str = "ndcg", domains: str = "domains") -> DataFrame:
    """(branch, mean, n): a query counts in every domain it lists; null branch is overall. Null scores are left out; what has
    none gets 0."""
    overall = scores.select(F.lit(None).cast("string").alias("branch"), value)
    each = scores.select(F.explode(domains).alias("branch"), value)
    return overall.unionByName(each).groupBy("branch").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.count(value).alias("n"))


def with_all_branches(means: DataFrame, branches: list[str]) -> DataFrame:
    """branch_means() with a zero row for each branch that has no query."""
    known = means.sparkSession.createDataFrame([(b,) for b in branches] + [(None,)], "branch string")
    return F.broadcast(known).alias("k").join(means.alias("m"), F.col("k.branch").eqNullSafe(F.col("m.branch")), "left").select("k.branch", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def competition_rank(df: DataFrame, partition: list[str], by: str, out: str = "rank") -> DataFrame:
    """1 + the number of strictly better rows."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*partition).orderBy(F.desc(by))))


def average_rank(df: DataFrame, by: str, partition: list[str] | None = None, ascending: bool = True, out: str = "avg_rank") -> DataFrame:
    """Ranks from 1 with ties at their mean. Values are ranked once each: counts of a value, then a running sum over values."""
    keys = partition or []
    counts = df.groupBy(*keys, by).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    upto = F.sum("_n").over(w.orderBy(F.asc(by) if ascending else F.desc(by)))
    ranks = counts.withColumn(out, upto - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranks, [*keys, by], "left")


def top_k_stable(judgments: DataFrame, k: int, query: str = "query", by: str = "score") -> DataFrame:
    """The first k by descending score, ties in candidate order."""
    return ranked(judgments, by, "rk", query).where(F.col("rk") <= k)


def top_tuples(scores: Column, ids: Column, k: int = 5) -> Column:
    """The last k of (score, id) pairs in ascending order, of aligned arrays: a tie goes to the larger id."""
    pairs = F.array_sort(F.zip_with(scores, ids, lambda s, i: F.struct(s.alias("score"), i.alias("id"))))
    return F.slice(pairs, F.greatest(F.size(pairs) - k + 1, F.lit(1)), k)


def rank_summary(ranks: DataFrame, value: str = "rank", by: list[str] | None = None, tops: tuple[int, ...] = (1, 2, 4, 8, 16, 32, 64, 128)) -> DataFrame:
    """Mean, median, mean of ranks up to the 95th percentile, 90th, 99th, largest, and shares within each top."""
    keys = by or []
    cut = ranks.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.95)").alias("_p95"))
    joined = ranks.join(cut, keys) if keys else ranks.crossJoin(F.broadcast(cut))  # one row
    return joined.groupBy(*keys).agg(
        F.avg(value).alias("avg_rank"),
        F.expr(f"percentile({value}, 0.5)").alias("median_rank"),
        F.avg(F.when(F.col(value) <= F.col("_p95"), F.col(value))).alias("trimmed_mean_rank_95"),
        F.expr(f"percentile({value}, 0.9)").alias("p90_rank"),
        F.expr(f"percentile({value}, 0.99)").alias("p99_rank"),
        F.max(value).alias("max_rank"),
        *[F.avg(F.when(F.col(value) <= t, 1.0).otherwise(0.0)).alias(f"top_{t}") for t in tops],
        F.count("*").alias("n"),
    )


def top_with_other(df: DataFrame, group: str, item: str, weight: str, keep: int, forced: list[str] | None = None) -> DataFrame:
    """The keep - 1 heaviest items of each group and the forced ones; the rest is summed as 'Other'."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(weight), item))
    kept = (F.col("_rn") <= keep - 1) | F.col(item).isin(*(forced or [""]))
    return df.withColumn("_rn", place).groupBy(group, F.when(kept, F.col(item)).otherwise("Other").alias(item)).agg(F.sum(weight).alias(weight))


def cumulative_share(df: DataFrame, group: str, order: list[str], weight: str) -> DataFrame:
    """Running share of the group's total weight, in order."""
    w = Window.partitionBy(group)
    running = F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("cdf", running / F.sum(weight).over(w))
