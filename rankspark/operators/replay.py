"""Replays of stored rankings under gain variants, ranks among whole corpora, checkpoints of tournaments, tree expansion."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ndcg, ranked
from .statistics import pair_statistics
from .tournament import bradley_terry


def rescore(judgments: DataFrame, variants: list[tuple[str, str, float]], k: int = 10) -> DataFrame:
    """(variant, query, ndcg) for each (name, gain, scale): the ranking is computed once and read for each."""
    both = ranked(ranked(judgments, "score", "rk"), "relevance", "irk")
    gains = F.array(*[F.struct(F.lit(n).alias("variant"), (F.col("relevance") * s if g == "linear" else F.pow(F.lit(2.0), F.col("relevance") * s) - 1).alias("g")) for n, g, s in variants])
    long = both.where((F.col("rk") <= k) | (F.col("irk") <= k)).select("query", "rk", "irk", F.explode(gains).alias("v")).select("query", "rk", "irk", "v.*")
    sums = long.groupBy("variant", "query").agg(F.sum(F.when(F.col("rk") <= k, F.col("g") / F.log2(F.col("rk") + 1.0))).alias("dcg"), F.sum(F.when(F.col("irk") <= k, F.col("g") / F.log2(F.col("irk") + 1.0))).alias("ideal"))
    return sums.select("variant", "query", F.when(F.col("ideal") == 0, 0.0).otherwise(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def replay_matches(judgments: DataFrame, stored: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(compared, wrong): how many stored nDCG differ from those of the replay."""
    both = ndcg(judgments).join(stored.select("query", F.col("ndcg").alias("stored")), "query")
    return both.agg(F.count("*").alias("compared"), F.sum((F.abs(F.col("ndcg") - F.col("stored")) > tolerance).cast("int")).alias("wrong"))


def own_rank(scores: DataFrame, own: DataFrame, query: str = "query", doc: str = "doc") -> DataFrame:
    """scores (query, doc, score) and own (query, doc): each query's rank of its own document, one more than those strictly
    better. One aggregation after a join on the query; the corpus is not sorted."""
    mine = scores.join(own, [query, doc]).groupBy(query).agg(F.max("score").alias("_own"))
    better = F.sum(F.when(F.col("score") > F.col("_own"), 1).otherwise(0))
    return scores.join(mine, query).groupBy(query).agg((better + 1).alias("rank"))


def checkpoint_inversions(matches: DataFrame, truth: DataFrame, rounds: list[int]) -> DataFrame:
    """matches (target, a, b, winner, round) and truth (target, player, value) to (round, mean_inversions): after each listed
    round the ratings so far against the truth; players without a match rate 0."""
    parts = []
    for r in rounds:
        rated = bradley_terry(matches.where(F.col("round") <= r).drop("round"))
        both = truth.join(rated, ["target", "player"], "left").select("target", "player", "value", F.coalesce("rating", F.lit(0.0)).alias("rating"))
        parts.append(pair_statistics(both, "target", "player", "rating", "value").agg(F.lit(r).alias("round"), F.avg("inversions").alias("mean_inversions")))
    return reduce(DataFrame.unionByName, parts)


def expand(tree: DataFrame, items: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Breadth-first tagging: items (item, path) start at the root; each level's children (item, path) pass `keep`, which
    scores and filters them, until none is left. Returns all kept (item, path). Levels are checkpointed."""
    frontier, kept = items, []
    edges = tree.where("parent_path is not null").select(F.col("path").alias("child"), F.col("parent_path").alias("path"))
    while True:  # a tree's levels end
        frontier = keep(frontier.join(edges, "path").select("item", F.col("child").alias("path"))).checkpoint()
        if not frontier.limit(1).count():
            return reduce(DataFrame.unionByName, kept) if kept else frontier
        kept.append(frontier)
