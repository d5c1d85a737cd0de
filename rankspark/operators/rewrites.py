"""Rewritten queries: a cache of texts by sample, filled in batches, and scorers that read it.

A cache has rows (text, sample from 0, rewrite). Texts without an entry are rewritten once each, and every batch is written
before the next one starts, so a run that stops loses at most its batch; the next run asks only for what is still missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.portable import portable_hash
from ..functions.text import instructed
from ..scorers import Scorer
from ..sources.vectors import missing_texts

CACHE = "text string, sample int, rewrite string"


def fill_cache(texts: DataFrame, folder: str, rewrite: Callable[[list[str]], list[list[str]]], batches: int = 8) -> DataFrame:
    """The cache in folder, with entries for all of texts (text). rewrite, called on Arrow batches by the executors, gives each
    text's samples; a text for which it gives none stays missing. Texts are dealt into batches by hash. Null texts are
    skipped; repeated ones are rewritten once."""
    spark = texts.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = rewrite(frame["text"].tolist())
            if len(found) != len(frame):
                raise ValueError(f"{len(found)} answers for {len(frame)} texts")
            rows = [(t, n, r) for t, samples in zip(frame["text"], found, strict=True) for n, r in enumerate(samples)]
            yield pd.DataFrame(rows, columns=["text", "sample", "rewrite"])

    spark.createDataFrame([], CACHE).write.mode("append").parquet(folder)
    wanted = texts.where(F.col("text").isNotNull())
    for batch in range(batches):
        # read anew: what earlier runs and batches wrote is there
        todo = missing_texts(wanted.where(portable_hash("batch", F.col("text")) % batches == batch), spark.read.schema(CACHE).parquet(folder))
        todo.mapInPandas(run, CACHE).write.mode("append").parquet(folder)
    return spark.read.schema(CACHE).parquet(folder)


def samples_of(texts: DataFrame, cache: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct texts with rewrites, an array in the order of samples; null without an entry, which strict refuses."""
    held = cache.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "rewrite"))), lambda s: s["rewrite"]).alias("rewrites"))
    joined = texts.select("text").distinct().join(held, "text", "left")
    if strict:
        lost = F.raise_error(F.concat(F.lit("no rewrite of "), F.coalesce("text", F.lit("null")))).cast("boolean")
        joined = joined.where(F.when(F.col("rewrites").isNull(), lost).otherwise(True))
    return joined


def reinstructed(rewrites: Column, instruction: Column | str | None) -> Column:
    """Each rewrite under the instruction; as they are without one."""
    return F.transform(rewrites, lambda r: instructed(instruction, r))


def on_rewrites(scorer: Scorer, cache: DataFrame, sample: int = 0, strict: bool = False, instruction: str | None = None) -> Scorer:
    """A scorer that meets one sample of each query's rewrites in place of the query; the query itself where it has none."""

    def score(pairs: DataFrame) -> DataFrame:
        held = samples_of(pairs.select(F.col("query_text").alias("text")), cache, strict)
        chosen = held.select(F.col("text").alias("_own"), F.get(reinstructed(F.col("rewrites"), instruction), F.lit(sample)).alias("_rewrite"))
        met = pairs.withColumnRenamed("query_text", "_own").join(chosen, "_own", "left").withColumn("query_text", F.coalesce("_rewrite", "_own"))
        return scorer(met.drop("_rewrite")).drop("query_text").withColumnRenamed("_own", "query_text")

    return score


def averaged(scorer: Scorer, cache: DataFrame, samples: int, strict: bool = False) -> Scorer:
    """The mean of a scorer's scores over the first samples of each query's rewrites."""

    def score(pairs: DataFrame) -> DataFrame:
        found = None
        for n in range(samples):
            part = on_rewrites(scorer, cache, n, strict)(pairs).select("query", "pos", "score")
            found = part if found is None else found.unionByName(part)
        return pairs.join(found.groupBy("query", "pos").agg(F.avg("score").alias("score")), ["query", "pos"])

    return score
