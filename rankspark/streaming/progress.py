"""Progress of long runs: work is taken a bounded number of items at a time, and the aggregates so far are written after each step.

Items are written once, `every` rows a file, and read as a stream of so many files a trigger. The aggregation is the stream's state, so a
step costs its own items and the groups, not what was done before; after a failure the run goes on at the step that was lost,
whose partial result is written anew. The last partial result is the whole one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..evaluation import per_query, report

#: Steps that a run has at most: a step has a cost of its own (a plan, its tasks' reports, a meeting with all documents), so that steps which
#: grew with the items would cost their square.
STEPS = 16


def written_items(items: DataFrame, folder: str, every: int) -> str:
    """items as files of at most `every` rows."""
    items.write.option("maxRecordsPerFile", every).parquet(f"{folder}/items")
    return f"{folder}/items"


def files_a_step(spark: SparkSession, items: str, files: int) -> int:
    """`files`, or more where written_items() would take over STEPS steps. The same for every run over the same items."""
    return max(files, -(-len(spark.read.parquet(items).inputFiles()) // STEPS))


def run_with_progress(spark: SparkSession, items: str, aggregate: Callable[[DataFrame], DataFrame], folder: str, files: int = 1, on_progress: Callable[[int], None] | None = None) -> StreamingQuery:
    """Aggregates written_items() step by step, so many files each or more by files_a_step(), into folder/partials/step=n, and tells
    on_progress each step that is written. aggregate may score its rows before it groups them. A run with the same folder goes on where the last one stopped."""
    kinds = spark.read.parquet(items).schema
    found = aggregate(spark.readStream.schema(kinds).option("maxFilesPerTrigger", files_a_step(spark, items, files)).parquet(items))

    def write(partial: DataFrame, step: int) -> None:
        partial.write.mode("overwrite").parquet(f"{folder}/partials/step={step}")
        if on_progress:
            on_progress(step)

    return found.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def partials(spark: SparkSession, folder: str) -> DataFrame:
    """All partial results, with step."""
    return spark.read.parquet(f"{folder}/partials")


def whole(spark: SparkSession, folder: str) -> DataFrame:
    """The last partial result."""
    found = partials(spark, folder)
    last = found.agg(F.max("step")).first()[0]
    return found.where(F.col("step") == F.lit(last)).drop("step")


def evaluate_in_steps(items: str, documents: DataFrame, model: str | object, folder: str, branches: list[str] | None = None, files: int = 1, on_progress: Callable[[int, DataFrame], None] | None = None, **how) -> DataFrame:
    """evaluate() over written_items() of queries, so many files a step, or more by files_a_step(). A step's scores are written to folder/scores/step=n
    before on_progress gets its number and the report so far; a run with the same folder goes on at the step that was lost, whose
    scores are written anew. Gives the report of all steps; without queries it has no row. how: per_query()'s other options."""
    spark = documents.sparkSession
    kinds = spark.read.parquet(items).schema
    scores = spark.createDataFrame([], "task string, query long, ndcg double, step int")

    def so_far() -> DataFrame:
        return report(spark.read.schema(scores.schema).parquet(f"{folder}/scores").drop("step"), spark.read.parquet(items), branches)

    def write(batch: DataFrame, step: int) -> None:
        found = per_query(batch, documents, model, **how).select("task", F.col("query").cast("long").alias("query"), "ndcg")
        found.write.mode("overwrite").parquet(f"{folder}/scores/step={step}")
        if on_progress:
            on_progress(step, so_far())

    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", files_a_step(spark, items, files)).parquet(items)
    source.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/steps").trigger(availableNow=True).start().awaitTermination()
    scores.drop("step").write.mode("overwrite").parquet(f"{folder}/scores/step=-1")
    return so_far()
