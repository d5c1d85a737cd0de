"""evaluate(): queries with candidate lists, documents and a scorer to nDCG by task and branch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.text import TASK_VIEWS, instructed, text_view
from .operators import ranking as R
from .operators.statistics import bootstrap
from .scorers import make_scorer
from .sources.tables import shared_folder


def judged_pairs(queries: DataFrame, documents: DataFrame, task: str, instruction: str | None = None) -> DataFrame:
    """queries (row_idx, problem, solution, domains, candidates, relevance_scores) and documents (row_idx, problem, solution)
    to pairs (query, pos, doc, relevance, query_text, doc_text) under a task's views. Lists of unequal length and
    candidates without a document raise."""
    if task not in TASK_VIEWS:
        raise ValueError(f"unknown task {task!r}")
    q_view, d_view = TASK_VIEWS[task]
    equal = F.when(F.size("candidates") != F.size("relevance_scores"), F.raise_error(F.lit("candidates and relevance_scores differ in length")).cast("array<struct<candidates:bigint,relevance_scores:double>>")).otherwise(F.arrays_zip("candidates", F.col("relevance_scores").cast("array<double>").alias("relevance_scores")))
    text = instructed(instruction, text_view(q_view, F.col("problem"), F.col("solution")))
    long = queries.select(F.col("row_idx").alias("query"), text.alias("query_text"), F.posexplode(equal).alias("pos", "z")).select("query", "query_text", "pos", F.col("z.candidates").alias("doc"), F.col("z.relevance_scores").alias("relevance"))
    docs = documents.select(F.col("row_idx").alias("doc"), text_view(d_view, F.col("problem"), F.col("solution")).alias("doc_text"))
    # a candidate without a document raises: without it the ideal gain would shrink
    found = long.join(docs.withColumn("_known", F.lit(True)), "doc", "left")
    lost = F.raise_error(F.concat(F.lit("no document "), F.coalesce(F.col("doc").cast("string"), F.lit("null")))).cast("boolean")
    return found.where(F.when(F.col("_known").isNull(), lost).otherwise(True)).drop("_known")


def evaluate(queries: DataFrame, documents: DataFrame, model: str | object, tasks: list[str] | None = None, k: int = 10, dcg_variant: str = "exponential", instruction: str | None = None, branches: list[str] | None = None, done: DataFrame | None = None, init_options: dict | None = None, options: dict | None = None) -> DataFrame:
    """(task, branch, mean, n): nDCG@k of each task, overall (null branch) and by domain. done (task, query, ndcg), if given,
    holds earlier results that are not scored again. init_options build a model's class, options go to each of its calls."""
    return report(per_query(queries, documents, model, tasks, k, dcg_variant, instruction, done, init_options, options), queries, branches)


def per_query(queries: DataFrame, documents: DataFrame, model: str | object, tasks: list[str] | None = None, k: int = 10, dcg_variant: str = "exponential", instruction: str | None = None, done: DataFrame | None = None, init_options: dict | None = None, options: dict | None = None) -> DataFrame:
    """(task, query, ndcg), null for queries that cannot be scored."""
    scorer = make_scorer(model, init_options, options)
    parts = []
    for task in tasks or list(TASK_VIEWS):
        todo = queries
        if done is not None:
            todo = queries.join(done.where(F.col("task") == task).select(F.col("query").alias("row_idx")), "row_idx", "left_anti")
        scored = scorer(judged_pairs(todo, documents, task, instruction))
        unscored = scored.groupBy("query").agg(F.max(F.col("score").isNull().cast("int")).alias("missing"))
        found = R.ndcg(scored.select("query", "pos", "score", "relevance"), k, dcg_variant).join(unscored, "query")
        parts.append(found.select(F.lit(task).alias("task"), "query", F.when(F.col("missing") == 0, F.col("ndcg")).alias("ndcg")))
    out = reduce(DataFrame.unionByName, parts)
    return out.unionByName(done.select("task", "query", "ndcg")) if done is not None else out


def report(scores: DataFrame, queries: DataFrame, branches: list[str] | None = None) -> DataFrame:
    """per_query() results to means by task and branch."""
    placed = scores.join(queries.select(F.col("row_idx").alias("query"), "domains"), "query")
    rows = placed.select("task", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("domains", F.array().cast("array<string>")))).alias("branch"), "ndcg")
    means = rows.groupBy("task", "branch").agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean"), F.count("ndcg").alias("n"))
    if not branches:
        return means
    grid = scores.select("task").distinct().select("task", F.explode(F.array(*[F.lit(b) for b in branches], F.lit(None).cast("string"))).alias("branch"))
    return grid.alias("g").join(means.alias("m"), (F.col("g.task") == F.col("m.task")) & F.col("g.branch").eqNullSafe(F.col("m.branch")), "left").select("g.task", "g.branch", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def confidence(queries: DataFrame, documents: DataFrame, model: str | object, task: str, branches: list[str], branch_draws: int = 300, reps: int = 10_000, seed: str = "42", k: int = 10, dcg_variant: str = "exponential", instruction: str | None = None) -> DataFrame:
    """(branch, mean, lo, hi): the model is scored anew, then resampled: branch_draws draws a branch, and as many as there are
    scored queries overall (branch "all"). Scores are written once; queries that cannot be scored are left out, and a
    branch without scores has no row."""
    place = shared_folder(queries.sparkSession, "scores")
    per_query(queries, documents, model, [task], k, dcg_variant, instruction).where(F.col("ndcg").isNotNull()).select("query", "ndcg").write.parquet(place)
    scores = queries.sparkSession.read.parquet(place).join(queries.select(F.col("row_idx").alias("query"), "domains"), "query")
    own = F.array_intersect(F.coalesce("domains", F.array().cast("array<string>")), F.array(*[F.lit(b) for b in branches]).cast("array<string>"))
    rows = scores.select(F.explode(F.concat(F.array(F.lit("all")), own)).alias("branch"), "query", F.col("ndcg").alias("v"))
    placed = rows.withColumn("idx", (F.row_number().over(Window.partitionBy("branch").orderBy("query")) - 1).cast("long")).select("branch", "idx", "v")
    return bootstrap(placed, "branch", "v", {"all": None} | dict.fromkeys(branches, branch_draws), reps, seed)
