"""Lexical scorers: BM25, TF-IDF cosine and set overlap, for all queries in one plan.

Inputs: queries (query, tokens array) and candidates (query, doc, tokens array). The corpus of a query is its candidate list.
A caller that deals the texts by `query` before they are split (`repartition("query")`) pays one exchange of texts, and no token
is shuffled. Lists too long for a task are dealt by (query, doc): the same plan then shuffles counts by (query, token).
Tokens are exploded by explode_outer, since explode adds a filter on the array's size, which splits every text once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _asked(queries: DataFrame) -> DataFrame:
    """(query, token, times)"""
    return queries.select("query", F.explode_outer("tokens").alias("token")).where(F.col("token").isNotNull()).groupBy("query", "token").agg(F.count("*").alias("times"))


def bm25(queries: DataFrame, candidates: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query, doc, score) by Okapi BM25; a negative idf becomes epsilon times the mean idf of the query's vocabulary, and a
    token counts as often as the query has it. Candidates without a shared token score 0."""
    # a null token in every document: its row counts the documents and their lengths
    marked = F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))
    counted = candidates.select("query", F.size("tokens").alias("len"), F.explode_outer(marked).alias("token")).groupBy("query", "token").agg(F.count("*").alias("df"), F.sum("len").alias("total"))
    own, whole = Window.partitionBy("query"), F.col("token").isNull()
    n_docs = F.max(F.when(whole, F.col("df"))).over(own)
    avg_len = F.max(F.when(whole, F.col("total") / F.col("df"))).over(own)
    idf = F.when(~whole, F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    terms = counted.join(_asked(queries), ["query", "token"], "left").withColumns({"n_docs": n_docs, "avg_len": avg_len}).withColumn("idf", idf)
    lists = terms.groupBy("query").agg(F.avg("idf").alias("mean_idf"), F.max("avg_len").alias("avg_len"), F.collect_list(F.when(F.col("times").isNotNull(), F.struct("token", "times", "idf"))).alias("terms"))
    raised = F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf"))
    weight = lists.select("query", "mean_idf", "avg_len", F.inline("terms")).select("query", "token", "avg_len", (F.col("times") * raised).alias("w"))
    tf = candidates.select("query", "doc", F.size("tokens").alias("len"), F.explode_outer("tokens").alias("token")).join(weight, ["query", "token"]).groupBy("query", "doc", "len", "avg_len", "token", "w").agg(F.count("*").alias("tf"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scores = tf.groupBy("query", "doc").agg(F.sum(part).alias("score"))
    return candidates.select("query", "doc").join(scores, ["query", "doc"], "left").select("query", "doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def tfidf(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, doc, score) by cosine of tf-idf vectors with smooth idf ln((1 + n) / (1 + df)) + 1, fitted on the candidates;
    query tokens outside their vocabulary are left out."""
    corpus = candidates.groupBy("query").agg(F.count("*").alias("n_docs"))
    tf = candidates.select("query", "doc", F.explode_outer("tokens").alias("token")).groupBy("query", "doc", "token").agg(F.count("*").alias("tf"))
    idf = F.when(F.col("token").isNotNull(), F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1)
    terms = tf.withColumn("df", F.count("*").over(Window.partitionBy("query", "token"))).join(corpus, "query").withColumn("idf", idf)
    both = terms.join(_asked(queries), ["query", "token"], "left").select("query", "doc", "df", (F.col("tf") * F.col("idf")).alias("w"), (F.col("times") * F.col("idf")).alias("qw"))
    # a query's term stands in the rows of df documents, so a share of its square in each adds up to one square
    sums = both.groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("d_square"), F.sum(F.col("qw") * F.col("qw") / F.col("df")).alias("q_part"))
    q_square = F.sum("q_part").over(Window.partitionBy("query"))
    return sums.withColumn("q_square", q_square).select("query", "doc", F.coalesce(F.col("dot") / F.sqrt("d_square") / F.sqrt("q_square"), F.lit(0.0)).alias("score"))


def overlap(queries: DataFrame, candidates: DataFrame, empty: float = 0.0) -> DataFrame:
    """(query, doc, score) by set overlap; each list's distinct tokens are found once and met once."""
    asked = queries.select("query", F.array_distinct("tokens").alias("q_set"))
    sets = candidates.select("query", "doc", F.array_distinct("tokens").alias("d_set")).join(asked, "query")
    shared = sets.select("query", "doc", (F.size("q_set") + F.size("d_set")).alias("sizes"), F.size(F.array_intersect("q_set", "d_set")).alias("common"))
    score = F.when(F.col("sizes") == 0, F.lit(empty)).otherwise(F.col("common") / (F.col("sizes") - F.col("common")))
    return shared.select("query", "doc", score.alias("score"))
