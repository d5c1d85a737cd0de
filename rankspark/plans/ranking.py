"""Queries on gains, ranks and top-k."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import vector as V
from ..sources.tables import load
from .common import JUDGMENTS, judgments, query, rounded


def _close(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.maximum(0, 5 - np.abs(own - other)).astype(np.float64)


@query("""with p as (select q.vec_id as query, d.vec_id as pos, list_cosine_similarity(q.embedding::double[], d.embedding::double[]) as score,
  greatest(0, 5 - abs(q.label - d.label))::double as rel from embeddings q, embeddings d where q.vec_id % 100 = 0 and q.vec_id <> d.vec_id),
r as (select *, row_number() over (partition by query order by score desc, pos) as rk, row_number() over (partition by query order by rel desc, pos) as irk from p)
select query, round(sum(case when rk <= 10 then (pow(2, rel) - 1) / log2(rk + 1) else 0 end) / sum(case when irk <= 10 then (pow(2, rel) - 1) / log2(irk + 1) else 0 end), 9) as ndcg from r group by 1""")
def ndcg_at_10_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the vectors with an id divisible by 100, candidates all others; relevance is 5 less the labels' distance."""
    rows = load(spark, sf, "embeddings")
    found = V.search(rows.where("vec_id % 100 = 0"), rows, 10, extra="label", extra_score=_close)
    return rounded(R.ndcg(found.select("query", F.col("id").alias("pos"), "score", F.col("extra").alias("relevance"))), "ndcg", digits=9)


_NDCG = JUDGMENTS + """, r as (select *, row_number() over (partition by query order by score desc, pos) as rk,
  row_number() over (partition by query order by relevance desc, pos) as irk from j)"""


def _ndcg_sql(gain: str) -> str:
    return f"""with {_NDCG}, s as (select query, sum(case when rk <= 10 then {gain} / log2(rk + 1) else 0 end) as dcg,
  sum(case when irk <= 10 then {gain} / log2(irk + 1) else 0 end) as ideal from r group by 1)
select query, round(case when ideal = 0 then 0 else dcg / ideal end, 9) as ndcg from s"""


@query(_ndcg_sql("(pow(2, relevance) - 1)"))
def ndcg_exponential_gain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.ndcg(judgments(spark, sf)), "ndcg", digits=9)


@query(_ndcg_sql("relevance"))
def ndcg_linear_gain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.ndcg(judgments(spark, sf), variant="linear"), "ndcg", digits=9)


@query(_ndcg_sql("(pow(2, relevance * 0.6) - 1)"))
def ndcg_scaled_gain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.ndcg(judgments(spark, sf), scale=0.6), "ndcg", digits=9)


@query(f"""with {_NDCG}, s as (select query, case when sum(case when irk <= 10 then (pow(2, relevance) - 1) / log2(irk + 1) else 0 end) = 0 then 0 else
  sum(case when rk <= 10 then (pow(2, relevance) - 1) / log2(rk + 1) else 0 end) / sum(case when irk <= 10 then (pow(2, relevance) - 1) / log2(irk + 1) else 0 end) end as ndcg from r group by 1),
d as (select query, unnest(list_distinct(list_concat(list(l_returnflag), list(l_linestatus)))) as branch from j group by 1),
b as (select branch, ndcg from d join s using (query) union all select null, ndcg from s)
select k.branch, coalesce(round(avg(ndcg), 9), 0) as mean, count(ndcg)::bigint as n
from (select unnest(['A', 'F', 'N', 'O', 'R', 'none', null]) as branch) k left join b on k.branch is not distinct from b.branch group by 1""")
def ndcg_by_branch(spark: SparkSession, sf: str) -> DataFrame:
    """Means overall and by domain (a query counts in each of its domains; a domain without queries has 0)."""
    j = judgments(spark, sf)
    domains = j.groupBy("query").agg(F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus")).alias("domains"))
    means = R.branch_means(R.ndcg(j).join(domains, "query"))
    return rounded(R.with_all_branches(means, ["A", "F", "N", "O", "R", "none"]), "mean", digits=9)


@query(f"""with {JUDGMENTS}, a as (select *, rank() over (partition by query order by relevance) + (count(*) over (partition by query, relevance) - 1) / 2.0 as t from j),
r as (select *, row_number() over (partition by query order by score desc, pos) as rk, row_number() over (partition by query order by t desc, pos) as irk from a)
select query, round(sum(case when rk <= 10 then t / log2(rk + 1) else 0 end) / sum(case when irk <= 10 then t / log2(irk + 1) else 0 end), 9) as ndcg from r group by 1""")
def ndcg_rank_transform(spark: SparkSession, sf: str) -> DataFrame:
    """nDCG with linear gain over average ranks of relevance."""
    j = R.average_rank(judgments(spark, sf), "relevance", ["query"], out="t")
    return rounded(R.ndcg(j.drop("relevance").withColumnRenamed("t", "relevance"), variant="linear"), "ndcg", digits=9)


@query(f"with {JUDGMENTS} select query, pos, rank() over (partition by query order by relevance desc)::bigint as rank from j")
def competition_rank(spark: SparkSession, sf: str) -> DataFrame:
    return R.competition_rank(judgments(spark, sf), ["query"], "relevance").select("query", "pos", F.col("rank").cast("long").alias("rank"))


@query("""select s_suppkey, rank() over (order by round(s_acctbal / 100) desc) + (count(*) over (partition by round(s_acctbal / 100)) - 1) / 2.0::double as avg_rank from supplier""")
def average_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "supplier", ["s_suppkey", "s_acctbal"]).withColumn("v", F.round(F.col("s_acctbal") / 100))
    return R.average_rank(rows, "v", ascending=False).select("s_suppkey", F.col("avg_rank").cast("double").alias("avg_rank"))


@query(f"""with {JUDGMENTS}, r as (select *, row_number() over (partition by query order by relevance desc, pos) as rk from j) select query, pos, relevance, rk::bigint as rk from r where rk <= 3""")
def topk_stable(spark: SparkSession, sf: str) -> DataFrame:
    found = R.top_k_stable(judgments(spark, sf).select("query", "pos", "relevance"), 3, by="relevance")
    return found.select("query", "pos", "relevance", F.col("rk").cast("long").alias("rk"))


@query(f"""with {JUDGMENTS}, r as (select *, row_number() over (partition by query order by relevance desc, pos desc) as rk, count(*) over (partition by query) as n from j)
select query, least(n, 5) - rk + 1 as place, pos as id, relevance as score from r where rk <= 5""")
def top5_tuple_order(spark: SparkSession, sf: str) -> DataFrame:
    """The last five (score, id) tuples in ascending order: a tie goes to the larger id."""
    lists = judgments(spark, sf).groupBy("query").agg(F.collect_list(F.struct("relevance", "pos")).alias("z"))
    found = lists.select("query", R.top_tuples(F.col("z.relevance"), F.col("z.pos"), 5).alias("t")).select("query", F.posexplode("t").alias("at", "x"))
    return found.select("query", (F.col("at") + 1).cast("long").alias("place"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


@query("""with c as (select p_brand, p_type, sum(p_retailprice) as w from part group by 1, 2), r as (select *, row_number() over (partition by p_brand order by w desc, p_type) as rn from c)
select p_brand, case when rn <= 3 or p_type = 'ECONOMY' then p_type else 'Other' end as p_type, round(sum(w), 4) as w from r group by 1, 2""")
def topk_plus_other(spark: SparkSession, sf: str) -> DataFrame:
    sums = load(spark, sf, "part", ["p_brand", "p_type", "p_retailprice"]).groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("w"))
    return rounded(R.top_with_other(sums, "p_brand", "p_type", "w", 4, ["ECONOMY"]), "w", digits=4)


@query(f"""with {JUDGMENTS}, r as (select *, case when relevance >= 4 then 'both' when relevance >= 2 then 'summary' else 'ontology' end as bucket from j)
select query, pos, bucket, round(sum(score) over (partition by query, bucket order by pos rows unbounded preceding) / sum(score) over (partition by query, bucket), 9) as cdf from r""")
def signal_cdf(spark: SparkSession, sf: str) -> DataFrame:
    """Running share of each bucket's weight within a query, in candidate order."""
    bucket = F.when(F.col("relevance") >= 4, "both").when(F.col("relevance") >= 2, "summary").otherwise("ontology")
    rows = judgments(spark, sf).withColumn("bucket", bucket).withColumn("g", F.struct("query", "bucket"))
    return rounded(R.cumulative_share(rows, "g", ["pos"], "score").select("query", "pos", "bucket", "cdf"), "cdf", digits=9)


_SUMMARY = """avg(v) as avg_rank, quantile_cont(v, 0.5) as median_rank, avg(case when v <= p95 then v end) as trimmed_mean_rank_95, quantile_cont(v, 0.9) as p90_rank,
 quantile_cont(v, 0.99) as p99_rank, max(v) as max_rank, """ + ", ".join(f"avg(case when v <= {t} then 1.0 else 0.0 end) as top_{t}" for t in (1, 2, 4, 8, 16, 32, 64, 128)) + ", count(*)::bigint as n"


@query(f"""with {JUDGMENTS}, k as (select query, l_returnflag, rank() over (partition by query order by score desc)::bigint as v from j),
c as (select l_returnflag, quantile_cont(v, 0.95) as p95 from k group by 1), s as (select l_returnflag, {_SUMMARY} from k join c using (l_returnflag) group by 1)
select l_returnflag, round(avg_rank, 6) as avg_rank, round(median_rank, 6) as median_rank, round(trimmed_mean_rank_95, 6) as trimmed_mean_rank_95, round(p90_rank, 6) as p90_rank, round(p99_rank, 6) as p99_rank, max_rank,
 {", ".join(f"round(top_{t}::double, 6) as top_{t}" for t in (1, 2, 4, 8, 16, 32, 64, 128))}, n from s""")
def rank_summary(spark: SparkSession, sf: str) -> DataFrame:
    ranks = R.competition_rank(judgments(spark, sf), ["query"], "score").withColumn("rank", F.col("rank").cast("long"))
    found = R.rank_summary(ranks, by=["l_returnflag"])
    return rounded(found, *[c for c in found.columns if c not in ("l_returnflag", "max_rank", "n")])


@query("""select vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) as length, round(v[1], 6) as first from (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings)""")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings").select("vec_id", V.normalise(F.col("embedding")).alias("v"))
    return rounded(rows.select("vec_id", V.dot(F.col("v"), F.col("v")).alias("length"), F.get("v", F.lit(0)).alias("first")), "length", "first")


@query("""with x as (select label, generate_subscripts(embedding, 1) as dim, unnest(embedding)::double as x from embeddings) select label, dim::bigint as dim, round(avg(x), 6) as x from x group by 1, 2""")
def chunk_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one owner (chunks of a text) become their mean, dimension by dimension."""
    pooled = V.mean_pool(load(spark, sf, "embeddings"), "label", "embedding")
    return rounded(pooled.select("label", F.posexplode("embedding").alias("d", "x")).select("label", (F.col("d") + 1).cast("long").alias("dim"), "x"), "x")


@query("""with x as (select label, generate_subscripts(embedding, 1) as dim, unnest(embedding)::double as x from embeddings), m as (select label, dim, avg(x) as x from x group by 1, 2),
c as (select label, list(x order by dim) as v from m group by 1) select e.vec_id, round(list_cosine_similarity(c.v, e.embedding::double[]), 6) as score from embeddings e join c using (label)""")
def rewrite_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    """A query's rewrites are pooled without new normalisation, then compared with its candidates by cosine."""
    rows = load(spark, sf, "embeddings")
    pooled = V.mean_pool(rows, "label", "embedding").withColumnRenamed("embedding", "q")
    return rounded(rows.join(pooled, "label").select("vec_id", V.cosine(F.col("q"), F.col("embedding")).alias("score")), "score")


@query("""with q as (select label, min(vec_id) as query from embeddings group by 1), p as (select e.vec_id, qe.embedding::double[] as a, e.embedding::double[] as b from embeddings e join q using (label) join embeddings qe on qe.vec_id = q.query),
t as (select vec_id, i, max(list_dot_product(a[8 * i + 1 : 8 * i + 8], b[8 * k + 1 : 8 * k + 8])) as best from p, range(8) r(i), range(8) s(k) group by 1, 2) select vec_id, round(sum(best), 6) as score from t group by 1""")
def maxsim_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Late interaction: vectors are eight token vectors of eight numbers; a label's first vector is the query of its rows."""
    def tokens(v: str):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, F.lit(8)))

    rows = load(spark, sf, "embeddings")
    firsts = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).select(F.col("label").alias("pair"), tokens("e").alias("q_vecs"))
    return rounded(V.maxsim(firsts, rows.select(F.col("label").alias("pair"), "vec_id", tokens("embedding").alias("d_vecs"))).select("vec_id", "score"), "score")


@query("""select event_id, round(case when a + b = 0 then 0.5 else a / (a + b) end, 9) as score from (select event_id, exp(coalesce(-value / 100, -10000)) as a, exp(case when event_type = 'error' then -10000 else -(100 - value) / 100 end) as b from events)""")
def logprob_pair_score(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax of two log-probabilities; a missing one is -10000; 0/0 is 0.5."""
    yes = F.exp(F.coalesce(-F.col("value") / 100, F.lit(-10000.0)))
    no = F.exp(F.coalesce(F.when(F.col("event_type") != "error", -(100 - F.col("value")) / 100), F.lit(-10000.0)))
    rows = load(spark, sf, "events", ["event_id", "event_type", "value"]).select("event_id", yes.alias("a"), no.alias("b"))
    return rounded(rows.select("event_id", F.when(F.col("a") + F.col("b") == 0, 0.5).otherwise(F.col("a") / (F.col("a") + F.col("b"))).alias("score")), "score", digits=9)


@query("""with e as (select *, row_number() over (partition by event_type order by value desc, event_id) as rn, sum(value) over (partition by event_type) as total from events) select event_type, user_id, round(max_by(value, event_id), 6) as last_value, count(*)::bigint as n from events group by 1, 2""")
def last_value_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Keep-last upsert: of the rows of a key the one of the largest version."""
    rows = load(spark, sf, "events", ["event_type", "user_id", "value", "event_id"])
    return rounded(rows.groupBy("event_type", "user_id").agg(F.max_by("value", "event_id").alias("last_value"), F.count("*").alias("n")), "last_value")


@query("""with c as (select lang, source, count(*) as n from documents group by 1, 2), s as (select *, n::double / sum(n) over (partition by lang) as share, row_number() over (partition by lang order by n desc, source) as rn, max(n) over (partition by lang) as top from c)
select lang, source, round(share, 9) as share from s where share >= 0.06 or (rn = 1 and lang not in (select lang from s where share >= 0.06))""")
def prevailing_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with at least the threshold's share, or else the largest one."""
    counts = load(spark, sf, "documents", ["lang", "source"]).groupBy("lang", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    shared = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "source"))).withColumn("best", F.max("share").over(w))
    return rounded(shared.where("share >= 0.06 or (rn = 1 and best < 0.06)").select("lang", "source", "share"), "share", digits=9)
