"""Queries on correlations, bootstrap intervals, fronts, copies and composition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.portable import sql_hash
from ..operators import ranking as R
from ..operators import statistics as A
from ..sources.tables import load
from .common import JUDGMENTS, judgments, query, rounded
from .ranking import _NDCG


@query("""with s as (select s_suppkey, s_nationkey as g, s_acctbal as a, round(sum(l_extendedprice), 2) as b from supplier join lineitem on s_suppkey = l_suppkey group by 1, 2, 3),
r as (select g, a, b, rank() over (partition by g order by a) + (count(*) over (partition by g, a) - 1) / 2.0 as ra, rank() over (partition by g order by b) + (count(*) over (partition by g, b) - 1) / 2.0 as rb from s)
select g, case when isfinite(corr(a, b)) then round(corr(a, b), 6) end as pearson, case when isfinite(corr(ra, rb)) then round(corr(ra, rb), 6) end as spearman, count(*)::bigint as n from r group by 1""")
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson and Spearman of suppliers' balance and revenue, by nation; null where a side is constant."""
    sums = load(spark, sf, "lineitem", ["l_suppkey", "l_extendedprice"]).groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("b"))
    rows = load(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).join(sums, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("a"), "b")
    found = A.spearman(rows, "a", "b", ["g"])
    return found.select("g", *[F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c) for c in ("pearson", "spearman")], "n")


@query(f"""with {JUDGMENTS}, p as (select x.query, sign(x.score - y.score) as da, sign(x.relevance - y.relevance) as db from j x join j y on x.query = y.query and x.pos < y.pos),
s as (select query, sum((da * db < 0)::int)::bigint as inversions, sum((da * db > 0)::int) as c, sum((da = 0)::int) as ta, sum((db = 0)::int) as tb, count(*)::bigint as pairs from p group by 1)
select query, inversions, pairs, round(case when (c + inversions + ta) * (c + inversions + tb) > 0 then (c - inversions) / sqrt(((c + inversions + ta) * (c + inversions + tb))::double) end, 6) as tau from s""")
def inversions_and_tau(spark: SparkSession, sf: str) -> DataFrame:
    """Inversions and tau-b of scores against relevance, over the pairs of each query's (bounded) candidate list."""
    return rounded(A.pair_statistics(judgments(spark, sf), "query", "pos", "score", "relevance"), "tau")


#: As many resamples as the operator that this query stands for.
_REPS = 10_000


@query(f"""with {_NDCG}, s as (select query, round(case when sum(case when irk <= 10 then (pow(2, relevance) - 1) / log2(irk + 1) else 0 end) = 0 then 0 else
  sum(case when rk <= 10 then (pow(2, relevance) - 1) / log2(rk + 1) else 0 end) / sum(case when irk <= 10 then (pow(2, relevance) - 1) / log2(irk + 1) else 0 end) end, 9) as v from r group by 1),
d as (select 'b' || (query % 5) as g, query, v from s union all select 'all', query, v from s), i as materialized (select g, row_number() over (partition by g order by query) - 1 as idx, v from d),
z as (select g, count(*) as size, case when g = 'all' then count(*) else 300 end as k from i group by 1), e as (select g, size, rep, unnest(range(k)) as draw from z, range({_REPS}) t(rep)),
m as (select e.g, rep, avg(v) as m from e join i on e.g = i.g and i.idx = {sql_hash("'42411|' || e.g || '|' || rep || '|' || draw")} % size group by 1, 2),
q as (select g, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by 1) select q.g, round(avg(v), 6) as mean, round(any_value(lo), 6) as lo, round(any_value(hi), 6) as hi from q join i on q.g = i.g group by 1""")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile intervals of the mean nDCG: 300 draws a branch and as many as there are queries overall."""
    scores = rounded(R.ndcg(judgments(spark, sf)), "ndcg", digits=9)
    branch = F.concat(F.lit("b"), (F.col("query") % 5).cast("string"))
    rows = scores.select(F.explode(F.array(branch, F.lit("all"))).alias("g"), "query", F.col("ndcg").alias("v"))
    indexed = rows.withColumn("idx", (F.row_number().over(Window.partitionBy("g").orderBy("query")) - 1).cast("long")).select("g", "idx", "v")
    return rounded(A.bootstrap(indexed, "g", "v", {"all": None} | {f"b{i}": 300 for i in range(5)}, _REPS, "42411"), "mean", "lo", "hi")


@query("""with s as (select s_suppkey, s_nationkey as cls, round(s_acctbal / 50) as cost, count(*)::bigint as score from supplier join lineitem on s_suppkey = l_suppkey group by 1, 2, 3)
select s_suppkey, not exists (select 1 from s t where t.cls = s.cls and t.cost <= s.cost and t.score >= s.score and (t.cost < s.cost or t.score > s.score)) as frontier from s""")
def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "lineitem", ["l_suppkey"]).groupBy("l_suppkey").agg(F.count("*").alias("score"))
    rows = load(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).join(counts, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", F.col("s_nationkey").alias("cls"), F.round(F.col("s_acctbal") / 50).alias("cost"), "score")
    return A.pareto(rows, "cls", "cost", "score").select("s_suppkey", "frontier")


@query("select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(stddev_samp(value), 6) as std, count(*)::bigint as n from events group by 1")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events", ["event_type", "value"])
    return rounded(rows.groupBy("event_type").agg(F.avg("value").alias("mean"), F.expr("percentile(value, 0.5)").alias("median"), F.stddev_samp("value").alias("std"), F.count("*").alias("n")), "mean", "median", "std")


@query(f"""with {JUDGMENTS}, o as (select query, max_by(pos, relevance * 1e15 - pos) as own from j group by 1), s as (select j.query, max(case when pos = own then score end) as own_score from j join o on j.query = o.query group by 1)
select j.query, (1 + sum(case when score > own_score and pos <> own then 1 else 0 end))::bigint as rank from j join o on j.query = o.query join s on s.query = j.query group by 1""".replace("max_by(pos, relevance * 1e15 - pos)", "arg_min(pos, struct_pack(r := -relevance, p := pos))"))
def dedup_rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of a query's own copy among its candidates: one more than those strictly better; ties do not lower it."""
    j = judgments(spark, sf)
    own = j.groupBy("query").agg(F.min_by(F.struct("pos", "score"), F.struct((-F.col("relevance")).alias("r"), "pos")).alias("own"))
    return j.join(own, "query").groupBy("query").agg((1 + F.sum(F.when((F.col("score") > F.col("own.score")) & (F.col("pos") != F.col("own.pos")), 1).otherwise(0))).alias("rank"))


@query("select d.doc_id, f.first from documents d join (select text, min(doc_id) as first from documents group by 1) f using (text)")
def self_match_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where each text is found first."""
    docs = load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("first")), "h").select("doc_id", "first")


@query("with u as (select text, min(doc_id) as a, count(*)::bigint as copies from documents group by 1), n as (select count(*) as n, count(distinct text) as t from documents) select a as doc_id, copies, (select n = t from n) as permutation from u")
def align_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """Whether texts are unique keys, and each key's first row and copies."""
    keys = load(spark, sf, "documents", ["doc_id", "text"]).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    most = keys.agg((F.max("copies") == 1).alias("permutation"))
    return keys.join(F.broadcast(most)).select("doc_id", "copies", "permutation")  # most is one row


@query("""with d as (select doc_id, list_distinct([lang, case when length(text) % 2 = 0 then lang else source end]) as domains, list_distinct([source]) as topics from documents),
x as (select doc_id, unnest(domains) as domain, 1.0 / len(domains) as w, topics from d), y as (select domain, unnest(topics) as topic, w / len(topics) as w from x) select domain, topic, round(sum(w)::double, 6) as w, count(*)::bigint as n from y group by 1, 2""")
def weighted_topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A document's weight is parted equally over its domains, then over its topics."""
    docs = load(spark, sf, "documents", ["lang", "source", "text"]).select(F.array_distinct(F.array("lang", F.when(F.length("text") % 2 == 0, F.col("lang")).otherwise(F.col("source")))).alias("domains"), F.array_distinct(F.array("source")).alias("topics"))
    each = docs.select(F.explode("domains").alias("domain"), (1.0 / F.size("domains")).alias("w"), "topics").select("domain", F.explode("topics").alias("topic"), (F.col("w") / F.size("topics")).alias("w"))
    return rounded(each.groupBy("domain", "topic").agg(F.sum("w").alias("w"), F.count("*").alias("n")), "w")


@query("""select g, round(sum((2 * n - m) * 0.5 / 1e6), 9) as cost, sum(n)::bigint as tokens from (select role as g, length(text) as n, length(text) - 1 as m from conversations) group by grouping sets ((g), ())""".replace("(2 * n - m) * 0.5 / 1e6", "(0.5 * n + 2.0 * m) / 1e6"))
def cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Reading and writing costs by role and overall."""
    rows = load(spark, sf, "conversations", ["role", "text"]).select(F.col("role").alias("g"), F.length("text").alias("n"))
    return rounded(rows.rollup("g").agg(F.sum((0.5 * F.col("n") + 2.0 * (F.col("n") - 1)) / 1e6).alias("cost"), F.sum("n").alias("tokens")), "cost", digits=9)


@query("""select l_orderkey from lineitem group by 1 having count(distinct l_linestatus) = 1""")
def unanimous_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose lines all have one status: samples graded once or alike."""
    rows = load(spark, sf, "lineitem", ["l_orderkey", "l_linestatus"]).groupBy("l_orderkey").agg(F.collect_list("l_linestatus").alias("grading"))
    return rows.where(F.size(F.array_distinct("grading")) == 1).select("l_orderkey")


@query("""select conv_id, turn as attempt, role, length(text)::bigint as n from conversations""")
def attempts_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Nested attempts become a row each, with their parent's fields."""
    nested = load(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("attempts"))
    return nested.select("conv_id", F.explode("attempts").alias("a")).select("conv_id", F.col("a.turn").alias("attempt"), F.col("a.role").alias("role"), F.length("a.text").cast("long").alias("n"))


@query("""select conv_id, array_to_string(list(role || ':' || length(text) order by turn), ' ') as chat from conversations group by 1""")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of a row in order."""
    rows = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(":"), F.length("text").cast("string")).alias("m")))).alias("z"))
    return rows.select("conv_id", F.array_join(F.transform("z", lambda x: x["m"]), " ").alias("chat"))


@query("""with g as (select doc_id, quality, toxic from labels), d as (select lang, d.doc_id, quality, toxic from documents d join g using (doc_id)) select lang, bool_and(quality = 1 or toxic = 1) as all_ok, count(*)::bigint as n from d group by 1""")
def universal_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a condition holds for all candidates of a target."""
    docs = load(spark, sf, "documents", ["doc_id", "lang"]).join(load(spark, sf, "labels"), "doc_id")
    return docs.groupBy("lang").agg(F.bool_and((F.col("quality") == 1) | (F.col("toxic") == 1)).alias("all_ok"), F.count("*").alias("n"))
