"""Queries on replays, corpus ranks, labels and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as B
from ..functions.text import jaccard, whitespace_tokens
from ..operators import replay as P
from ..operators.statistics import pair_statistics
from ..sources.tables import load
from .common import judgments, query, rounded
from .ranking import _NDCG


@query(f"""with {_NDCG}, v as (select 'exp3' as variant, query, rk, irk, pow(2, relevance * 0.6) - 1 as g from r union all select 'exp5', query, rk, irk, pow(2, relevance) - 1 from r union all select 'lin5', query, rk, irk, relevance from r),
s as (select variant, query, sum(case when rk <= 10 then g / log2(rk + 1) else 0 end) as dcg, sum(case when irk <= 10 then g / log2(irk + 1) else 0 end) as ideal from v group by 1, 2)
select variant, query, round(case when ideal = 0 then 0 else dcg / ideal end, 9) as ndcg from s""")
def rescore_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rankings under three gains."""
    return rounded(P.rescore(judgments(spark, sf), [("exp3", "exponential", 0.6), ("exp5", "exponential", 1.0), ("lin5", "linear", 1.0)]), "ndcg", digits=9)


@query("""with q as (select item_id as query, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as a from benchmark), d as (select doc_id as doc, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as b from documents),
h as (select query, doc, count(*) as n from (select query, unnest(a) as t from q) join (select doc, unnest(b) as t from d) using (t) group by 1, 2), s as (select h.query, h.doc, n::double / (len(a) + len(b) - n) as score from h join q on q.query = h.query join d on d.doc = h.doc),
o as (select query, max(score) filter (where doc % 10 = query % 10) as own from s group by 1) select s.query, (1 + sum(case when score > own then 1 else 0 end))::bigint as rank from s join o using (query) where own is not null group by 1""")
def dedup_rank_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Each item's overlap with all documents that share a token, and the rank of its best document of the same last digit."""
    def tokens(name: str, column: str) -> DataFrame:
        return load(spark, sf, name).select(F.col(column).alias("id"), F.array_distinct(whitespace_tokens(F.col("text"))).alias("t"))

    q, d = tokens("benchmark", "item_id"), tokens("documents", "doc_id")
    asked = q.select(F.col("id").alias("query"), F.size("t").alias("nq"), F.explode("t").alias("w"))
    held = d.select(F.col("id").alias("doc"), F.size("t").alias("nd"), F.explode("t").alias("w"))
    scores = held.join(asked, "w").groupBy("query", "doc", "nq", "nd").agg(F.count("*").alias("n")).select("query", "doc", (F.col("n") / (F.col("nq") + F.col("nd") - F.col("n"))).alias("score"))
    own = scores.where("doc % 10 = query % 10").groupBy("query").agg(F.max_by("doc", "score").alias("doc"))
    return P.own_rank(scores, own).select("query", "rank")


@query("""with s as (select o_orderkey, list_distinct(list(l_returnflag)) as a, list_distinct(list(l_linestatus)) as b from orders join lineitem on o_orderkey = l_orderkey group by 1) select o_orderkey, round(len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))), 6) as score from s""")
def grouped_set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus"]).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return rounded(rows.select("o_orderkey", jaccard(F.col("a"), F.col("b")).alias("score")), "score")


@query(r"""with x as (select doc_id, regexp_replace(text, '(?s)(\$\$.*?\$\$|\$[^$]*?\$|\\\(.*?\\\)|\\\[.*?\\\])', chr(1) || '\1' || chr(1), 'g') as m from documents), y as (select doc_id, string_split(m, chr(1)) as p from x)
select doc_id, len(list_filter(list_transform(range(len(p)), lambda i: case when i % 2 = 1 then p[i + 1] else '' end), lambda s: trim(s) <> ''))::bigint as n_math, md5(regexp_replace(array_to_string(p, ''), '[\x09-\x0D\x20]+', '', 'g')) as whole from y""")
def text_math_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Alternating text and math pieces, whose values give the text back but for blank ones."""
    rows = load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", "text", B.text_and_math(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size(F.filter("p", lambda x: x["kind"] == "math")).cast("long").alias("n_math"), F.md5(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["value"]), ""), r"[\x09-\x0D\x20]+", "")).alias("whole"))


@query("""select p_partkey, regexp_replace(p_type || 'Kind' || p_size, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') as label, case when p_size % 2 = 0 then p_type else p_brand end as topic from part""")
def label_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Spaced labels, and a tag's first component after the domain that says something."""
    tag = F.concat(F.lit("/World/dom/"), F.when(F.col("p_size") % 2 == 0, F.lit("General stuff/")).otherwise(F.lit("Other/")), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand")))
    return load(spark, sf, "part", ["p_partkey", "p_type", "p_brand", "p_size"]).select("p_partkey", B.spaced_label(F.concat("p_type", F.lit("Kind"), F.col("p_size").cast("string"))).alias("label"), B.topic(tag, "World", ["other"]).alias("topic"))


@query("""select conv_id, turn, case when role = 'assistant' then 3 else 2 end + 0 as n, case when turn % 2 = 0 then 'error' else 'assistant' end as last from conversations""")
def chat_building(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with a system text where there is one, and an answer or an error at the end."""
    chat = B.with_response(B.messages(F.when(F.col("role") == "assistant", "rules"), F.col("text")), F.when(F.col("turn") % 2 == 1, "yes"))
    rows = load(spark, sf, "conversations").select("conv_id", "turn", chat.alias("c"))
    return rows.select("conv_id", "turn", F.size("c").alias("n"), F.element_at("c", -1)["role"].alias("last"))


@query("""with s as (select s_nationkey as g, s_suppkey as i, s_acctbal as a, s_suppkey % 7 as b from supplier), p as (select x.g, sign(x.a - y.a) * sign(x.b - y.b) as d from s x join s y on x.g = y.g and x.i < y.i) select g, sum((d < 0)::int)::bigint as inversions, count(*)::bigint as pairs from p group by 1""")
def inversions_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("a"), (F.col("s_suppkey") % 7).alias("b"))
    return pair_statistics(rows, "g", "i", "a", "b").select("g", "inversions", "pairs")
