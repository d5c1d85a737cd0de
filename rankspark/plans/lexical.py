"""Queries on lexical scorers, text views and parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.portable import portable_hash, sql_hash
from ..operators import lexical as L
from ..operators import lists as W
from ..operators.vector import sparse_dot
from ..sources.tables import load
from .common import query, rounded

_TOK = "list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> '')"


def _lists(spark: SparkSession, sf: str, dealt: bool = True) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as queries; every document is a candidate of the item that a hash of its id names. Texts are
    dealt by list before they are split, or stay where they are read."""
    items = load(spark, sf, "benchmark").select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("query"), X.whitespace_tokens(F.col("text")).alias("tokens"))
    n = items.count()
    docs = load(spark, sf, "documents", ["doc_id", "text"])
    lists = docs.select(F.pmod(portable_hash("list", F.col("doc_id")), F.lit(n)).cast("int").alias("query"), F.col("doc_id").alias("doc"), "text")
    lists = lists.repartition("query") if dealt else lists
    return items, lists.select("query", "doc", X.whitespace_tokens(F.col("text")).alias("tokens"))


_LISTS = f"""q as materialized (select row_number() over (order by item_id) - 1 as query, {_TOK.format("text")} as tokens from benchmark),
c as materialized (select {sql_hash("'list|' || doc_id")} % (select count(*) from benchmark) as query, doc_id as doc, {_TOK.format("text")} as tokens from documents),
corpus as (select query, count(*) as n_docs, avg(len(tokens)) as avg_len from c group by 1),
df as materialized (select query, token, count(*) as df from (select query, unnest(list_distinct(tokens)) as token from c) group by 1, 2),
qt as (select query, token, count(*) as times from (select query, unnest(tokens) as token from q) group by 1, 2),
tf as materialized (select query, doc, len, token, count(*) as tf from (select query, doc, len(tokens) as len, unnest(tokens) as token from c) group by 1, 2, 3, 4)"""


@query(f"""with {_LISTS}, i as (select df.query, token, ln(n_docs - df + 0.5) - ln(df + 0.5) as idf, avg_len from df join corpus using (query)),
m as (select query, avg(idf) as mean_idf from i group by 1), w as (select qt.query, qt.token, times, avg_len, case when idf < 0 then 0.25 * mean_idf else idf end as idf from qt join i on qt.query = i.query and qt.token = i.token join m on m.query = qt.query),
s as (select tf.query, tf.doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as score from tf join w on tf.query = w.query and tf.token = w.token group by 1, 2)
select c.query, c.doc, round(coalesce(score, 0), 6) as score from c left join s on c.query = s.query and c.doc = s.doc""")
def bm25_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.bm25(*_lists(spark, sf)), "score")


@query(f"""with {_LISTS}, i as (select df.query, token, ln((n_docs + 1.0) / (df + 1.0)) + 1 as idf from df join corpus using (query)),
d as (select tf.query, doc, tf.token, tf * idf as w from tf join i on tf.query = i.query and tf.token = i.token), a as (select qt.query, qt.token, times * idf as qw from qt join i on qt.query = i.query and qt.token = i.token),
l as (select query, sqrt(sum(qw * qw)) as q_len from a group by 1), s as (select d.query, doc, sum(w * qw) as dot, sqrt(sum(w * w)) as d_len from d left join a on d.query = a.query and d.token = a.token group by 1, 2)
select c.query, c.doc, round(coalesce(dot / d_len / q_len, 0), 6) as score from c left join s on c.query = s.query and c.doc = s.doc left join l on l.query = c.query""")
def tfidf_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.tfidf(*_lists(spark, sf)), "score")


@query(f"""with {_LISTS}, x as (select c.query, doc, list_distinct(q.tokens) as a, list_distinct(c.tokens) as b from c join q on c.query = q.query)
select query, doc, round(case when len(a) + len(b) = 0 then 0 else len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as score from x""")
def jaccard_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.overlap(*_lists(spark, sf)), "score")


@query("""with x as (select conv_id, turn, case when role = 'system' then [] else string_split_regex(lower(text), '\\s+') end as t from conversations), p as (select a.conv_id, a.turn, list_distinct(a.t) as a, list_distinct(b.t) as b from x a join x b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, round(case when len(a) + len(b) = 0 then 1 else len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as builder, round(case when len(a) + len(b) = 0 then 0 else len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as scorer from p""")
def jaccard_empty_conventions(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring turns under both rules for two empty sets: 1 in construction, 0 in scoring."""
    rows = load(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("a"))
    follow = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    both = rows.join(follow, ["conv_id", "turn"])
    return rounded(both.select("conv_id", "turn", X.jaccard(F.col("a"), F.col("b"), 1.0).alias("builder"), X.jaccard(F.col("a"), F.col("b"), 0.0).alias("scorer")), "builder", "scorer")


@query(f"""with {_LISTS} select tf.query, tf.doc, round(sum(ln(1 + tf)::double * ln(1 + times)::double), 6) as score from tf join qt on tf.query = qt.query and tf.token = qt.token group by 1, 2""")
def sparse_dot_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse vectors with weights ln(1 + tf). Tokens that no query has are left out where texts are read, before any is counted."""
    items, docs = _lists(spark, sf, dealt=False)
    q = items.select("query", F.explode("tokens").alias("t")).groupBy("query", "t").agg(F.log1p(F.count("*")).alias("w"))
    met = docs.select("query", "doc", F.explode_outer("tokens").alias("t")).join(F.broadcast(q.select("query", "t")), ["query", "t"], "left_semi")  # the queries' terms
    d = met.groupBy("query", "doc", "t").agg(F.log1p(F.count("*")).alias("w"))
    key = F.struct("query", "t").alias("term")
    return rounded(sparse_dot(q.select("query", key, "w"), d.select("doc", key, "w")), "score")


@query(r"""with x as (select doc_id, regexp_extract_all(text, '(?s)\$\$.*?\$\$|\$[^$]*?\$|\\\(.*?\\\)|\\\[.*?\\\]', 0) as m, trim(regexp_replace(text, '(?s)\$\$.*?\$\$|\$[^$]*?\$|\\\(.*?\\\)|\\\[.*?\\\]', '', 'g')) as t from documents)
select doc_id, array_to_string(list_transform(m, lambda z: trim(z)), ', ') as math_expr, md5(t) as text_md5 from x""")
def math_word_split(spark: SparkSession, sf: str) -> DataFrame:
    """Math expressions joined by ', ' and the text without them."""
    rows = load(spark, sf, "documents", ["doc_id", "text"])
    return rows.select("doc_id", F.array_join(F.transform(X.math_expressions(F.col("text")), F.trim), ", ").alias("math_expr"), F.md5(X.without_math(F.col("text"))).alias("text_md5"))


@query(r"""with x as (select lang, regexp_extract_all(text, '(?s)\$\$.*?\$\$|\$[^$]*?\$|\\\(.*?\\\)|\\\[.*?\\\]', 0) as m, lower(trim(regexp_replace(text, '(?s)\$\$.*?\$\$|\$[^$]*?\$|\\\(.*?\\\)|\\\[.*?\\\]', '', 'g'))) as t from documents),
y as (select lang, len(regexp_extract_all(regexp_replace(array_to_string(m, ' '), '\$|\\\(|\\\)|\\\[|\\\]', ' ', 'g'), '\\[a-zA-Z]+|[0-9]+(?:\.[0-9]+)?|[a-zA-Z]|[^\s\\a-zA-Z0-9]', 0)) as nm, len(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+', 0), lambda w: regexp_full_match(w, '[a-zA-Z]+'))) as nw from x)
select lang, round(avg(case when nm + nw > 0 then nm::double / (nm + nw) end), 9) as ratio, count(*)::bigint as n from y group by grouping sets ((lang), ())""")
def math_token_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Mean share of math tokens, by domain and overall."""
    rows = load(spark, sf, "documents", ["lang", "text"]).select("lang", F.size(X.math_tokens(F.col("text"))).alias("m"), F.size(X.word_tokens(F.col("text"))).alias("w"))
    return rounded(rows.rollup("lang").agg(F.avg(F.try_divide(F.col("m"), F.col("m") + F.col("w"))).alias("ratio"), F.count("*").alias("n")), "ratio", digits=9)


@query("""with s as (select l_returnflag as domain, l_quantity as math, l_discount * 500 as word from lineitem) select domain, round(100.0 * sum(case when math > word then 1 else 0 end) / nullif(sum(case when math <> word then 1 else 0 end), 0), 6) as pct,
 sum(case when math = word then 1 else 0 end)::bigint as ties, round(avg(math), 6) as mean_math, round(avg(word), 6) as mean_word from s group by grouping sets ((domain), ())""")
def math_vs_word_preference(spark: SparkSession, sf: str) -> DataFrame:
    """Share of rows whose first score is above the second, ties left out, by domain and overall."""
    rows = load(spark, sf, "lineitem", ["l_returnflag", "l_quantity", "l_discount"]).select(F.col("l_returnflag").alias("domain"), F.col("l_quantity").alias("math"), (F.col("l_discount") * 500).alias("word"))
    more, same = F.sum(F.when(F.col("math") > F.col("word"), 1).otherwise(0)), F.sum(F.when(F.col("math") == F.col("word"), 1).otherwise(0))
    return rounded(rows.rollup("domain").agg((100.0 * more / F.nullif(F.count("*") - same, F.lit(0))).alias("pct"), same.alias("ties"), F.avg("math").alias("mean_math"), F.avg("word").alias("mean_word")), "pct", "mean_math", "mean_word")


@query("""select item_id, text as statement, 'Problem: ' || text || E'\\n\\nSolution: None' as full_text, case when item_id % 2 = 0 then text else E'Instruct: rank\\nQuery: ' || text end as instructed, 'query: ' || text || '</s>' as affixed, E'ID: ' || item_id || E'\\n\\nTEXT: ' || text as labelled from benchmark""")
def text_views(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return load(spark, sf, "benchmark").select(
        "item_id",
        X.text_view("statement", t, F.lit(None)).alias("statement"),
        X.text_view("full", t, F.lit(None).cast("string")).alias("full_text"),
        X.instructed(F.when(F.col("item_id") % 2 == 1, "rank"), t).alias("instructed"),
        X.affixed(t, F.lit("query: "), F.lit("</s>")).alias("affixed"),
        X.labelled(ID=F.col("item_id").cast("string"), TEXT=t).alias("labelled"),
    )


@query("""with x as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9^_]+', 0), lambda t: t not in ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with')) as t from documents) select doc_id, len(t)::bigint as n, md5(array_to_string(t, ' ')) as tokens_md5 from x""")
def idea_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", X.idea_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"""with x as (select doc_id, {_TOK.format("text")} as t from documents), y as (select doc_id, t, unnest(range(greatest(ceil(len(t) / 64.0)::bigint, 1))) as chunk from x) select doc_id, chunk, len(t[chunk * 64 + 1 : chunk * 64 + 64])::bigint as n_tokens from y""")
def token_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 64 tokens with their owner; an empty text has one empty chunk."""
    rows = load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.posexplode(X.chunks(X.whitespace_tokens(F.col("text")), 64)).alias("chunk", "t"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("t").cast("long").alias("n_tokens"))


def _answer(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(r"""with a as (select event_id, 'thinking </think> so \boxed{ ' || (event_id % 3) || ' } <score> ' || (event_id % 101) || ' </score> is ' || value || '%' as t from events)
select event_id, nullif(regexp_extract(t, '\\boxed\{\s*([12])\s*\}', 1), '')::int as choice, regexp_extract(t, '<score>\s*(\d+)\s*</score>', 1)::int as score, trim(split_part(t, '</think>', 2)) as answer, regexp_extract(t, '\\boxed\{(.*?)\}', 1) as last_box,
 regexp_extract(replace(split_part(t, 'is ', 2), '%', ''), '-?[0-9]+(?:\.[0-9]+)?', 0)::double as number from a""")
def answer_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """Boxed choices, score tags, answers after thinking, and numbers with signs of percent."""
    t = _answer("thinking </think> so \\boxed{ ", F.col("event_id") % 3, " } <score> ", F.col("event_id") % 101, " </score> is ", F.col("value"), "%")
    rows = load(spark, sf, "events", ["event_id", "value"]).select("event_id", t.alias("t"))
    return rows.select("event_id", X.boxed_choice(F.col("t")).alias("choice"), X.tagged_score(F.col("t")).alias("score"), X.without_thinking(F.col("t")).alias("answer"), X.last_boxed(F.col("t")).alias("last_box"), X.number_in(F.split_part("t", F.lit("is "), F.lit(2))).alias("number"))


@query("""select event_id, k as doc, round(case when k = 1 then user_id else event_id % 11 end / 10.0, 6) as score from events, (select unnest([1, 2]) as k) where event_id % 5 <> 0""")
def group_json_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Listwise answers: fenced JSON with doubled brackets and a missing brace is mended; what cannot be parsed gives no row."""
    block = _answer("<answer>```json\n{\"[1]\": ", F.col("user_id"), ", \"[2]]\": ", F.col("event_id") % 11, "\n```</answer>")
    text = F.when(F.col("event_id") % 5 == 0, F.lit("no scores {")).otherwise(block)
    rows = load(spark, sf, "events", ["event_id", "user_id"]).select("event_id", F.explode(X.group_scores(text)).alias("k", "v"))
    return rounded(rows.select("event_id", F.regexp_replace("k", r"[\[\] ]", "").try_cast("int").alias("doc"), (F.col("v") / 10).alias("score")), "score")


@query("""select event_id, 'm' || user_id as model, 'p' || (event_id % 4) as prompt, case when event_id % 2 = 0 then 20 end as n, case when event_id % 2 = 0 then 42 end as seed, case when event_id % 3 = 0 then (event_id % 5)::int end as shard, case when event_id % 3 = 0 then 5 end as shards, case when event_id % 7 = 0 then 'x' end as part,
 'm' || user_id || '__p' || (event_id % 4) || case when event_id % 2 = 0 then '__n20_seed42' else '' end || case when event_id % 7 = 0 then '__part-x' else '' end as base from events""")
def run_name_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    stem = X.run_stem(_answer("m", F.col("user_id")), _answer("p", e % 4), F.when(e % 2 == 0, F.lit("20")), F.when(e % 2 == 0, F.lit("42")), F.when(e % 3 == 0, (e % 5).cast("string")), F.when(e % 3 == 0, F.lit("5")), F.when(e % 7 == 0, F.lit("x")))
    rows = load(spark, sf, "events", ["event_id", "user_id"]).select("event_id", stem.alias("stem"))
    return rows.select("event_id", X.run_name(F.col("stem")).alias("r"), X.base_name(F.col("stem")).alias("base")).select("event_id", "r.*", "base")


@query("""select page_id, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') as compact, len(list_filter(string_split(url, '/'), lambda x: x <> ''))::bigint as n_parts, crc32(url) % 1000 as h, md5(url) as md5 from pages""".replace("crc32(url) % 1000 as h, ", ""))
def compact_strings(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages", ["page_id", "url"]).select("page_id", X.compact(F.col("url")).alias("compact"), F.size(X.path_parts(F.col("url"))).cast("long").alias("n_parts"), F.md5("url").alias("md5"))


@query(r"""select s_suppkey, lower(case when s_suppkey % 2 = 0 then s_name else s_name || ' x' end) as name from supplier""")
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown links give their labels; names are unified in form, dashes, white space and case."""
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("["), F.col("s_name"), F.lit("](http://h/x)"))).otherwise(F.concat(F.lit(" "), F.col("s_name"), F.lit("  \u00a0x")))
    return load(spark, sf, "supplier", ["s_suppkey", "s_name"]).select("s_suppkey", X.canonical_name(X.linked_label(raw)).alias("name"))


@query("""select event_id, 'a{' || user_id || '}' as first, 2::bigint as n from events""")
def balanced_boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events", ["event_id", "user_id"]).select("event_id", X.balanced_boxes(_answer("\\boxed{a{", F.col("user_id"), "}} and \\boxed{z} \\boxed{open")).alias("b"))
    return rows.select("event_id", F.get("b", F.lit(0)).alias("first"), F.size("b").cast("long").alias("n"))


@query("""select event_id, case when user_id % 4 = 0 then '' else 'idea ' || user_id end as idea from events""")
def core_ideas(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    answer = F.when(u % 4 == 0, F.when(u % 8 == 0, F.lit('{"noCoreIdea": true, "coreIdea": "x"}')).otherwise(F.lit("{broken"))).otherwise(_answer('{"noCoreIdea": false, "coreIdea": "idea ', u, '"}'))
    return load(spark, sf, "events", ["event_id", "user_id"]).select("event_id", X.core_idea(answer).alias("idea"))
