"""Queries on reports, names, lists, shards and vector caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..operators import reports as R
from ..sources import vectors as V
from ..sources.tables import load, with_row_idx
from .common import query, rounded


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """A model is a user, a task an event type, its queries the events in order; values under 5 are not scored."""
    rows = load(spark, sf, "events", ["event_id", "user_id", "event_type", "value"]).select(F.col("user_id").alias("model"), F.col("event_type").alias("task"), "event_id", F.when(F.col("value") >= 5, F.round("value", 3)).alias("v"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"])
    return rows.groupBy("model", "task").agg(F.round(F.avg("v"), 6).alias("mean"), lists.alias("scores"))


@query("""with s as (select user_id as model, event_type as task, round(avg(case when value >= 5 then round(value, 3) end), 6) as mean, count(*) as n, count(case when value >= 5 then 1 end) as done from events group by 1, 2)
select 'm' || model as model, task, mean as ndcg, done::int as n_done, case when model % 3 = 0 then 0 when model % 3 = 1 then 1 else 2 end as rank from s where done = n""")
def report_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Result files of a report each, parsed: the first report, its protocol rank, and the tasks that are scored in full."""
    cells = _scored(spark, sf)
    prompt = F.when(F.col("model") % 3 == 1, F.named_struct(F.lit("protocol"), F.lit("draft"), F.lit("key"), F.lit("p0"))).when(F.col("model") % 3 == 2, F.named_struct(F.lit("protocol"), F.lit("canonical"), F.lit("key"), F.lit("p0")))
    tasks = F.collect_list(F.struct("task", F.col("mean").alias("ndcg_at_k")))
    reports = cells.groupBy("model").agg(tasks.alias("tasks"), F.map_from_entries(F.collect_list(F.struct("task", "scores"))).alias("ndcgs_by_task")).withColumn("prompt", prompt)
    body = F.to_json(F.struct(F.create_map(F.concat(F.lit("m"), F.col("model").cast("string")), F.struct("prompt", "tasks", "ndcgs_by_task")).alias("reports")), {"ignoreNullFields": "false"})
    parsed = reports.select(R.report_of(R.payload(body)).alias("r")).select(F.col("r.key").alias("model"), F.col("r.value").alias("report"))
    return R.complete_tasks(parsed, "report").select("model", "task", "ndcg", "n_done", R.protocol_rank(F.col("report")).alias("rank"))


@query("""with r as (select l_suppkey as k, round(avg(l_quantity), 6) as score from lineitem where l_suppkey % 11 <> 0 group by 1), c as (select l_suppkey as k, min(l_quantity) as lo, max(l_quantity) as hi from lineitem where l_suppkey % 2 = 0 group by 1),
w as (select s_suppkey as key, score, lo, hi, case when score is null then 'not scored yet' when s_nationkey % 3 < 2 then 'scored with an older prompt' end as state from supplier left join r on r.k = s_suppkey left join c on c.k = s_suppkey)
select w.key, w.score, w.lo, w.hi, w.state, p.place from w left join (select key, row_number() over (order by score desc, key)::int as place from w where state is null) p on p.key = w.key""")
def leaderboard_star(spark: SparkSession, sf: str) -> DataFrame:
    """Models with their runs, protocol ranks and intervals: the table in order of the score, and who is pending and why."""
    models = load(spark, sf, "supplier", ["s_suppkey", "s_nationkey"]).select(F.col("s_suppkey").alias("key"), (F.col("s_nationkey") % 3).alias("nation"))
    items = load(spark, sf, "lineitem", ["l_suppkey", "l_quantity"]).select(F.col("l_suppkey").alias("key"), "l_quantity")
    runs = items.where("key % 11 <> 0").groupBy("key").agg(F.round(F.avg("l_quantity"), 6).alias("score"))
    intervals = items.where("key % 2 = 0").groupBy("key").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return R.leaderboard(models.select("key"), runs, models.select("key", F.col("nation").alias("rank")), intervals, "key").select("key", "score", "lo", "hi", "state", "place")


@query("""with o as (select o_custkey as c, row_number() over (partition by o_custkey order by o_orderkey) as i, o_orderpriority as t, count(*) over (partition by o_custkey) as n from orders)
select c, string_agg(t, '|' order by i) as tasks from (select c, t, min(i) as i from o group by 1, 2) group by 1""")
def meta_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered union of a run's earlier and later tasks: distinct, in the order in which they came."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = load(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderpriority"]).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("o_custkey")))

    def half(late: bool):
        own = F.when((F.col("i") * 2 > F.col("n")) == late, F.struct("i", "o_orderpriority"))
        return F.transform(F.array_sort(F.collect_list(own)), lambda x: x["o_orderpriority"])

    lists = rows.groupBy(F.col("o_custkey").alias("c")).agg(half(False).alias("old"), half(True).alias("new"))
    return lists.select("c", F.array_join(N.ordered_distinct(F.concat("old", "new")), "|").alias("tasks"))


@query("""select event_id, case when event_id % 13 = 0 or event_id % 17 = 0 then 'a part or shard' when value < 2 then 'an error' when user_id % 50 = 0 then 'queries: ' || (1000 - event_id % 2 - 1) when event_type = 'click' and event_id % 3 = 0 then 'k: 5'
 when event_id % 7 = 0 then 'exponent' when event_id % 19 = 0 then 'prompt key' end as reason from events""")
def verified_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the reason why they are refused; null for those that are accepted."""
    e = F.col("event_id")
    rows = load(spark, sf, "events", ["event_id", "user_id", "event_type", "value"]).select(
        "event_id", F.when(e % 13 == 0, "x").alias("part"), F.when(e % 17 == 0, 1).alias("shard"), F.when(F.col("value") < 2, "timeout").alias("error"),
        F.when(F.col("user_id") % 50 == 0, 999 - e % 2).otherwise(F.lit(1000)).alias("n"), F.when((F.col("event_type") == "click") & (e % 3 == 0), 5).otherwise(10).alias("k"),
        F.when(e % 7 == 0, 1.0).otherwise(2.0).alias("exponent"), F.when(e % 19 == 0, F.lit(None)).otherwise(F.lit("p0")).alias("prompt"), F.lit("p0").alias("key"))
    return R.verified(rows, 1000, 10, 2.0).select("event_id", "reason")


@query("""with s as (select l_suppkey as k, round(avg(l_extendedprice), 4) as a, round(avg(l_extendedprice * l_discount), 4) as b from lineitem group by 1), r as (select *, rank() over (order by a desc) as x, rank() over (order by b desc) as y from s), c as (select * from r where x <> y)
select c.k, c.x::int as before, c.y::int as after, d.k as partner, round(abs(c.a - d.a), 4) as gap from c left join c d on c.x = d.y and c.y = d.x""")
def rank_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Models whose rank moves under another scoring, and those that swap places."""
    items = load(spark, sf, "lineitem", ["l_suppkey", "l_extendedprice", "l_discount"])
    scores = items.groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_extendedprice"), 4).alias("a"), F.round(F.avg(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("b"))
    return rounded(R.rank_changes(scores, "k", "a", "b"), "gap", digits=4)


_T_TAIL = """greatest(0, 1 - 2 * t / 6000 / sqrt(pi() * v) * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) * (select sum(case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end * pow(1 + pow(t * i / 2000, 2) / v, -(v + 1) / 2.0)) from range(2001) s(i)))"""


@query(f"""with c as (select c_nationkey as g, c_acctbal as a, (c_custkey * 7919) % 1009 + c_acctbal / 20 as b from customer), r as (select *, rank() over (partition by g order by a) + (count(*) over (partition by g, a) - 1) / 2.0 as ra, rank() over (partition by g order by b) + (count(*) over (partition by g, b) - 1) / 2.0 as rb from c),
s as (select g, count(*) as n, corr(a, b) as p, corr(ra, rb) as q from r group by 1), u as (select g, n, p, q, n - 2 as v, abs(p) * sqrt((n - 2) / (1 - p * p)) as tp, abs(q) * sqrt((n - 2) / (1 - q * q)) as tq from s)
select g, n, round(p, 6) as pearson, round({_T_TAIL.replace("t /", "tp /").replace("(t *", "(tp *")}, 6) as pearson_p, round(q, 6) as spearman, round({_T_TAIL.replace("t /", "tq /").replace("(t *", "(tq *")}, 6) as spearman_p from u""")
def correlation_p_values(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson and Spearman with two-sided p-values of Student's t; the twin integrates its density."""
    rows = load(spark, sf, "customer", ["c_nationkey", "c_acctbal", "c_custkey"]).select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("a"), ((F.col("c_custkey") * 7919) % 1009 + F.col("c_acctbal") / 20).alias("b"))
    return rounded(R.correlation_tests(rows, "a", "b", ["g"]), "pearson", "pearson_p", "spearman", "spearman_p")


@query("select p_type as domain, case when p_size % 4 = 0 then 'Other' else p_brand end as topic, count(*)::bigint as n from part group by 1, 2")
def topic_markers(spark: SparkSession, sf: str) -> DataFrame:
    """How many candidates mark each topic of a domain, once each; domains come from the list where it names a known one, else
    from the tags, and a domain without a topic has Other."""
    rows = load(spark, sf, "part", ["p_partkey", "p_type", "p_brand", "p_size"])
    known = sorted(r[0].title() for r in rows.select("p_type").distinct().collect())  # the domains: a fixed handful
    root = F.concat(F.lit("/"), F.initcap("p_type"))
    tags = F.when(F.col("p_size") % 4 == 0, F.array(root)).otherwise(F.array(F.concat(root, F.lit("/"), "p_brand"), F.concat(root, F.lit("/"), "p_brand", F.lit("/more"))))
    listed = F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_type"), F.lit("no domain")))
    found = rows.select(N.domains_of(listed, tags, known).alias("d"), tags.alias("t"))
    marks = found.select(F.explode(N.topics_by_domain(F.col("d"), F.col("t"))).alias("x"))
    names = F.create_map(*[x for k in known for x in (F.lit(k), F.lit(k.upper()))])
    return marks.groupBy(names[F.col("x.domain")].alias("domain"), F.col("x.topic").alias("topic")).agg(F.count("*").alias("n"))


@query("""select l_orderkey, l_returnflag, string_agg(l_linestatus || l_linenumber, ',' order by l_linenumber, l_linestatus) as gradings from lineitem group by 1, 2""")
def joined_gradings(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with the same keys become one with all their gradings."""
    rows = load(spark, sf, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"]).select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("i"), F.array(F.concat("l_linestatus", F.col("l_linenumber").cast("string"))).alias("gradings"))
    return R.joined_gradings(rows, ["l_orderkey", "l_returnflag"], "gradings", "i").select("l_orderkey", "l_returnflag", F.array_join("gradings", ",").alias("gradings"))


@query("""with s as (select l_orderkey, l_suppkey, count(*) as n from lineitem group by 1, 2) select l_orderkey, l_suppkey, regexp_matches(l_orderkey::varchar, '^(1|7.*3$)') or min(n) over (partition by l_orderkey) > 1 as test from s""")
def strict_split(spark: SparkSession, sf: str) -> DataFrame:
    """Test samples: problems matched by a pattern, or all of whose samples have several gradings."""
    rows = load(spark, sf, "lineitem", ["l_orderkey", "l_suppkey", "l_linenumber"]).groupBy("l_orderkey", "l_suppkey").agg(F.collect_list("l_linenumber").alias("grading")).withColumn("p", F.col("l_orderkey").cast("string"))
    return R.strict_split(rows, "p", "grading", ["1", "7.*3$"]).select("l_orderkey", "l_suppkey", "test")


@query("""with recursive o as (select o_custkey as c, o_orderkey as k, round(o_totalprice)::bigint as s, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
b as (select c, k, i, 0 as bin, s as held from o where i = 1 union all select o.c, o.k, o.i, b.bin + (b.held > 0 and b.held + o.s > 300000)::int, case when b.held > 0 and b.held + o.s > 300000 then o.s else b.held + o.s end from b join o on o.c = b.c and o.i = b.i + 1)
select c, k, bin from b""")
def request_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Requests in order, in chunks of bounded size."""
    rows = load(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_totalprice"]).groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("long").alias("s")))).alias("z"))
    bins = R.packed(F.transform("z", lambda x: x["s"]), 300_000)
    return rows.select("c", F.explode(F.arrays_zip(F.col("z.k").alias("k"), bins.alias("bin"))).alias("x")).select("c", "x.k", "x.bin")


@query("""with s as (select l_partkey as q, l_orderkey * 10 + l_linenumber as d, l_extendedprice as s, l_linestatus = 'F' as f from lineitem), o as (select q, max(d) as d from s where f group by 1), w as (select o.q, o.d, s.s from o join s on s.q = o.q and s.d = o.d)
select w.q, (1 + count(case when f and x.d <> w.d and x.s > w.s then 1 end))::bigint as rank, (1 + count(case when x.d <> w.d and x.s > w.s then 1 end))::bigint as rank_with_all from w join s x on x.q = w.q group by 1""")
def rank_with_rephrasings(spark: SparkSession, sf: str) -> DataFrame:
    """A copy's rank in the corpus, and with all other rephrasings on top."""
    s = load(spark, sf, "lineitem", ["l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_linestatus"]).select(F.col("l_partkey").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("d"), F.col("l_extendedprice").alias("score"), (F.col("l_linestatus") == "F").alias("f"))
    own = s.where("f").groupBy("q").agg(F.max(F.struct("d", "score")).alias("o")).select("q", "o.*")
    return R.ranks_with_rephrasings(s.where("f"), s.where("not f"), own, "q", "d")


@query("select model, query, score from (select user_id as model, event_id % 20 as query, round(value, 6) as score, row_number() over (partition by user_id, event_id % 20 order by (event_type = 'view')::int desc, event_id desc) as rn from events) where rn = 1")
def pooled_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Results of all files of a model: those with a prompt in their name before others, later ones before earlier."""
    rows = load(spark, sf, "events", ["event_id", "user_id", "event_type", "value"]).select(F.col("user_id").alias("model"), (F.col("event_id") % 20).alias("query"), F.round("value", 6).alias("score"), F.struct((F.col("event_type") == "view").alias("prompted"), "event_id").alias("at"))
    return R.pooled(rows, ["model", "query"], F.col("at")).select("model", "query", "score")


@query("""with e as (select user_id as base, event_type as part, case when user_id % 29 = 0 then event_id % 2 else 0 end as model, event_id % 9 as i, case when event_id % 3 = 0 and user_id % 7 > 0 then 'a' else 'b' end as domain, case when value > 40 then value end as v from events),
x as (select base, i, count(distinct case when v is not null then part end) as o, count(distinct domain) as d from e group by 1, 2), s as (select base, sum((o > 1)::int)::bigint as overlaps, sum((d > 1)::int)::bigint as conflicts, sum((o = 0)::int)::bigint as missing from x group by 1)
select s.*, m.models, m.parts, (m.models = 1 and s.overlaps = 0 and conflicts = 0 and missing = 0) as ok from s join (select base, count(distinct model) as models, count(distinct part) as parts from e group by 1) m on m.base = s.base""")
def shard_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a run before they are merged: one model, no query scored twice, no conflicting domains, none missing."""
    u, e = F.col("user_id"), F.col("event_id")
    rows = load(spark, sf, "events", ["event_id", "user_id", "event_type", "value"]).select(u.alias("base"), F.col("event_type").alias("part"), F.when(u % 29 == 0, e % 2).otherwise(0).alias("model"), (e % 9).alias("i"), F.when((e % 3 == 0) & (u % 7 > 0), "a").otherwise("b").alias("domain"), F.when(F.col("value") > 40, F.col("value")).alias("v"))
    return R.checked_parts(rows, "base", "model", "i", "v")


@query("select lower(p_name) as name, count(*)::bigint as n, min(p_partkey) as first from part group by 1 having count(*) > 1")
def duplicate_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Names that several entries map to."""
    rows = load(spark, sf, "part", ["p_partkey", "p_name"]).groupBy(F.lower("p_name").alias("name"))
    return rows.agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


@query("""(select 'only left' as side, x as name from (select distinct c_mktsegment || c_nationkey as x from customer where c_nationkey < 20) where x not in (select c_mktsegment || c_nationkey from customer where c_nationkey > 3))
union all (select 'only right', x from (select distinct c_mktsegment || c_nationkey as x from customer where c_nationkey > 3) where x not in (select c_mktsegment || c_nationkey from customer where c_nationkey < 20))
union all (select 'both', x from (select c_mktsegment || c_nationkey as x from customer where c_nationkey < 20 intersect select c_mktsegment || c_nationkey from customer where c_nationkey > 3))""")
def split_names(spark: SparkSession, sf: str) -> DataFrame:
    """Requested and valid names: what both have, and the symmetric difference."""
    rows = load(spark, sf, "customer", ["c_mktsegment", "c_nationkey"]).select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), "c_nationkey")
    left, right = rows.where("c_nationkey < 20").select("name"), rows.where("c_nationkey > 3").select("name")
    sides = [("only left", left.distinct().join(right, "name", "left_anti")), ("only right", right.distinct().join(left, "name", "left_anti")), ("both", left.intersect(right))]
    out = None
    for side, df in sides:
        part = df.select(F.lit(side).alias("side"), "name")
        out = part if out is None else out.unionByName(part)
    return out


@query("with c as (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer), o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) select c_custkey, o_orderkey, c.i as row_idx from c join o on c.i = o.i")
def zip_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables of one length side by side, row by row."""
    left = with_row_idx(load(spark, sf, "customer", ["c_custkey"]), "c_custkey")
    right = with_row_idx(load(spark, sf, "orders", ["o_orderkey"]), "o_orderkey").join(left.agg(F.count("*").alias("n")), F.col("row_idx") < F.col("n")).drop("n")
    return R.zipped(left, right).select("c_custkey", "o_orderkey", "row_idx")


@query("""with o as (select s_suppkey as k, s_name as name, s_acctbal as bal from supplier where s_suppkey % 10 <> 3), n as (select s_suppkey as k, upper(s_name) as name from supplier where s_suppkey % 5 = 3)
select coalesce(o.k, n.k) as k, coalesce(n.name, o.name) as name, round(bal, 2) as bal, case when o.k is null then 'orphan' when n.k is null then 'kept' else 'replaced' end as state from o full join n on o.k = n.k""")
def upsert_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Mended rows replace those of their id; ids that the table lacks are told."""
    rows = load(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"]).select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("bal"))
    return R.upserted(rows.where("k % 10 <> 3"), rows.where("k % 5 = 3").select("k", F.upper("name").alias("name")), "k", ["name"]).select("k", "name", "bal", "state")


@query("with s as (select event_type as split, count(*) as n from events group by 1) select split, coalesce(sum(n) over (order by split rows between unbounded preceding and 1 preceding), 0)::bigint as begin, sum(n) over (order by split)::bigint as past from s")
def split_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each split begins and ends in the concatenation of all."""
    sizes = load(spark, sf, "events", ["event_type"]).groupBy(F.col("event_type").alias("split")).agg(F.count("*").alias("n"))
    past = F.sum("n").over(Window.orderBy("split"))  # a row a split
    return sizes.select("split", (past - F.col("n")).alias("begin"), past.alias("past"))


@query("""select o_orderkey, case when o_orderpriority = '1-URGENT' then 'first' else lower(string_split(o_clerk || '/' || o_orderpriority, '/')[2]) end as key, replace(o_clerk || '/' || o_orderpriority, '/', '_') as stem, case when o_orderstatus = 'F' then 'cross' else 'bi' end as class, string_split(o_orderpriority, '-')[1] as domain,
('0x' || substr(sha256(o_clerk || '|' || o_orderkey), 1, 8))::bigint as seed, md5(o_clerk) as digest, 'Q: ' || o_orderkey || ' {x} of ' || o_clerk as prompt, case when n >= 1000000 then format('{:.1f}M', n / 1000000) when n >= 1000 then format('{:.1f}k', n / 1000) else n::bigint::varchar end as short from (select *, floor(o_totalprice / 100) * 100 + 20 as n, coalesce(o_orderkey % 977, 0)::varchar as o_clerk from orders)""")
def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Model keys with exceptions, file stems, classes, first domains, seeds, digests and filled prompts."""
    rows = load(spark, sf, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]).withColumn("o_clerk", (F.col("o_orderkey") % 977).cast("string"))
    name = F.concat("o_clerk", F.lit("/"), "o_orderpriority")
    key = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("lab/Urgent")).otherwise(name)
    return rows.select("o_orderkey", N.model_key(key, {"lab/Urgent": "first"}).alias("key"), N.file_stem(name).alias("stem"), N.frontier_class(F.when(F.col("o_orderstatus") == "F", "RERANK").otherwise("BI")).alias("class"),
                       N.first_domain(F.split("o_orderpriority", "-")).alias("domain"), N.seed_of(F.col("o_clerk"), F.col("o_orderkey").cast("string")).alias("seed"), F.md5("o_clerk").alias("digest"),
                       N.filled("Q: {key} {x} of {clerk}", key=F.col("o_orderkey"), clerk=F.col("o_clerk"), other=F.lit("no")).alias("prompt"), N.short_count((F.floor(F.col("o_totalprice") / 100) * 100 + 20).cast("long")).alias("short"))


@query(r"""with d as (select doc_id, source, 'see $' || n_chars || ' + x$ and ' || source || ' then $$y_' || doc_id || '$$ end' as t from documents)
select doc_id, array_to_string(list_transform(regexp_extract_all(t, '\${1,2}.*?\${1,2}'), lambda x: trim(x)), ', ') as math_expr, trim(regexp_replace(t, '\${1,2}.*?\${1,2}', '', 'g')) as text_only, array_to_string(regexp_extract_all(t, '\${1,2}(.*?)\${1,2}', 1), '|') as inside from d where source is not null""")
def four_part_split(spark: SparkSession, sf: str) -> DataFrame:
    """Math expressions and text apart, and what the dollar pairs hold."""
    rows = load(spark, sf, "documents", ["doc_id", "n_chars", "source"]).where("source is not null")
    text = F.concat(F.lit("see $"), F.col("n_chars").cast("string"), F.lit(" + x$ and "), "source", F.lit(" then $$y_"), F.col("doc_id").cast("string"), F.lit("$$ end"))
    math, rest = N.four_parts(text, r"\${1,2}.*?\${1,2}")
    return rows.select("doc_id", math.alias("math_expr"), rest.alias("text_only"), F.array_join(N.inner_math(text), "|").alias("inside"))


@query("""with c as (select l_partkey as q, list(l_quantity) as v, count(*) as n from lineitem group by 1), s as (select q, n, round(list_avg(v), 6) as mean from c) select q, n::bigint as n, mean, format('{:.3f}', mean) as cell, format('{:+.3f}', mean - 25) as delta, (select quantile_cont(n, 0.5)::int from s) as median_n from s""")
def list_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Mean similarity of each candidate list, its cells for a table, and the median size of all lists."""
    rows = load(spark, sf, "lineitem", ["l_partkey", "l_quantity"]).groupBy(F.col("l_partkey").alias("q")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    median = rows.agg(F.rint(F.expr("percentile(n, 0.5)")).cast("int").alias("median_n"))
    return rows.select("q", "n", "mean", N.cell(F.col("mean")).alias("cell"), N.delta_cell(F.col("mean"), F.lit(25.0)).alias("delta")).join(F.broadcast(median))


@query("select vec_id - vec_id % 25 as i, vec_id as j, round(label / 10.0, 4) as bma from embeddings where vec_id % 25 < 5 and vec_id - vec_id % 25 in (0, 100, 425)")
def similarity_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity rows written in blocks of a hundred rows; a few rows are read back from their own blocks, one metric alone."""
    from ..sources.tables import shared_folder

    v, label = F.col("vec_id"), F.col("label")
    rows = load(spark, sf, "embeddings", ["vec_id", "label"]).where(v % 25 < 5).select((v - v % 25).alias("i"), v.alias("j"), (label / 10).alias("bma"), (label / 100).alias("jaccard"))
    folder = shared_folder(spark, "blocks")
    V.write_blocks(rows, folder, 100)
    return V.read_rows(spark, folder, [0, 100, 425], 100, "bma").select("i", "j", F.round(F.col("bma").cast("double"), 4).alias("bma"))


@query("""with c as (select distinct source, lang from documents where doc_id % 3 = 0 and source is not null and lang is not null) select distinct source, lang from documents where source is not null and lang is not null except select source, lang from c""")
def missing_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct queries that the cache of this recipe lacks."""
    rows = load(spark, sf, "documents", ["doc_id", "source", "lang"]).where("source is not null and lang is not null").withColumn("text", F.concat_ws("|", "source", "lang"))
    made = F.when(F.col("doc_id") % 3 == 0, "now").otherwise("before").alias("fingerprint")
    cache = V.fingerprinted(rows.select("text", made), "now")
    return V.missing_texts(rows, cache).select(F.split_part("text", F.lit("|"), F.lit(1)).alias("source"), F.split_part("text", F.lit("|"), F.lit(2)).alias("lang"))


@query("select side, text, v from (select c_mktsegment as side, c_nationkey::varchar as text, c_custkey as v, row_number() over (partition by c_mktsegment, c_nationkey order by (c_custkey % 2) desc, c_custkey desc) as rn from customer) where rn = 1")
def cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two vector caches become one; of equal keys the imported entry stays."""
    rows = load(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"]).select(F.col("c_mktsegment").alias("side"), F.col("c_nationkey").cast("string").alias("text"), F.col("c_custkey").alias("v"))
    old, new = (rows.where(F.col("v") % 2 == k).groupBy("side", "text").agg(F.max("v").alias("v")) for k in (0, 1))
    return V.merged(old, new)


@query("""with e as (select event_id, case event_id % 3 when 0 then 'm' || user_id when 1 then 'm' || user_id || '__p' || (event_id % 4) else 'm' || user_id || '__x' end || case when event_id % 2 = 0 then '__n20_seed42' else '' end || case when event_id % 5 = 0 then '__shard1of4' else '' end as stem, user_id from events)
select event_id, 'm' || user_id || case when event_id % 3 = 2 then '__x' else '' end as model, case when event_id % 3 = 1 then 'p' || (event_id % 4) end as prompt, case when event_id % 2 = 0 then 20 end as n, case when event_id % 2 = 0 then 42 end as seed, case when event_id % 5 = 0 then 1 end as shard from e""")
def older_run_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a prompt key and of the older form without one."""
    e, m = F.col("event_id"), F.concat(F.lit("m"), F.col("user_id").cast("string"))
    stem = F.concat(F.when(e % 3 == 0, m).when(e % 3 == 1, F.concat(m, F.lit("__p"), (e % 4).cast("string"))).otherwise(F.concat(m, F.lit("__x"))), F.when(e % 2 == 0, "__n20_seed42").otherwise(""), F.when(e % 5 == 0, "__shard1of4").otherwise(""))
    return load(spark, sf, "events", ["event_id", "user_id"]).select("event_id", X.run_name(stem).alias("r")).select("event_id", "r.model", "r.prompt", "r.n", "r.seed", "r.shard")
