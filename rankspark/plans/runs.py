"""Queries on run bookkeeping; events stand for runs: model is the user, prompt the type, score the value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.portable import portable_hash, sql_hash
from ..operators.ranking import average_rank
from ..operators.rounds import tried
from ..sources import runs as S
from ..sources.tables import load, load_placed, shared_folder, stream, union_splits, with_row_idx
from ..streaming.resume import latest, score_new
from ..streaming.resume import windowed_counts as hourly
from .common import query, rounded


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return rows.select(F.col("user_id").alias("model"), F.col("event_type").alias("prompt"), (F.col("event_id") % 3).alias("protocol"), F.col("value").alias("score"), F.col("ts").alias("mtime"), "event_id")


_RUNS = "runs as (select user_id as model, event_type as prompt, event_id % 3 as protocol, value as score, ts as mtime, event_id from events)"


@query(f"with {_RUNS}, r as (select *, row_number() over (partition by model, prompt order by protocol desc, score desc, mtime desc, event_id desc) as rn from runs) select model, prompt, event_id, round(score, 6) as score from r where rn = 1")
def best_run(spark: SparkSession, sf: str) -> DataFrame:
    found = S.best_runs(_runs(spark, sf), ["model", "prompt"], "protocol", "score", "mtime", "event_id")
    return rounded(found.select("model", "prompt", "event_id", "score"), "score")


@query(f"""with {_RUNS}, l as (select model, prompt, max_by(score, event_id) as score, max(event_id) as event_id, max_by(protocol, event_id) as protocol from runs group by 1, 2),
o as (select model, prompt, min_by(score, event_id) as score, min(event_id) as event_id, min_by(protocol, event_id) as protocol from runs group by 1, 2),
b as (select *, 0 as v from o union all select *, 1 from l), r as (select *, row_number() over (partition by model, prompt order by (protocol = 0)::int, v desc) as rn from b) select model, prompt, event_id, round(score, 6) as score from r where rn = 1""")
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The newest run replaces the oldest, unless it is an error and the old one is not."""
    rows = _runs(spark, sf)
    new, old = (rows.groupBy("model", "prompt").agg(f("score", "event_id").alias("score"), g("event_id").alias("event_id"), f("protocol", "event_id").alias("protocol")) for f, g in ((F.max_by, F.max), (F.min_by, F.min)))
    return rounded(S.merge_upsert(old, new, ["model", "prompt"], F.col("protocol") == 0).select("model", "prompt", "event_id", "score"), "score")


@query("select event_type, round(avg(value), 6) as mean, count(*)::bigint as n from events group by 1")
def shard_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Five strided shards are united (an overlap raises) and averaged."""
    rows = load(spark, sf, "events", ["event_id", "event_type", "value"])
    parts = union_splits(*[rows.where(F.col("event_id") % 5 == s) for s in range(5)])
    return rounded(S.merge_shards(parts, "event_id").groupBy("event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n")), "mean")


@query("select range as o_orderkey from range((select max(o_orderkey) + 1 from orders)) where range not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def shard_gaps(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders", ["o_orderkey", "o_orderstatus"])
    return S.gaps(orders.where("o_orderstatus <> 'P'").select("o_orderkey"), "o_orderkey", 0, orders.agg(F.max("o_orderkey")).first()[0])


@query("select user_id as model from events group by 1 having count(distinct event_id % 4) = 4")
def complete_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events", ["event_id", "user_id"]).select(F.col("user_id").alias("model"), (F.col("event_id") % 4).alias("shard"), F.lit(4).alias("shards"))
    return S.complete_sets(rows, ["model"], "shard", "shards")


@query("""with g as (select p.prompt, m.model from (select distinct event_type as prompt from events) p, (select distinct user_id as model from events) m), f as (select user_id as model, event_type as prompt, count(*) as n, sum((value < 1)::int) as nulls from events group by 1, 2)
select g.prompt, g.model, case when n is null then 'missing' when n < 15 then 'short' when nulls > 0 then 'null' else 'ok' end as status from g left join f on g.prompt = f.prompt and g.model = f.model""")
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    """Expected model by prompt grid against what is there."""
    rows = load(spark, sf, "events", ["user_id", "event_type", "value"]).select(F.col("user_id").alias("model"), F.col("event_type").alias("prompt"), "value")
    prompts = rows.select("prompt").distinct().agg(F.collect_list("prompt").alias("p"))  # a handful of names, one row
    grid = rows.select("model").distinct().join(F.broadcast(prompts)).select(F.explode("p").alias("prompt"), "model")
    found = rows.groupBy("prompt", "model").agg(F.count("*").alias("n"), F.sum((F.col("value") < 1).cast("int")).alias("nulls"))
    return S.coverage(grid, found, ["prompt", "model"], "n", 15)


@query("""with c as (select user_id as model, event_type as prompt, avg(value) as s from events group by 1, 2), p as (select c.prompt, c.s - b.s as delta from c join c b on c.model = b.model and b.prompt = 'view' where c.prompt <> 'view')
select prompt, round(avg(delta), 6) as mean_delta, count(*)::bigint as compared, sum((delta > 0)::int)::bigint as improved from p group by 1""")
def instruction_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Mean difference of each prompt to the base prompt over models."""
    cells = load(spark, sf, "events", ["user_id", "event_type", "value"]).groupBy(F.col("user_id").alias("model"), F.col("event_type").alias("prompt")).agg(F.avg("value").alias("s"))
    base = cells.where("prompt = 'view'").select("model", F.col("s").alias("base"))
    deltas = cells.where("prompt <> 'view'").join(base, "model").withColumn("delta", F.col("s") - F.col("base"))
    return rounded(deltas.groupBy("prompt").agg(F.avg("delta").alias("mean_delta"), F.count("*").alias("compared"), F.sum((F.col("delta") > 0).cast("int")).alias("improved")), "mean_delta")


@query("with c as (select user_id as model, event_type as prompt, avg(value) as s from events group by 1, 2), r as (select *, row_number() over (partition by model order by s desc, prompt) as rn from c) select model, prompt, round(s, 6) as score from r where rn = 1")
def best_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The best prompt of each model; of equal ones the first."""
    cells = load(spark, sf, "events", ["user_id", "event_type", "value"]).groupBy(F.col("user_id").alias("model"), F.col("event_type").alias("prompt")).agg(F.avg("value").alias("s"))
    best = cells.groupBy("model").agg(F.min_by(F.struct("prompt", "s"), F.struct((-F.col("s")).alias("x"), "prompt")).alias("b"))
    return rounded(best.select("model", F.col("b.prompt").alias("prompt"), F.col("b.s").alias("score")), "score")


@query("""with c as (select user_id as model, event_type as prompt, avg(value) as s from events group by 1, 2)
select model, coalesce(max(case when prompt = 'click' then format('{:.3f}', round(s, 3)) end), '-') as click, coalesce(max(case when prompt = 'view' then format('{:.3f}', round(s, 3)) end), '-') as view, coalesce(max(case when prompt = 'nothing' then format('{:.3f}', round(s, 3)) end), '-') as nothing from c group by 1""")
def pivot_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Models by prompts, '-' for missing cells."""
    rows = load_placed(spark, sf, "events", ["user_id", "event_type", "value"])
    # sums in the table's order, as the SQL has them in one thread: means that lie between two thousandths must not turn on how rows are dealt
    held = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("file", "row", "value"))))
    cells = rows.groupBy(F.col("user_id").alias("model"), F.col("event_type").alias("prompt")).agg(held.alias("z"))
    mean = F.when(F.size("z") > 0, F.aggregate("z", F.lit(0.0), lambda a, x: a + x["value"]) / F.size("z"))
    cells = cells.select("model", "prompt", (F.round(mean * 1000) / 1000).alias("s"))
    return S.pivot_cells(cells, "model", "prompt", "s", ["click", "view", "nothing"])


@query("""with s as (select s_suppkey, s_nationkey, s_acctbal, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier), k as (select * from s where rn = 1), r as (select *, rank() over (order by s_acctbal desc) as borda from k)
select n_name, s_suppkey, round(s_acctbal, 6) as score, borda::double as borda from nation left join r on n_nationkey = s_nationkey""")
def leaderboard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Keep-first after a sort, then a left join that shows what has no entry, with average ranks."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey")
    kept = load(spark, sf, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    ranked = average_rank(kept, "s_acctbal", ascending=False, out="borda")
    return load(spark, sf, "nation").join(ranked, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", "s_suppkey", F.round("s_acctbal", 6).alias("score"), F.col("borda").cast("double").alias("borda"))


@query("select event_id, round(value, 6) as value from events where event_id not in (select event_id from events where event_type = 'view')")
def incremental_resume(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of events, of which only what has no checkpoint entry is written."""
    rows = load(spark, sf, "events", ["event_id", "event_type", "value"])
    done = rows.where("event_type = 'view'").select("event_id")
    out = shared_folder(spark, "resume")
    score_new(stream(spark, sf, "events", rows.columns), lambda batch: S.unseen(batch, done, "event_id").select("event_id", "value"), f"{out}/rows", f"{out}/log").awaitTermination()
    return rounded(spark.read.parquet(f"{out}/rows").select("event_id", "value"), "value")


@query("select c_custkey, coalesce(o, c_acctbal) as spend, o is null as fallback from (select c_custkey, c_acctbal, round(sum(o_totalprice), 4) as o from customer left join orders on c_custkey = o_custkey group by 1, 2)")
def coalesce_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A left join whose missing measurements come from a fallback column."""
    sums = load(spark, sf, "orders", ["o_custkey", "o_totalprice"]).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("o"))
    rows = load(spark, sf, "customer", ["c_custkey", "c_acctbal"]).join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("o", "c_acctbal").alias("spend"), F.col("o").isNull().alias("fallback"))


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 as row_idx from orders")
def row_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Gapless positions in a total order, numbered range by range."""
    return with_row_idx(load(spark, sf, "orders", ["o_orderkey"]), "o_orderkey")


@query("""with x as (select 0 as split_no, l_returnflag as f, l_quantity as q from lineitem where l_linestatus = 'F' union all select 1, l_returnflag, l_quantity from lineitem where l_linestatus <> 'F') select split_no, f, count(*)::bigint as n, round(sum(q), 4) as q from x group by 1, 2""")
def union_of_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem", ["l_linestatus", "l_returnflag", "l_quantity"])
    both = union_splits(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus <> 'F'"))
    return rounded(both.groupBy("split_no", F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")), "q", digits=4)


@query("""select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'P'""")
def orphan_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Set difference: keys without a match."""
    return load(spark, sf, "customer", ["c_custkey"]).distinct().join(load(spark, sf, "orders", ["o_custkey", "o_orderstatus"]).where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""select window_start as start, event_type, n, total from (select date_trunc('hour', ts) as window_start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2)""")
def windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of a stream of events; all windows are written again after each batch."""
    events = stream(spark, sf, "events", ["ts", "event_type", "value"])
    out = shared_folder(spark, "windows")
    latest(hourly(events, "ts", ["event_type"], "value"), f"{out}/rows", f"{out}/log").awaitTermination()
    found = spark.read.parquet(f"{out}/rows")
    return rounded(found, "total", digits=4)


def _succeeds(attempt: str) -> str:
    return sql_hash(f"'{attempt}|' || event_id") + " % 2 = 0"


@query(f"select event_id, case when {_succeeds('1')} then 1 when {_succeeds('2')} then 2 when {_succeeds('3')} then 3 end::int as attempt from events")
def retried_work(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is tried up to three times, half of them fail each time; a null attempt marks what is left."""

    def work(left: DataFrame, attempt: int) -> DataFrame:
        return left.where(portable_hash(str(attempt), F.col("event_id")) % 2 == 0)

    done, left = tried(load(spark, sf, "events", ["event_id"]), "event_id", work, 3, shared_folder(spark, "tries"))
    return done.select("event_id", "attempt").unionByName(left.select("event_id", F.lit(None).cast("int").alias("attempt")))
