"""Queries on binary matrices, progress, keyed upserts, partial rewrites, whole shards, row sets and request batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.portable import portable_hash, sql_hash
from ..operators import rewrites as W
from ..operators import rowsets as B
from ..sources import matrices as M
from ..sources import partial as P
from ..sources.tables import load, shared_folder, stream, with_row_idx
from ..streaming import progress as G
from ..streaming import upserts as U
from .common import query, rounded


@query("""with e as (select row_number() over (order by vec_id) - 1 as "row", list_transform(embedding, lambda x: floor(x::double * 64) / 64) as v from embeddings)
select "row", len(v)::int as n, round(list_sum(v), 6) as total, round(list_sum(list_transform(v, lambda x: abs(x))), 6) as spread from e""")
def matrix_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings, in steps that half precision holds, written as .npy chunks and as interleaved pairs and read back by range."""
    rows = with_row_idx(load(spark, sf, "embeddings", ["vec_id", "embedding"]), "vec_id").select(F.col("row_idx").alias("row"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 64) / 64).alias("values"))
    folder = shared_folder(spark, "matrices")
    M.write_matrix(rows, f"{folder}/npy")
    back = M.read_matrix(spark, f"{folder}/npy")
    half = back.select("row", F.col("values").alias("first"), F.transform("values", F.abs).alias("second"))
    M.write_matrix(half, f"{folder}/pairs", "pairs")
    columns = str(rows.select(F.max(F.size("values"))).first()[0] or 1)
    read = M.read_matrix(spark, f"{folder}/pairs", "pairs", columns=columns)

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    return rounded(read.select("row", F.size("first").alias("n"), total("first").alias("total"), total("second").alias("spread")), "total", "spread")


@query("""select l_returnflag, l_linestatus, count(*)::bigint as n, round(avg(l_quantity), 6) as mean, true as grew from lineitem group by 1, 2""")
def progress_partials(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregates of all line items, written after each step of a run: the last ones, and whether counts never fell from step to step and
    rose from the first to the last."""
    folder = shared_folder(spark, "progress")
    items = G.written_items(load(spark, sf, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity"]), folder, 1 << 20)
    keys = ["l_returnflag", "l_linestatus"]
    G.run_with_progress(spark, items, lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total")), folder).awaitTermination()
    steps = G.partials(spark, folder).groupBy("step").agg(F.sum("n").alias("n"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("step", "n"))), lambda x: x["n"])
    grew = steps.agg((F.array_sort(F.collect_list("n")) == order).alias("grew"))
    found = G.whole(spark, folder).select(*keys, "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"))
    return found.join(F.broadcast(grew))  # one row


@query("""select user_id, event_type, max(event_id) as version, arg_max(value, event_id) as value from events group by 1, 2""")
def match_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Each event comes twice; a user's newest one of each type is kept, once."""
    sink, checkpoint = shared_folder(spark, "matches"), shared_folder(spark, "matches-state")
    rows = stream(spark, sf, "events", ["user_id", "event_type", "event_id", "value", "ts"]).withColumnRenamed("event_id", "version").withColumn("ts", F.col("ts").cast("timestamp"))
    keys = ["user_id", "event_type"]
    U.upsert(rows.unionByName(rows), keys, "version", "ts", sink, checkpoint).awaitTermination()
    return U.current(spark, sink, keys, "version").select(*keys, "version", "value")


@query("""select o_orderkey, o_custkey, case when o_custkey % 50 = 7 then 'patched' else o_orderstatus end as status, case when o_custkey % 50 = 7 then null else o_totalprice end as price from orders union all
select -c_custkey, c_custkey, 'added', null from customer where c_custkey % 50 = 8""")
def patched_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders kept in parts by customer; changes of some customers' orders and new rows rewrite the parts that they fall in."""
    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]).select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    path = shared_folder(spark, "orders")
    P.write_parts(orders, path, "o_orderkey", 32)
    changed = orders.where("o_custkey % 50 = 7").select("o_orderkey", F.lit("patched").alias("status"), F.lit(None).cast("double").alias("price"))
    P.patch(spark, path, changed, "o_orderkey", 32)
    added = load(spark, sf, "customer", ["c_custkey"]).where("c_custkey % 50 = 8").select((-F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("added").alias("status"))
    P.patch(spark, path, added, "o_orderkey", 32)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "status", "price")


@query("""with l as (select l_suppkey as run, l_linenumber - 1 as shard, 7 as shards, count(*) as n, count(distinct l_returnflag) as flags from lineitem group by 1, 2),
s as (select run, count(*) as n, max(shard) as last, min(shard) as first, sum((n % 13 = 0)::int) as short, max(flags) as most, min(flags) as least from l group by 1)
select run, 7 as shards, case when most <> least then 'shards differ in flags' when n < 7 or first <> 0 or last <> 6 then 'shards are missing: ' || (7 - n) when short > 0 then 'shards without all their rows: ' || short end as fault from s""")
def shard_faults(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's line items by line number are a run's shards: which runs may be merged, and why others not."""
    items = load(spark, sf, "lineitem", ["l_suppkey", "l_linenumber", "l_returnflag"])
    shards = items.groupBy(F.col("l_suppkey").alias("run"), (F.col("l_linenumber") - 1).alias("shard")).agg(F.count("*").alias("n_rows"), F.count_distinct("l_returnflag").alias("flags"))
    stated = shards.withColumn("shards", F.lit(7)).withColumn("n_stated", F.col("n_rows") + (F.col("n_rows") % 13 == 0).cast("int"))
    return P.shard_faults(stated, ["flags"])


@query("""with r as (select row_number() over (order by doc_id) - 1 as i, doc_id, source, lang from documents) select source,
 count(*) filter (lang = 'en')::bigint as both, count(*) filter (lang = 'en' or doc_id % 3 = 0)::bigint as either, count(*) filter (lang is distinct from 'en')::bigint as without, min(i) filter (lang = 'en') as first_row from r group by 1""")
def domain_row_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Row sets of sources, a language and ids, written as bitmaps and met by set algebra: sizes within each source."""
    rows = with_row_idx(load(spark, sf, "documents", ["doc_id", "source", "lang"]), "doc_id")
    path = shared_folder(spark, "rowsets")
    tags = rows.select("row_idx", F.explode(F.array_compact(F.array(F.concat(F.lit("source:"), "source"), F.when(F.col("lang") == "en", F.lit("lang:en")), F.when(F.col("doc_id") % 3 == 0, F.lit("third"))))).alias("domain"))
    B.write_index(tags, path, "row_idx", "domain")
    index = B.read_index(spark, path)
    sources, english, third = (index.where(F.col("domain").startswith("source:")), B.rows_of(index, "lang:en"), B.rows_of(index, "third"))
    both, either = B.meet(sources, english, "and"), B.meet(sources, B.meet(english, third, "or"), "and")
    found = B.size(sources, "n").join(B.size(both, "both"), "domain", "left").join(B.size(either, "either"), "domain", "left").join(B.first_row(both, "first_row"), "domain", "left").na.fill(0, ["both", "either"])
    return found.select(F.substring("domain", 8, 99).alias("source"), "both", "either", (F.col("n") - F.col("both")).alias("without"), "first_row")


@query("""with q as (select o_custkey as batch, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select batch, count(*)::bigint as asked, count(*) filter (id % 5 <> 0)::bigint as answered, count(*) filter (id % 5 = 0)::bigint as missing, count(*) filter (id % 5 <> 0 and id % 7 = 0)::bigint as repeated, count(*) filter (id % 11 = 0)::bigint as surplus,
 coalesce(string_agg(case when id % 5 <> 0 then 'a' || id else '' end, ',' order by n), '') as answers from q group by 1""")
def batch_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that come out of order, some lost, some twice and some to nothing asked, put back in the order of the requests; and what
    each batch lacks or has too much."""
    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    asked = orders.select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("id"))
    answer = F.concat(F.lit("a"), F.col("id").cast("string"))
    came = asked.where("id % 5 <> 0").withColumn("answer", answer).withColumn("place", F.lit(1))
    again = came.where("id % 7 = 0").withColumn("answer", F.lit("late")).withColumn("place", F.lit(2))
    surplus = asked.where("id % 11 = 0").select("batch", (-F.col("id") - 1).alias("id"), F.lit("stray").alias("answer"), F.lit(1).alias("place"))
    answers = came.unionByName(again).unionByName(surplus).orderBy(F.xxhash64("id", "place"))
    return B.reassembled(asked, answers, "batch", "id", "answer", "place")


@query(f"""with j as (select l_partkey as query, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) as pos,
  {sql_hash("'e7|' || l_partkey || '|' || l_suppkey")} as score, floor(l_discount * 50 + 0.5)::double as relevance from lineitem),
r as (select *, row_number() over (partition by query order by score desc, pos) as rk, row_number() over (partition by query order by relevance desc, pos) as irk from j),
s as (select query, sum(case when rk <= 10 then (pow(2, relevance) - 1) / log2(rk + 1) else 0 end) as dcg, sum(case when irk <= 10 then (pow(2, relevance) - 1) / log2(irk + 1) else 0 end) as ideal from r group by 1),
d as (select p_brand, case when ideal = 0 then 0 else dcg / ideal end as ndcg from s join part on query = p_partkey)
select 'full-full' as task, p_brand as branch, round(avg(ndcg), 6) as mean, count(*)::bigint as n from d group by 2 union all select 'full-full', null, round(avg(ndcg), 6), count(*)::bigint from d""")
def evaluation_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Parts rank the suppliers of their items, scored by a hash that takes an option, some files of parts a step."""
    items = load(spark, sf, "lineitem", ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_discount"])
    listed = items.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", F.floor(F.col("l_discount") * 50 + 0.5).cast("double").alias("gain")))).alias("z"))
    parts = load(spark, sf, "part", ["p_partkey", "p_name", "p_type", "p_brand"]).join(listed, F.col("p_partkey") == F.col("l_partkey"))
    queries = parts.select(F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("problem"), F.col("p_type").alias("solution"), F.array("p_brand").alias("domains"), F.col("z.l_suppkey").alias("candidates"), F.col("z.gain").alias("relevance_scores"))
    documents = load(spark, sf, "supplier", ["s_suppkey", "s_name"]).select(F.col("s_suppkey").alias("row_idx"), F.col("s_name").alias("problem"), F.lit("").alias("solution"))
    folder = shared_folder(spark, "evaluation")

    def hashed(pairs: DataFrame, seed: str) -> DataFrame:
        return pairs.withColumn("score", portable_hash(seed, F.col("query"), F.col("doc")).cast("double"))

    found = G.evaluate_in_steps(G.written_items(queries, folder, 1000), documents, hashed, folder, files=4, tasks=["full-full"], options={"seed": "e7"})
    return rounded(found, "mean")


@query("select text, 'Instruct: find' || chr(10) || 'Query: ' || upper(text) as first, 'Instruct: find' || chr(10) || 'Query: ' || reverse(text) as second, n from (select p_name as text, count(*)::bigint as n from part where p_name is not null group by 1)")
def query_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name rewritten in two ways, once each, into a cache that is filled in batches; half of the names are there
    from an earlier run. The rewrites are met under an instruction."""
    names = load(spark, sf, "part", ["p_name"]).where("p_name is not null").select(F.col("p_name").alias("text"))
    folder = shared_folder(spark, "rewrites")

    def both(texts: list[str]) -> list[list[str]]:
        return [[t.upper(), t[::-1]] for t in texts]

    W.fill_cache(names.where(F.length("text") % 2 == 0), folder, both, 1)
    cache = W.fill_cache(names, folder, both, 3)
    found = W.samples_of(names, cache, strict=True).withColumn("r", W.reinstructed(F.col("rewrites"), "find"))
    return found.join(names.groupBy("text").agg(F.count("*").alias("n")), "text").select("text", F.get("r", F.lit(0)).alias("first"), F.get("r", F.lit(1)).alias("second"), "n")
