"""Reports of runs: their payloads, protocol ranks, checks, the leaderboard's star join, rank changes, pooled and packed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAYLOAD = "reports map<string,struct<error:string,model:string,prompt:struct<protocol:string,key:string>,k:int,exponent:double,tasks:array<struct<task:string,ndcg_at_k:double>>,ndcgs_by_task:map<string,array<double>>>>,query_row_idxs array<bigint>,domains array<array<string>>"


def payload(text: Column) -> Column:
    """A result file's text as a struct."""
    return F.from_json(text, PAYLOAD)


def report_of(body: Column) -> Column:
    """The first (only) report of a payload as a struct (key, value); null without one."""
    return F.try_element_at(F.map_entries(body["reports"]), F.lit(1))


def protocol_rank(report: Column) -> Column:
    """2 for the current protocol, 1 for another that the prompt names, 0 without a prompt."""
    return F.when(report["prompt"].isNull(), 0).when(F.coalesce(report["prompt"]["protocol"], F.lit("")) == "canonical", 2).otherwise(1)


def complete_tasks(files: DataFrame, report: str) -> DataFrame:
    """files with task, ndcg and n_done of each task of the report whose queries are all scored; tasks without stored scores
    count with n_done 0."""
    long = files.withColumn("_t", F.explode(F.col(report)["tasks"]))
    scores = F.coalesce(F.try_element_at(F.col(report)["ndcgs_by_task"], F.col("_t.task")), F.array().cast("array<double>"))
    done = F.size(F.filter(scores, lambda x: x.isNotNull()))
    return long.where((F.size(scores) == 0) | (done == F.size(scores))).select(*[c for c in files.columns], F.col("_t.task").alias("task"), F.col("_t.ndcg_at_k").alias("ndcg"), done.alias("n_done"))


def verified(runs: DataFrame, queries: int, k: int, exponent: float) -> DataFrame:
    """runs (n, k, exponent, prompt, key, shard, part, error) with the reason why a run is refused; null for accepted ones."""
    reason = (
        F.when(F.col("part").isNotNull() | F.col("shard").isNotNull(), "a part or shard")
        .when(F.col("error").isNotNull(), "an error")
        .when(F.col("n") != queries, F.concat(F.lit("queries: "), F.col("n").cast("string")))
        .when(F.col("k") != k, F.concat(F.lit("k: "), F.col("k").cast("string")))
        .when(F.col("exponent") != exponent, "exponent")
        .when(~F.col("prompt").eqNullSafe(F.col("key")), "prompt key")
    )
    return runs.withColumn("reason", reason)


def leaderboard(models: DataFrame, runs: DataFrame, ranks: DataFrame, intervals: DataFrame, key: str, current: int = 2) -> DataFrame:
    """models star-joined with runs (key, score), ranks (key, rank) and intervals (key, lo, hi): state is null for rows of the
    table, which have a place by score, else why a model is pending. The joins are left to the optimizer."""
    wide = models.join(runs, key, "left").join(ranks, key, "left").join(intervals, key, "left")
    state = F.when(F.col("score").isNull(), "not scored yet").when(F.coalesce("rank", F.lit(0)) < current, "scored with an older prompt")
    wide = wide.withColumn("state", state)
    places = wide.where("state is null").select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("place"))  # a row a model
    return wide.join(places, key, "left")


def rank_changes(scores: DataFrame, item: str, base: str, other: str) -> DataFrame:
    """Items whose rank differs between two scores: both ranks, the item that took the old place and left its own for it (null
    without), and how far the two were apart at first."""
    def rank(value: str) -> Column:
        return F.rank().over(Window.orderBy(F.desc(value)))  # a row an item: a report

    ranked = scores.select(item, base, rank(base).alias("before"), rank(other).alias("after")).where("before <> after")
    x, y = ranked.alias("x"), ranked.alias("y")
    swap = (F.col("x.before") == F.col("y.after")) & (F.col("x.after") == F.col("y.before"))
    return x.join(y, swap, "left").select(F.col(f"x.{item}").alias(item), "x.before", "x.after", F.col(f"y.{item}").alias("partner"), F.abs(F.col(f"x.{base}") - F.col(f"y.{base}")).alias("gap"))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with a whole number of degrees of freedom, by its finite series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cos2 = F.pow(F.cos(theta), 2)
    # terms of the series: each is the one before times cos^2 and (2i) / (2i + 1), or (2i - 1) / (2i) for even df
    odd = (df % 2) == 1
    n = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    start = F.struct(F.when(odd, F.cos(theta)).otherwise(F.lit(1.0)).alias("term"), F.when(odd, F.cos(theta)).otherwise(F.lit(1.0)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * cos2 * F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, step)["sum"]
    inside = F.when(odd, 2 / F.lit(3.141592653589793) * (theta + F.when(df > 1, F.sin(theta) * series).otherwise(0.0))).otherwise(F.sin(theta) * series)
    return F.greatest(F.lit(0.0), 1 - inside)


def correlation_tests(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by.., n, pearson, pearson_p, spearman, spearman_p) within groups; null below two rows or where a column is constant,
    p-values null below three rows."""
    from .statistics import spearman

    found = spearman(rows, a, b, by)

    def p(r: Column) -> Column:
        rest = F.col("n") - 2
        t = F.abs(r) * F.sqrt(rest / (1 - r * r))
        return F.when(rest < 1, None).when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(t, rest))

    clean = found.withColumns({c: F.when((F.col("n") >= 2) & ~F.isnan(c), F.col(c)) for c in ("pearson", "spearman")})
    return clean.select(*by, "n", "pearson", p(F.col("pearson")).alias("pearson_p"), "spearman", p(F.col("spearman")).alias("spearman_p"))


def pooled(parts: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of each key the row of the last part: later ones win."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return parts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def checked_parts(parts: DataFrame, base: str, model: str, index: str, value: str) -> DataFrame:
    """parts (base, part, model, index, domain, value) to a row a base: models, overlaps (an index with a value in two parts),
    conflicts (an index with two domains), missing (indices without a value) and ok."""
    each = parts.groupBy(base, index).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col("part"))).alias("_owners"), F.countDistinct("domain").alias("_domains"))
    sums = each.groupBy(base).agg(*[F.sum(c.cast("int")).cast("long").alias(n) for n, c in (("overlaps", F.col("_owners") > 1), ("conflicts", F.col("_domains") > 1), ("missing", F.col("_owners") == 0))])
    models = parts.groupBy(base).agg(F.countDistinct(model).alias("models"), F.countDistinct("part").alias("parts"))
    ok = (F.col("models") == 1) & (F.col("overlaps") == 0) & (F.col("conflicts") == 0) & (F.col("missing") == 0)
    return models.join(sums, base).withColumn("ok", ok)


def zipped(left: DataFrame, right: DataFrame, idx: str = "row_idx") -> DataFrame:
    """Rows joined by position; a position on one side only raises."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), idx, "full")
    lost = F.raise_error(F.concat(F.lit("tables differ in length at row "), F.col(idx).cast("string"))).cast("boolean")
    return both.where(F.when(F.col("_l").isNull() | F.col("_r").isNull(), lost).otherwise(True)).drop("_l", "_r")


def upserted(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the columns of new where it has the key; state tells kept, replaced and orphan rows (keys that old lacks, whose
    other columns are null)."""
    fresh = new.select(key, F.struct(*columns).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(fresh, key, "full")
    state = F.when(F.col("_old").isNull(), "orphan").when(F.col("_new").isNull(), "kept").otherwise("replaced")
    return both.withColumns({c: F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")) for c in columns} | {"state": state}).drop("_old", "_new")


def packed(sizes: Column, most: int) -> Column:
    """The bin of each size of an array, filled in order: a bin that would pass `most` is closed, and a larger size has its own."""
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("bins"))

    def step(acc: Column, size: Column) -> Column:
        opens = (acc["held"] > 0) & (acc["held"] + size > most)
        place = acc["bin"] + opens.cast("int")
        return F.struct(place.alias("bin"), F.when(opens, size.cast("long")).otherwise(acc["held"] + size).alias("held"), F.concat(acc["bins"], F.array(place)).alias("bins"))

    return F.aggregate(sizes, start, step)["bins"]


def joined_gradings(samples: DataFrame, keys: list[str], grading: str, order: str) -> DataFrame:
    """Samples with equal keys become one, with their lists of gradings one after the other."""
    parts = F.array_sort(F.collect_list(F.struct(order, grading)))
    return samples.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda x: x[grading])).alias(grading))


def strict_split(samples: DataFrame, problem: str, grading: str, patterns: list[str]) -> DataFrame:
    """samples with test: those of problems that a pattern matches at the start, or whose samples all have several gradings."""
    named = F.lit(False)
    for p in patterns:
        named = named | F.col(problem).rlike(f"^(?:{p})")
    several = samples.groupBy(problem).agg(F.bool_and(F.size(grading) > 1).alias("_several"))
    return samples.join(several, problem).withColumn("test", named | F.col("_several")).drop("_several")


def ranks_with_rephrasings(scores: DataFrame, rephrased: DataFrame, own: DataFrame, query: str, doc: str) -> DataFrame:
    """(query, rank, rank_with_all): 1 and the corpus documents strictly better than the own one (query, doc, score), which
    is left out itself; then also the other rephrasings that are."""
    mine = own.select(query, F.col(doc).alias("_doc"), F.col("score").alias("_score"))

    def better(rows: DataFrame, name: str) -> DataFrame:
        hits = rows.join(mine, query).where((F.col(doc) != F.col("_doc")) & (F.col("score") > F.col("_score")))
        return hits.groupBy(query).agg(F.count("*").alias(name))

    wide = mine.join(better(scores, "_c"), query, "left").join(better(rephrased, "_r"), query, "left")
    rank = 1 + F.coalesce("_c", F.lit(0))
    return wide.select(query, rank.alias("rank"), (rank + F.coalesce("_r", F.lit(0))).alias("rank_with_all"))
