"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its weight's share of the total, stopped at `MOST` times its size; what is over is shared again by
weight among the others until none is above. A source whose target is q times its size gives every document floor(q) times,
and once more those under a threshold of the documents' hashes, found by nested histograms (see budgets.py).

Sizes count words between space and 0x09-0x0D; null texts have size 0. Sources are ordered by code point (that of UTF-8
bytes), null last, and weigh 1, 2, 3, repeating. Up to `FEW_SOURCES` (they are counted) the plan of a row a source is worked
out on the driver and broadcast; beyond it sources are numbered by range-partitioned counts, the water level is found by sums,
and thresholds and plan are looked up in salted parts, with the same result. Defined results: documents of size 0 take no words and are kept as they are; an empty table gives an empty table; rows that
repeat an id and a text are told apart by nothing and go together; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .budgets import spread, spread_thresholds, thresholds
from .common import lookup, staged

MOST, FEW_SOURCES = 3, 20_000


def word_count(text: Column) -> Column:
    """Runs of anything but space and 0x09-0x0D; null has none."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "\u0001"), r"[\x20\x09-\x0D]++", "")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], most: int = MOST) -> dict[str | None, float]:
    """The target of each source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    open_, left = list(order), float(sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        above = [s for s in open_ if left * weights[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weights[s] / total for s in open_}
            break
        for s in above:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in above)
        gone = set(above)
        open_ = [s for s in open_ if s not in gone]
    return out


def numbered(sources: DataFrame, by: str) -> DataFrame:
    """sources with g, their place by code point, null last: counts of sorted range partitions, summed."""
    ordered = F.col(by).asc_nulls_last()
    ranged = sources.repartitionByRange(ordered).sortWithinPartitions(ordered)
    placed = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("g", F.col("_before") + nth).drop("_part", "_at", "_n", "_before")


def spread_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources (n, and others) with target, as targets() gives it: the water level rises until no more sources are full."""
    known = staged(numbered(sources, "source").withColumn("weight", (F.col("g") % 3 + 1).cast("int")), "sources")
    total = known.agg(F.sum("n")).first()[0]
    level, full = 0.0, F.lit(False)
    while True:
        row = known.agg(F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w"), F.sum(F.when(full, most * F.col("n")).otherwise(0)).alias("kept")).first()
        if not row["w"]:
            break
        rose = (total - row["kept"]) / row["w"]
        if rose <= level:
            break
        level = rose
        full = F.lit(level) * F.col("weight") > most * F.col("n")
    return known.withColumn("target", F.when(full, (most * F.col("n")).cast("double")).otherwise(F.lit(level) * F.col("weight")))


def _large_plan(slim: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """_plan() for any number of sources, without a row of them on the driver."""
    goal = spread_targets(found, most).withColumn("whole", F.when(F.col("n") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("n")).cast("int"))).otherwise(0))
    goal = staged(goal.withColumn("left", F.col("target") - F.col("whole") * F.col("n")).withColumn("s", _tag("source")), "goals")
    rows = lookup(slim.where("size > 0").withColumn("s", _tag("source")), "s", goal.select("s", "g"), "h").select("g", F.col("size").alias("w"), "h")
    below = spread_thresholds(staged(rows, "rows"), goal.where("n > 0 and left >= 0.5").select(F.col("g").alias("q"), F.lit(0).cast("long").alias("low"), "left"))
    joined = goal.join(below.hint("merge"), goal["g"] == below["q"], "left")
    return joined.select("source", F.col("n").alias("source_size"), "target", "whole", F.coalesce("below", F.lit(0)).cast("long").alias("below"))


def _tag(source: str) -> Column:
    """The source as a key without null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _planned(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows (source, h) with the plan of their source."""
    tagged = plan.withColumn("_s", _tag("source")).drop("source")
    rows = rows.withColumn("_s", _tag("source"))
    return (rows.join(F.broadcast(tagged), "_s") if few else lookup(rows, "_s", tagged, "h")).drop("_s")


def _plan(slim: DataFrame, most: int) -> tuple[DataFrame | None, bool]:
    """slim (id, source, size, h) to a row a source (source, source_size, target, whole, below), and whether they are few."""
    spark = slim.sparkSession
    summed = staged(slim.groupBy("source").agg(F.sum("size").alias("n")), "sources")
    if summed.count() > FEW_SOURCES:
        return staged(_large_plan(slim, summed, most), "plan"), False
    sizes = {r["source"]: r["n"] for r in summed.collect()}
    if not sizes:
        return None, True
    goal = targets(sizes, most)
    number = {s: i for i, s in enumerate(sizes)}
    whole = {s: min(most, int(goal[s] // n)) if n else 0 for s, n in sizes.items()}
    budgets = {number[s]: goal[s] - whole[s] * n for s, n in sizes.items() if n and goal[s] - whole[s] * n >= 0.5}
    names = spark.createDataFrame([(s, i) for s, i in number.items()], "source string, g int")
    rows = slim.join(F.broadcast(names), slim["source"].eqNullSafe(names["source"])).select("g", F.col("size").alias("w"), "h").where("w > 0")
    below = thresholds(rows, budgets)
    return spark.createDataFrame([(s, sizes[s], goal[s], whole[s], below.get(i, 0)) for s, i in number.items()], "source string, source_size long, target double, whole int, below long"), True


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken (words, repeats counted)."""
    slim = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), spread(F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("h"))
    slim = staged(slim, "sizes")
    plan, few = _plan(slim, most)
    if plan is None:
        return slim.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    joined = _planned(slim, plan, few)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + (F.col("h") < F.col("below")).cast("int"))).alias("taken"))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """The documents as often as the mix takes them, in their own columns; those without words stay once."""
    hashed = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    slim = staged(documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), spread(F.col(id_col), hashed).alias("h")), "sizes")
    plan, few = _plan(slim, most)
    if plan is None:
        return documents
    packed = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), F.col(source_col).alias("source"), spread(F.col(id_col), hashed).alias("h"))
    joined = _planned(packed, plan, few)
    times = F.when(word_count(F.col("row").getField(text_col)) == 0, 1).otherwise(F.col("whole") + (F.col("h") < F.col("below")).cast("int"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")
