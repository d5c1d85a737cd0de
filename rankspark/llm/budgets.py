"""Nested thresholds over hash histograms: what to take from each group so that summed weights meet a budget, without a sort.

Each row has a weight and a 48-bit hash. A first pass sums weights by (group, top 12 bits) and finds, per group, the bucket in
which the running sum crosses the budget. Only that boundary bucket is refined by the next 12 bits, and so on. What is under
the final threshold is taken. One row a group and pass reaches the driver. Budgets are nested: a larger one takes all that a
smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, staged

STEP, LEVELS = 12, 4
SPAN = 1 << (STEP * LEVELS)


def spread(*keys: Column) -> Column:
    """A 48-bit hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - STEP * LEVELS)


def thresholds(rows: DataFrame, budgets: dict[int, float], group: str = "g", weight: str = "w", place: str = "h") -> dict[int, int]:
    """rows (group int, weight long, place long) and a budget a group: for each group the threshold t at which the weights of
    the rows with place < t are nearest to the budget, as far as hashes part them."""
    spark = rows.sparkSession
    active = {g: (0, float(left)) for g, left in budgets.items()}
    done: dict[int, int] = {}
    for level in range(LEVELS):
        if not active:
            break
        shift = STEP * (LEVELS - 1 - level)
        width = 1 << (shift + STEP)
        bounds = spark.createDataFrame([(g, low, left) for g, (low, left) in active.items()], "q int, low long, left double")
        part = rows.join(F.broadcast(bounds), F.col(group) == F.col("q")).where((F.col(place) >= F.col("low")) & (F.col(place) < F.col("low") + width))
        sums = part.groupBy("q", F.shiftright(F.col(place), shift).alias("b")).agg(F.sum(weight).alias("s"), F.count("*").alias("n"), F.first("left").alias("left"))
        running = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("q").orderBy("b")))
        crossing = running.where("upto > left").groupBy("q").agg(F.min(F.struct("b", "s", "n", "upto")).alias("at"))
        found = {r["q"]: r["at"] for r in crossing.collect()}
        following = {}
        for g, (low, left) in active.items():
            if g not in found:
                done[g] = low + width
                continue
            b, s, n, upto = found[g]
            left -= upto - s
            if n == 1 or level == LEVELS - 1:
                # one row, or rows that hashes do not part: whichever side is nearer
                done[g] = (b + (s - left < left)) << shift
            else:
                following[g] = (b << shift, left)
        active = following
    return done


def spread_thresholds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """thresholds() for any number of groups: rows (g, w, h) and bounds (q, low 0, left) to (q, below), without a row of either on
    the driver."""
    active, done = staged(bounds, "bounds"), []
    for level in range(LEVELS):
        shift = STEP * (LEVELS - 1 - level)
        width = 1 << (shift + STEP)
        part = lookup(rows, "g", active.withColumnRenamed("q", "g"), "h").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width))
        sums = part.groupBy("g", F.shiftright("h", shift).alias("b")).agg(F.sum("w").alias("s"), F.count("*").alias("n"), F.first("left").alias("left"))
        running = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("g").orderBy("b")))
        crossing = running.where("upto > left").groupBy("g").agg(F.min(F.struct("b", "s", "n", "upto")).alias("at"))
        at = active.join(crossing.hint("merge"), F.col("q") == F.col("g"), "left").select("q", "low", "left", "at.*")
        at = staged(at.withColumn("rest", F.col("left") - (F.col("upto") - F.col("s"))), "crossing")
        last = (F.col("n") == 1) | F.lit(level == LEVELS - 1)
        ends = F.when(F.col("b").isNull(), F.col("low") + width).otherwise(F.shiftleft(F.col("b") + (F.col("s") - F.col("rest") < F.col("rest")).cast("long"), shift))
        done.append(at.where(F.col("b").isNull() | last).select("q", ends.alias("below")))
        active = at.where(F.col("b").isNotNull() & ~last).select("q", F.shiftleft("b", shift).alias("low"), F.col("rest").alias("left"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
