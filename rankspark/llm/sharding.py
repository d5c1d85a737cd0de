"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned, and
overfull ranges are subdivided.

Records are ordered by (key, tie): a hash of the text, then the id and the place in the table. A record is sampled with a probability in proportion to its size, by a hash of itself, so
the boundaries are size-weighted quantiles. Boundaries cut the order into fine ranges; a range that
holds more than its share is subdivided by a denser sample of its own records, again and again until none is left but single
records: a range of one key (equal texts) is cut by its ties. Runs of neighbouring fine ranges then become the shards, each boundary at the end of
the fine range nearest to the ideal, so the shards' bytes are nearly equal.

Only DataFrame functions run on the executors. The driver holds the samples and the fine ranges, a number in proportion to
shards * FINE, never records. Defined results: null texts have size 1 and the checksum of no bytes; null ids come first; rows
that repeat an id and a text get a slot each; an empty table gives an empty table; equal keys are neighbours, so a group of
equal texts is cut only where a shard ends.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from itertools import count as count_from

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

FINE = 256


def order_key(*parts: Column) -> Column:
    """A binary string whose byte order is the order of the parts (longs; null first)."""
    each = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.lit("0"), F.lpad(F.hex(p.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))) for p in parts]
    return F.concat(*each)


def _draw(of: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(of, F.lit(seed)), 11) / F.lit(float(1 << 53))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def _numbered(rows: DataFrame, bounds: list[str]) -> DataFrame:
    """rows with r, the number of the range: how many of the ascending bounds are <= k. The bounds are one literal array,
    searched by halving."""
    if not bounds:
        return rows.withColumn("r", F.lit(0))
    held = F.split(F.lit(",".join(bounds)), ",")  # folded to one literal
    steps = max(1, len(bounds).bit_length())
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        def sided(mid: Column, right: Column) -> Column:
            return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when((acc["lo"] < acc["hi"]) & ~right, mid).otherwise(acc["hi"]).alias("hi"))

        # the bounds stand once in the plan: plans are kept as text on the driver
        return _let(F.floor((acc["lo"] + acc["hi"]) / 2).cast("int"), lambda mid: _let((acc["lo"] < acc["hi"]) & (F.get(held, mid) <= F.col("k")), lambda right: sided(mid, right)))

    place = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]
    return rows.withColumn("r", place)


def fine_ranges(rows: DataFrame, shards: int, fine: int = FINE) -> tuple[DataFrame, list[str], list[tuple[int, int]]]:
    """rows (p string, the key; k string, key and tie; size long) to rows with their range r, the bounds, and (bytes, rows) of
    each range. Samples are drawn by key, within a range of one key by tie. Every overfull range is cut in each round, at its
    largest key or tie if its sample gives no other, so the rounds end."""
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    goal = shards * fine
    bounds: list[str] = []
    if not count:
        return rows.withColumn("r", F.lit(0)), bounds, []
    share = max(1.0, total / goal)
    per_range = 8  # samples
    rate = F.least(F.lit(1.0), F.col("size") * F.lit(per_range / share))
    picked = sorted(r[0] for r in rows.where(_draw(F.col("p"), 0) < rate).select("p").distinct().collect())  # about per_range * goal
    bounds = sorted(set(picked[per_range::per_range]) if len(picked) > goal else set(picked[1:]))
    for attempt in count_from(1):
        numbered = staged(_numbered(rows, bounds), "numbered")
        ends = [f(c).alias(f"{name}_{c}") for c in ("p", "k") for name, f in (("lo", F.min), ("hi", F.max))]
        found = {r["r"]: r for r in numbered.groupBy("r").agg(F.sum("size").alias("s"), F.count("*").alias("n"), *ends).collect()}
        sums = {r: (x["s"], x["n"]) for r, x in found.items()}
        # of each overfull range the ends to cut between: keys, or the ties of its only key
        over = {r: ("p" if x["lo_p"] < x["hi_p"] else "k") for r, x in found.items() if x["s"] > 2 * share and x["n"] > 1}
        if not over:
            break
        # a denser sample of the overfull ranges alone
        place = F.when(F.col("r").isin(*[r for r, c in over.items() if c == "k"] or [-1]), F.col("k")).otherwise(F.col("p"))
        thin = F.col("r").isin(*sorted(over)) & (_draw(place, attempt) < F.least(F.lit(1.0), F.col("size") * F.lit(4 * per_range / share)))
        more: dict[int, list[str]] = {}
        for row in numbered.where(thin).select("r", place.alias("k")).distinct().collect():
            more.setdefault(row["r"], []).append(row["k"])
        extra = set()
        for r in over:
            keys = sorted(more.get(r, ()))
            wanted = max(2, int(2 * sums[r][0] / share))
            own = {keys[i * len(keys) // wanted] for i in range(1, wanted)} if len(keys) > wanted else set(keys)
            extra |= own - {found[r][f"lo_{over[r]}"]} or {found[r][f"hi_{over[r]}"]}
        bounds = sorted(set(bounds) | extra)
    return numbered, bounds, [(sums[i][0], sums[i][1]) if i in sums else (0, 0) for i in range(len(bounds) + 1)]


def cut(ranges: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Of each fine range its shard and the records of that shard before it; shard ends lie nearest to equal bytes."""
    sums = [0]
    for size, _ in ranges:
        sums.append(sums[-1] + size)
    ends = []
    for k in range(1, shards):
        ideal = sums[-1] * k / shards
        at = bisect_left(sums, ideal)
        if at and (at >= len(sums) or sums[at] - ideal > ideal - sums[at - 1]):
            at -= 1
        ends.append(max(at, ends[-1] if ends else 0))
    out, shard, before = [], 0, 0
    for i, (_, n) in enumerate(ranges):
        while shard < shards - 1 and i >= ends[shard]:
            shard, before = shard + 1, 0
        out.append((shard, before))
        before += n
    return out


def assign(records: DataFrame, shards: int) -> DataFrame:
    """records (p, k, size and any others; k, which begins with p, tells all rows apart) with shard int and slot long: ranges of k of nearly equal bytes,
    slots gapless from 0 in the order of k."""
    numbered, bounds, ranges = fine_ranges(records, shards)
    places = records.sparkSession.createDataFrame([(r, s, b) for r, (s, b) in enumerate(cut(ranges, shards))], "r int, shard int, before long")
    within = F.row_number().over(Window.partitionBy("r").orderBy("k"))
    return numbered.withColumn("within", within).join(F.broadcast(places), "r").withColumn("slot", F.col("before") + F.col("within") - 1).drop("r", "within", "before")


def shard_documents(documents: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = documents.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    slim = slim.select("doc_id", "size", "text_crc32", order_key(F.col("hash")).alias("p"), order_key(F.col("hash"), F.col("doc_id"), F.monotonically_increasing_id()).alias("k"))
    slim = staged(slim, "sizes")
    return assign(slim, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
