"""Correlations, inversions, bootstrap intervals, Pareto fronts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests
from .ranking import average_rank


def spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by.., pearson, spearman, n) of two columns within groups."""
    ranked = average_rank(average_rank(rows, a, by, out="_ra"), b, by, out="_rb")
    return ranked.groupBy(*by).agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), F.count("*").alias("n"))


def _descents(held: np.ndarray, bits: int, groups: int) -> np.ndarray:
    """descents() within each of `groups` groups, whose numbers stand above the lowest `bits` bits; groups in order."""
    total = np.zeros(groups, np.int64)
    for bit in reversed(range(bits)):
        # equal in all higher bits, held lies together and in its first order
        ones = held >> bit & 1
        before = np.cumsum(ones) - ones
        heads = np.concatenate(([True], np.diff(held >> bit + 1) != 0)) if len(held) else np.zeros(0, bool)
        before -= before[heads][np.cumsum(heads) - 1]
        zeros = ones == 0
        np.add.at(total, held[zeros] >> bits, before[zeros])
        held = held[np.argsort(held >> bit, kind="stable")]
    return total


def descents(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], for whole numbers from 0: bit by bit, from the highest, in n log n."""
    return int(_descents(values.astype(np.int64), int(values.max(initial=0)).bit_length(), 1)[0])


def _pairs(owner: np.ndarray, codes: np.ndarray, groups: int) -> np.ndarray:
    """Pairs of equal codes, group by group."""
    keys, counts = np.unique(owner * (int(codes.max(initial=0)) + 1) + codes, return_counts=True)
    total = np.zeros(groups, np.int64)
    np.add.at(total, keys // (int(codes.max(initial=0)) + 1), counts * (counts - 1) // 2)
    return total


def pair_statistics(rows: DataFrame, group: str, item: str, a: str, b: str) -> DataFrame:
    """(group, inversions, pairs, tau) over the pairs of items of a group: opposite orders, ties ignored; tau-b in which pairs
    tied in both columns count as ties of each. Pairs with a null are in no order and not tied. A group is one row of arrays, and a
    task counts a batch of groups at once, in n log n: no pair is made. Groups of one item have no row."""

    def coded(column: pa.Array) -> np.ndarray:
        return np.unique(column.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, sizes = batch.num_rows, pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(groups), sizes)
            x, y = (pc.list_flatten(batch.column(i)) for i in (1, 2))
            known = [np.asarray(c.is_valid()) for c in (x, y)]
            tied = [_pairs(owner[k], coded(c.drop_null()), groups) for c, k in zip((x, y), known, strict=True)]
            both = known[0] & known[1]
            of, first, second = owner[both], *[coded(c.filter(pa.array(both))) for c in (x, y)]
            order = np.lexsort((second, first, of))
            bits = int(second.max(initial=0)).bit_length()
            inversions = _descents((of << bits | second)[order], bits, groups)
            m = np.bincount(of, minlength=groups)
            same = coded(pa.array(first * (int(second.max(initial=0)) + 1) + second))
            agreeing = m * (m - 1) // 2 - _pairs(of, first, groups) - _pairs(of, second, groups) + _pairs(of, same, groups) - inversions
            tau = []
            for plus, minus, tied_x, tied_y in zip(agreeing.tolist(), inversions.tolist(), tied[0].tolist(), tied[1].tolist(), strict=True):
                # the denominator's factors: untied pairs and those tied in the other column alone or in both
                scale = math.sqrt((plus + minus + tied_x) * (plus + minus + tied_y))
                tau.append((plus - minus) / scale if scale else None)
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(inversions), pa.array(sizes * (sizes - 1) // 2), pa.array(tau, pa.float64())], names=["g", "inversions", "pairs", "tau"])
            yield found.filter(pa.array(sizes > 1))

    slim = rows.select(F.col(group).alias("g"), F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("z")).groupBy("g").agg(F.collect_list("z").alias("z"))
    kind = slim.schema["g"].dataType.simpleString()
    return slim.select("g", "z.a", "z.b").mapInArrow(run, f"g {kind}, inversions long, pairs long, tau double").withColumnRenamed("g", group)


#: Values in one array of the broadcast table: two to so many bits.
BLOCK_BITS = 16
#: Draws hashed at once, some thirty bytes each.
LANES = 50_000


def _resampled(start: str, held: np.ndarray, known: np.ndarray | None, k: int, reps: range) -> list[float | None]:
    """Means of k draws from held for each of reps; null where no drawn value is known."""
    sums, counts = np.zeros(len(reps)), np.full(len(reps), k if known is None else 0, np.int64)
    for low, high in digests.same_length(reps.start, reps.stop):
        starts = [f"{start}|{rep}|".encode() for rep in range(low, high)]
        for begin, end in digests.same_length(0, k):
            for first in range(begin, end, LANES):
                n = min(end - first, LANES)
                digits = digests.digit_words(np.arange(first, first + n), len(starts[0]))
                step = max(1, LANES // n)
                for at in range(0, len(starts), step):
                    idx = digests.hashes(starts[at : at + step], digits, len(str(first)), n)
                    if len(held) < 1 << 32:
                        idx %= np.uint32(len(held))
                    to = slice(low - reps.start + at, low - reps.start + at + len(idx))
                    sums[to] += held.take(idx).sum(axis=1)
                    if known is not None:
                        counts[to] += known.take(idx).sum(axis=1)
    return [s / c if c else None for s, c in zip(sums.tolist(), counts.tolist(), strict=True)]


def bootstrap(values: DataFrame, group: str, value: str, draws: dict[str, int | None], reps: int, seed: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(group, mean, lo, hi): percentile intervals of `reps` resampled means. draws: the rows drawn for each group, or None for
    its full length. values (group, idx from 0 without gaps, value); draws come from hashes of (seed, group, rep, draw). The values
    are broadcast, 8 bytes each; a task holds those of a group, and hashes the draws of its resamples in arrays."""
    stats = values.groupBy(group).agg(F.count("*").alias("size"), F.avg(value).alias("mean"))
    wanted = values.sparkSession.createDataFrame([(g, n) for g, n in draws.items()], f"{group} string, wanted int")
    plan = stats.join(F.broadcast(wanted), group).select(F.col(group).alias("g"), "size", F.coalesce("wanted", "size").alias("k"), "mean")
    bits = BLOCK_BITS
    step = max(50, -(-reps // 200))
    parts = -(-reps // step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[str, int], list] = {}  # values of a group, which of them are known, how many are there
        for batch in batches:
            for i in range(batch.num_rows):
                g, size, k, mean, first, block = (batch.column(c)[i].as_py() for c in range(6))
                piece = batch.column(6)[i].values
                own = met.setdefault((g, first), [np.empty(size), None, 0])
                place = slice(block << bits, (block << bits) + len(piece))
                if piece.null_count:
                    own[1] = np.ones(size, bool) if own[1] is None else own[1]
                    own[1][place] = np.asarray(piece.is_valid())
                own[0][place] = piece.fill_null(0.0).to_numpy()
                own[2] += len(piece)
                if own[2] == size:
                    held, known, _ = met.pop((g, first))
                    means = _resampled(f"{seed}|{g}", held, known, k, range(first, min(first + step, reps)))
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(means)), pa.array([mean] * len(means), pa.float64()), pa.array(means, pa.float64())], names=["g", "mean", "m"])

    # a task is one row, which meets a row for each group and the blocks of its values: no draw is a row or shuffled
    tasks = values.sparkSession.range(0, reps, step, parts).withColumnRenamed("id", "first")
    asked = tasks.crossJoin(F.broadcast(plan)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("size") - 1, bits))))
    held = F.array_sort(F.collect_list(F.struct("idx", F.col(value).cast("double").alias("v"))))["v"]
    blocks = values.groupBy(F.col(group).alias("g"), F.shiftright("idx", bits).alias("block")).agg(held.alias("held"))
    met = asked.join(F.broadcast(blocks), ["g", "block"]).select("g", "size", "k", "mean", "first", "block", "held")
    means = met.mapInArrow(run, "g string, mean double, m double")
    interval = means.groupBy("g").agg(F.first("mean").alias("mean"), F.expr(f"percentile(m, array({low}, {high}))").alias("q"))
    return interval.select(F.col("g").alias(group), "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def pareto(rows: DataFrame, cls: str, cost: str, score: str) -> DataFrame:
    """rows with frontier: no other row of the class is at most as costly and at least as good, and better in one of both.
    Equal rows stay together. A running maximum over distinct costs instead of comparing pairs."""
    best = rows.groupBy(cls, cost).agg(F.max(score).alias("_same"))
    before = F.max("_same").over(Window.partitionBy(cls).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_before", before)
    return rows.join(front, [cls, cost]).withColumn("frontier", (F.col(score) == F.col("_same")) & (F.col("_before").isNull() | (F.col(score) > F.col("_before")))).drop("_same", "_before")
