"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Character n-grams within words are hashed, so an unseen misspelling shares vectors with the words it comes from. A text is
judged by two margins of the model: that of all its n-grams, and the largest of its pieces of about `PIECE` bytes, which
cover all of it, so a short outburst in a long text is not averaged away. Bags of fewer than `FLOOR` n-grams are filled up
with the mean of clean texts. A logistic line maps both margins to a posterior; it is fitted on a quarter of the sampled texts that
the model did not see, at a prior between the labels' own and an even one.

Labels are learned from a bounded sample of rows: about `PER_CLASS` of each label value, drawn by a hash of the id; at most 4 *
`PER_CLASS` labelled ids and 8 * `PER_CLASS` of their rows are taken, in the order of the draws. Sampled texts are learned
whole: they are written to the shared folder, tasks count their n-grams, and only the bags (distinct buckets and counts) reach
the driver, which holds no text. A count c is learned as 1 + log2(c), so that what a long text repeats does not drown the
rest of it; scores take plain counts. The margins that the line is fitted on are computed by tasks too.

Defined results: null and empty texts get the posterior of a bag of such fillings; without rows of both values every score is
0; a document labelled twice with both values is left out of training; rows that repeat an id and a text are learned once;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, slices, small_batches, staged, text_buffer
from .subwords import Subwords, bags, descend, normalised

PER_CLASS, PIECE = 2000, 320
ORDERS, BITS, FLOOR, LEAST = (4, 6, 8), 18, 200, 6


@dataclass
class Judge:
    """A folded model and the line that maps its margins to a posterior."""

    model: Subwords | None
    slopes: tuple[float, float] = (0.5, 0.5)
    shift: float = 0.0

    def margins(self, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Of each text, the margin of the whole and the largest of its pieces."""
        cuts, first = piece_offsets(begins, PIECE)
        logits = self.model.logits(raw, cuts)
        whole = self.model.logits(raw, begins)
        best = np.maximum.reduceat(logits[:, 1] - logits[:, 0], first) if len(first) else np.zeros(0)
        return np.stack([whole[:, 1] - whole[:, 0], best], 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.model is None or not len(texts):
            return np.zeros(len(texts))
        raw, begins = normalised(*text_buffer(texts))
        return 1 / (1 + np.exp(-np.clip(self.margins(raw, begins) @ np.array(self.slopes) + self.shift, -40, 40)))


def piece_offsets(begins: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of equal pieces of about `most` bytes, at least one a text, and the number of each text's first piece."""
    sizes = np.diff(begins)
    n = np.maximum(1, sizes // most)
    first = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(len(sizes)), n)
    within = np.arange(first[-1]) - first[owner]
    starts = begins[owner] + within * sizes[owner] // np.maximum(n[owner], 1)
    return np.concatenate((starts, begins[-1:])), first[:-1]


def sample(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, np.ndarray, float] | None:
    """About per_class rows of each label value, the same at every run: a written table (n, t) of whole texts, the labels by n,
    and the share of 1 among all labelled ids. None without rows of both values."""
    spark = documents.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & learn).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z and i is not null")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("i", F.lit("toxic")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = F.when(F.col("y") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    # about 2 * per_class ids: a bounded side; the limits, in the order of the draws, are seldom reached but by repeated rows
    picked = F.broadcast(known.where(draw < rate).withColumn("draw", draw).orderBy("draw", "i").limit(4 * per_class))
    rows = documents.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).join(picked, F.col("d") == F.col("i"))
    keyed = rows.withColumn("key", F.md5(F.concat(F.col("i").cast("string"), F.lit(":"), F.col("t")).cast("binary")))
    texts = staged(keyed.select("i", "y", "draw", "key", "t").dropDuplicates(["key"]), "toxic_texts")
    slim = texts.select("i", "y", "draw", "key").orderBy("draw", "i", "key").limit(8 * per_class).collect()
    slim = sorted(slim, key=lambda r: (r["i"], r["key"]))
    if len({r["y"] for r in slim}) < 2:
        return None
    numbers = spark.createDataFrame([(r["key"], n) for n, r in enumerate(slim)], "key string, n long")
    return texts.select("key", "t").join(F.broadcast(numbers), "key").select("n", "t"), np.array([r["y"] for r in slim]), counts[1] / (counts[0] + counts[1])


def _numbers(spark: SparkSession, wanted: np.ndarray) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(int(n),) for n in np.flatnonzero(wanted)], "n long"))


def collected_bags(texts: DataFrame, wanted: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The bags of the wanted rows of texts (n, t), counted by tasks."""
    spark = texts.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                raw, begins = normalised(*text_buffer(part.column("t")))
                bag = bags(raw, begins, ORDERS, BITS, within=True)
                found = [bag(t) for t in range(part.num_rows)]
                ids = pa.array([np.asarray(b, "<i4").tobytes() for b, _ in found], pa.binary())
                times = pa.array([np.asarray(c, "<i4").tobytes() for _, c in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("n"), ids, times], names=["n", "ids", "times"])

    rows = texts.join(_numbers(spark, wanted), "n").mapInArrow(run, "n long, ids binary, times binary")
    return {r["n"]: (np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["times"], "<i4")) for r in rows.toLocalIterator()}


def collected_margins(texts: DataFrame, judge: Judge, wanted: np.ndarray) -> np.ndarray:
    """Judge.margins() of the wanted rows of texts (n, t), in the order of n, computed by tasks."""
    spark = texts.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                both = held.value.margins(*normalised(*text_buffer(part.column("t"))))
                yield pa.RecordBatch.from_arrays([part.column("n"), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["n", "whole", "best"])

    rows = texts.join(_numbers(spark, wanted), "n").mapInArrow(run, "n long, whole double, best double").collect()
    held.destroy()
    return np.array([(r["whole"], r["best"]) for r in sorted(rows, key=lambda r: r["n"])])


def fit(texts: DataFrame, labels: np.ndarray, share: float | None = None) -> Judge:
    """Joint training on three quarters of the rows of texts (n, t), the line on the rest. labels: 0 or 1, of both some, by n;
    share: how many of all labelled rows are toxic."""
    held = np.arange(len(labels)) % 4 == 3
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held = np.zeros(len(labels), bool)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)) * ~held
    least = max(1, min(LEAST, int((labels[~held] == 1).sum()) // 12))
    counted = collected_bags(texts, ~held)
    rows = np.array([n for n in np.flatnonzero(~held) if len(counted[n][0])], np.int64)
    damped = {n: (ids, 1 + np.log2(times)) for n, (ids, times) in counted.items()}
    judge = Judge(descend(damped.__getitem__, rows, labels, balance, [0, 1], ORDERS, BITS, epochs=5, rate=0.1, gain=30.0, floor=FLOOR, least=least, decay=0.002, within=True))
    flat, total, count = judge.model.table.reshape(-1, 2), np.zeros(2), 0
    for n in np.flatnonzero((labels == 0) & ~held):
        ids, times = counted[n]
        total += times @ flat[ids].astype(np.float64)
        count += int(times.sum())
    judge.model.fill = total / max(1.0, count)
    used = held if held.any() else ~held
    share = labels.mean() if share is None else share
    odds = np.sqrt(max(1e-6, share) / max(1e-6, 1 - share))  # between the labels' odds and even ones
    own = labels[used]
    weights = np.where(own == 1, odds / max(own.sum(), 1), 1 / max((1 - own).sum(), 1))
    judge.slopes, judge.shift = line(collected_margins(texts, judge, used), own, weights * len(own) / weights.sum())
    return judge


def line(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slopes, none negative, and shift of a weighted logistic regression, by Newton steps with a small ridge."""
    best = None
    for columns in ([0, 1], [0], [1]):
        mid, wide = margins[:, columns].mean(0), np.maximum(margins[:, columns].std(0), 1e-6)
        x = np.concatenate([(margins[:, columns] - mid) / wide, np.ones((len(margins), 1))], 1)
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (weights * p * (1 - p))[:, None]) + 0.01 * np.eye(len(w)), x.T @ (weights * (labels - p)) - 0.01 * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] < 0).any():
            continue
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(weights * np.where(labels == 1, np.log(p), np.log(1 - p))).mean()
        if best is None or loss < best[0] - 1e-3:
            slopes = np.zeros(2)
            slopes[columns] = w[:-1] / wide
            best = loss, tuple(slopes.tolist()), float(w[-1] - slopes[columns] @ mid)
    return best[1:] if best else ((1.0, 0.0), 0.0)


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score(documents: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and the toxicity posterior of its whole text."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(held.value.scores(part.column("text")))], names=["doc_id", "score"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _FOUND)


def learnt(documents: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Judge:
    """fit() on a sample of the labelled rows that `learn` (over the labels) admits; without it, those whose id's remainder by 5 is not 0."""
    learn = remainder(F.col(id_col), 5) != 0 if learn is None else learn
    sampled = sample(documents, labels, F.coalesce(learn, F.lit(False)), per_class, id_col, text_col, label_col)
    return fit(*sampled) if sampled else Judge(None)
