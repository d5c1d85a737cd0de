"""Quality by importance resampling: the ratio of hashed n-gram generative models for target and raw text, sampled by Gumbel
top-k.

Texts are bags of hashed words and word pairs (words as in decontamination). The target model counts them over all documents
labelled 1, the raw model over all documents; both are smoothed towards uniform. A document's log weight is the sum of its
n-grams' log ratios; resample()'s `tempered` takes their mean times so many n-grams instead, so that texts do not outweigh
others merely by length. Adding a Gumbel number, drawn by a hash of id and text, and keeping the k largest keys samples k
documents without replacement in proportion to the weights.

The k-th key is found by nested histograms of the keys' ranks (see budgets.py), without a sort; the model tables have
2 ** BITS rows. Defined results: null and empty texts weigh as the raw text does (log weight 0); without labelled rows all weigh alike; ids
labelled more than once count once, as 1 if any is; rows that repeat an id and a text tie and go together, so that as many
rows more or less than k can be kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .budgets import SPAN, spread, thresholds
from .common import ALNUM, LOWER, mix, slices, small_batches, staged, text_buffer, windows, word_hashes, word_spans

BITS, SHARE, SMOOTH = 14, 0.8, 1.0
#: Keys are placed by asinh, which spreads all that sums of log ratios can be over the histograms' span.
REACH = 64.0


def ngram_buckets(values: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the number of the text of each."""
    raw = LOWER[values]
    starts, ends, firsts = word_spans(raw, offsets, ALNUM)
    words = word_hashes(raw, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    pairs = windows(words, 2)
    whole = owner[1:] == owner[:-1]
    ids = np.concatenate((mix(words), pairs[whole])) >> np.uint64(64 - bits)
    return ids.astype(np.int64), np.concatenate((owner, owner[1:][whole]))


def counts(documents: DataFrame, labels: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Target and raw n-gram counts of each bucket, over all documents."""
    small_batches(documents.sparkSession)
    good = labels.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y")).where("y = 1 and i is not null").select("i")
    slim = documents.select(F.col(id_col).alias("d"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(ngram_buckets(*text_buffer(part.column("text")), bits)[0], minlength=1 << bits)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["b", "n"])

    out = []
    # a sort-merge join at every size: the labels grow with the documents, so no side is broadcast
    for rows in (slim.join(good.hint("merge"), F.col("d") == F.col("i"), "left_semi"), slim):
        table = np.zeros(1 << bits)
        for r in rows.select("text").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
            table[r["b"]] = r["n"]
        out.append(table)
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of each bucket the log of target over raw probability; zeros without a target."""
    if not target.sum():
        return np.zeros(len(target))
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * len(target))) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * len(raw)))


_WEIGHED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_ngrams", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("text_crc32", T.LongType())])


def weighed(documents: DataFrame, ratio: np.ndarray, tempered: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_ngrams, log_weight and text_crc32."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(ratio)
    bits = int(len(ratio)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, owner = ngram_buckets(*text_buffer(part.column("text")), bits)
                n = np.bincount(owner, minlength=part.num_rows)
                total = np.bincount(owner, weights=held.value[ids], minlength=part.num_rows)
                weight = np.round(total if tempered is None else tempered * total / np.maximum(n, 1), 6)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(weight), part.column("crc")], names=_WEIGHED.names)

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.crc32(text).alias("crc")).mapInArrow(run, _WEIGHED)


def resample(documents: DataFrame, labels: DataFrame, share: float = SHARE, tempered: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per document: doc_id, n_ngrams, log_weight, gumbel_key and selected, for about `share` of all rows."""
    ratio = log_ratio(*counts(documents, labels, BITS, id_col, text_col, label_col))
    rows = weighed(documents, ratio, tempered, id_col, text_col)
    even = (spread(F.col("doc_id"), F.col("text_crc32"), F.lit("gumbel")) + 0.5) / float(SPAN)
    keyed = rows.withColumn("gumbel_key", F.round(F.col("log_weight") - F.log(-F.log(even)), 9))
    # places descend, so the k largest keys are the places under a threshold
    place = F.floor((F.lit(REACH) - F.asinh("gumbel_key")) / (2 * REACH) * float(SPAN)).cast("long")
    keyed = staged(keyed.withColumn("h", F.greatest(F.lit(0), F.least(F.lit(SPAN - 1), place))), "keys")
    k = int(share * keyed.count())
    limit = thresholds(keyed.select(F.lit(0).alias("g"), F.lit(1).cast("long").alias("w"), "h"), {0: float(k)})[0]
    return keyed.select("doc_id", "n_ngrams", "log_weight", "gumbel_key", (F.col("h") < limit).alias("selected"))
