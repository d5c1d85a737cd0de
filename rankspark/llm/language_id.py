"""Language identification: averaged hashed subword embeddings with a linear softmax, with calibrated rejection.

Training rows are a bounded sample: about `PER_LANGUAGE` rows of each language, `MOST_ROWS` of all (then fewer a language, at
least one), drawn by a hash of the id; of a training text above `MOST_BYTES` a stretch of about that length at a hashed place
is learned. No language is left out; each takes 0.4 MB of the model. Whole texts are cut into pieces of `PIECE` bytes, so short
texts are learned too. A fifth of the sampled rows is held and sets the temperature and the rejection bound.

A text is rejected for its novelty, the share of its n-grams of `NOVEL` bytes that the learned rows lack; unlike a posterior
it says the same for any number of languages. The bound lies `STRICT` of the way from what the share `MOST` of the held pieces
keeps under to the median of the same pieces with their letters shuffled, so a few foreign pieces among the held ones do not
move it. `WEIGHT` n-grams of usual novelty are added to every text: some ten letters alone cannot reject one.

Every text is scored over its whole length. Defined results: a null text or one without a letter is `und` with score 0 and
not accepted; with no training row every text is `und`; ties go to the first language by code point; repeated rows get equal
results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, slices, small_batches, text_buffer
from .subwords import Subwords, buckets, normalised, softmax, temperature, train

PER_LANGUAGE, MOST_ROWS, MOST_BYTES, PIECE = 300, 6000, 20_000, 400
NOVEL, WEIGHT, MOST, STRICT = 4, 20, 0.95, 1 / 3
ORDERS, BITS = (2, 3, 4), 15
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def sample(documents: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[int, str, str]]:
    """About per_language rows of each language, the same at every run; a language with fewer gives all. Equal rows are one."""
    rows = documents.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = rows.groupBy("l").agg(F.count("*").alias("n"), F.min(_draw()).alias("least")).collect()
    if not counts:
        return []
    per_language = max(1, min(per_language, MOST_ROWS // len(counts)))
    # the row of the least draw is always in, so a language of few or unluckily drawn rows is learned too
    rate = F.element_at(F.create_map(*[x for r in counts for x in (F.lit(r["l"]), F.lit(max(min(1.0, per_language / r["n"]), math.nextafter(r["least"], 2.0))))]), F.col("l"))
    far = F.length("t") - MOST_BYTES // 4
    part = F.when(far > 0, F.substr("t", 1 + F.pmod(F.xxhash64("i", "t"), far).cast("int"), F.lit(MOST_BYTES // 4))).otherwise(F.col("t"))
    picked = rows.where(_draw() < rate).select("i", "l", part.alias("t"), _draw().alias("draw")).orderBy("draw", "i", "l", "t").limit(2 * max(MOST_ROWS, len(counts)))
    return sorted({(r["i"] if r["i"] is not None else -1, r["l"], r["t"]) for r in picked.collect()})


def _draw() -> Column:
    return F.pmod(F.xxhash64("i", "t", F.lit("language")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pieces(texts: list[str], most: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, offsets of pieces of about `most` bytes, and each piece's text."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in encoded]))).astype(np.int64)
    raw, begins = normalised(np.frombuffer(b"".join(encoded), np.uint8), offsets)
    cuts, owner = [np.zeros(1, np.int64)], []
    for t in range(len(texts)):
        size = begins[t + 1] - begins[t]
        n = max(1, int(size // most))
        cuts.append(begins[t] + (np.arange(1, n + 1) * size) // n)
        owner.append(np.full(n, t))
    return raw, np.concatenate(cuts), np.concatenate(owner) if owner else np.zeros(0, np.int64)


@dataclass
class Known:
    """The n-grams of the learned pieces, as bits by hash; usual novelty and the bound above which a text is rejected."""

    table: np.ndarray
    bits: int
    usual: float = 0.0
    bound: float = 1.0

    def novelty(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The share of unknown n-grams of each span of the normalised bytes; offsets must ascend."""
        ids = buckets(raw, NOVEL, self.bits)
        sums = np.concatenate(([0], np.cumsum((self.table[ids >> 3] >> (ids & 7).astype(np.uint8)) & 1 == 0)))
        lo = np.minimum(offsets[:-1], len(ids))
        hi = np.maximum(np.minimum(offsets[1:] - NOVEL + 1, len(ids)), lo)
        return (sums[hi] - sums[lo] + WEIGHT * self.usual) / (hi - lo + WEIGHT)


def known(raw: np.ndarray, offsets: np.ndarray, held: np.ndarray) -> Known:
    """The n-grams of the pieces that are not held, or of all if all are, and the bound that the held ones give."""
    bits = min(27, max(18, (4 * len(raw)).bit_length()))
    piece = np.repeat(np.arange(len(held)), np.diff(offsets))
    ids = buckets(raw, NOVEL, bits)
    inside = piece[: len(ids)] == piece[NOVEL - 1 :]
    seen = np.zeros(1 << bits, bool)
    seen[ids[inside & ~(held & ~held.all())[piece[: len(ids)]]]] = True
    found = Known(np.packbits(seen, bitorder="little"), bits)
    found.usual = float(np.median(found.novelty(raw, offsets)[held]))
    letters, rng = raw.copy(), np.random.default_rng(7)
    for a, b in zip(offsets[:-1][held], offsets[1:][held], strict=True):
        at = a + np.flatnonzero(raw[a:b] != 0x20)
        letters[at] = rng.permutation(raw[at])
    own, mixed = found.novelty(raw, offsets)[held], found.novelty(letters, offsets)[held]
    most = float(np.quantile(own, MOST))
    found.bound = most + STRICT * max(0.0, float(np.median(mixed)) - most)
    return found


def fit(rows: list[tuple[int, str, str]]) -> tuple[Subwords, float, Known] | None:
    """The model, its temperature and what it knows; None without rows."""
    if not rows:
        return None
    classes = sorted({lang for _, lang, _ in rows})
    raw, offsets, owner = pieces([t for _, _, t in rows])
    labels = np.array([classes.index(lang) for _, lang, _ in rows])[owner]
    held = owner % 5 == 4
    if not held.any():
        held = ~held
    model = train(raw, offsets, labels, classes, ORDERS, BITS, weights=(owner % 5 != 4) if (owner % 5 != 4).any() else None)
    logits = model.logits(raw, offsets)[held]
    heat = temperature(logits, labels[held])
    return model, heat, known(raw, offsets, held)


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def judge(texts: pa.Array, model: Subwords | None, heat: float, known: Known | None) -> tuple[list, np.ndarray, np.ndarray]:
    """Predicted language, calibrated posterior and acceptance of each text."""
    n = len(texts)
    best, score, good = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
    if model is None or known is None:
        return best, score, good
    raw, begins = normalised(*text_buffer(texts))
    chance = softmax(model.logits(raw, begins) / heat)
    top = chance.argmax(1)
    usual = known.novelty(raw, begins) <= known.bound
    for i, t in enumerate(texts.to_pylist()):
        if t and _LETTER.search(t):
            best[i], score[i], good[i] = model.classes[top[i]], chance[i, top[i]], usual[i]
    return best, np.minimum(score, 1.0), good


def predict(documents: DataFrame, fitted: tuple[Subwords, float, Known] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score and accepted."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(fitted or (None, 1.0, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                best, score, good = judge(part.column("text"), *held.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(best, pa.string()), pa.array(score), pa.array(good)], names=["doc_id", "lang_pred", "score", "accepted"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _FOUND)


def keep_accepted(documents: DataFrame, fitted: tuple[Subwords, float, Known] | None, text_col: str = "text") -> DataFrame:
    """The documents whose language is accepted, in their own columns."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(fitted or (None, 1.0, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(judge(part.column(text_col), *held.value)[2]))

    return documents.mapInArrow(run, documents.schema)


def learnt(documents: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[Subwords, float, Known] | None:
    """fit() on a sample of the rows that `learn` admits; without it, those whose id's remainder by 4 is not 2."""
    learn = remainder(F.col(id_col), 4) != 2 if learn is None else learn
    return fit(sample(documents, F.coalesce(learn, F.lit(False)), id_col, text_col, lang_col, per_language))
