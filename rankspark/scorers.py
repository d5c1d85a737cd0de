"""The pluggable scorers: a registry of names, hooks for user functions and encoders, and listwise bookkeeping.

A scorer takes pairs (query, pos, doc, query_text, doc_text) and returns them with score; a null score of a query's pairs
means that the query cannot be scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import scan
from .functions import text as X
from .functions.portable import portable_hash
from .operators import lexical, lists
from .operators.structure import shared_structure
from .operators.vector import cosine

Encoder = Callable[[list[str]], np.ndarray]


class Scorer(Protocol):
    def __call__(self, pairs: DataFrame) -> DataFrame: ...


def _lexical(kind: Callable[[DataFrame, DataFrame], DataFrame], tokens: Callable = X.whitespace_tokens) -> Scorer:
    def score(pairs: DataFrame) -> DataFrame:
        queries = pairs.groupBy("query").agg(F.first("query_text").alias("t")).select("query", tokens(F.col("t")).alias("tokens"))
        # texts are dealt by query before they are split, so that no token is shuffled
        dealt = pairs.select("query", F.col("pos").alias("doc"), "doc_text").repartition("query")
        candidates = dealt.select("query", "doc", tokens(F.col("doc_text")).alias("tokens"))
        scores = kind(queries, candidates).select("query", F.col("doc").alias("pos"), "score")
        return pairs.join(scores, ["query", "pos"])

    return score


bm25 = _lexical(lists.bm25)
tf_idf = _lexical(lists.tfidf)
jaccard = _lexical(lexical.overlap)
bm25_math = _lexical(lists.bm25, X.math_word_tokens)
tf_idf_math = _lexical(lists.tfidf, X.math_word_tokens)
jaccard_math = _lexical(lexical.overlap, X.math_word_tokens)
#: Formulas are met by paths of their operator trees, words as they are.
math_structure = _lexical(shared_structure, scan.structure_terms_of)


def embedding(encode: Encoder, query_prompt: str = "", doc_prompt: str = "", cache: DataFrame | None = None, query_suffix: str = "", doc_suffix: str = "", encode_documents: Encoder | None = None) -> Scorer:
    """Cosine of encoded texts. Each distinct text is encoded once; texts found in cache (side, text, vector) are not encoded.
    encode runs in Arrow batches on the executors; encode_documents, if given, takes the documents' side."""

    def vectors(texts: DataFrame, side: str, prompt: str, suffix: str, encode: Encoder) -> DataFrame:
        wanted = texts.distinct()
        have = cache.where(F.col("side") == side).select("text", "vector") if cache is not None else None
        missing = wanted.join(have, "text", "left_anti") if have is not None else wanted

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = encode([prompt + t + suffix for t in frame["text"]])
                yield pd.DataFrame({"text": frame["text"], "vector": [np.asarray(v, float).tolist() for v in found]})

        fresh = missing.mapInPandas(run, "text string, vector array<double>")
        return fresh.unionByName(wanted.join(have, "text").select("text", F.col("vector").cast("array<double>").alias("vector"))) if have is not None else fresh

    def score(pairs: DataFrame) -> DataFrame:
        q = vectors(pairs.select(F.col("query_text").alias("text")), "query", query_prompt, query_suffix, encode).select(F.col("text").alias("query_text"), F.col("vector").alias("qv"))
        d = vectors(pairs.select(F.col("doc_text").alias("text")), "document", doc_prompt, doc_suffix, encode_documents or encode).select(F.col("text").alias("doc_text"), F.col("vector").alias("dv"))
        return pairs.join(q, "query_text").join(d, "doc_text").withColumn("score", cosine(F.col("qv"), F.col("dv"))).drop("qv", "dv")

    return score


def pointwise(score_texts: Callable[[list[str], list[str]], list[float]]) -> Scorer:
    """A user function of (queries, documents) texts, called on Arrow batches."""

    @F.pandas_udf("double")
    def call(queries: pd.Series, documents: pd.Series) -> pd.Series:
        return pd.Series(score_texts(queries.tolist(), documents.tolist()))

    return lambda pairs: pairs.withColumn("score", call("query_text", "doc_text"))


def whole_lists(get_scores: Callable[[str, list[str]], list[float] | None]) -> Scorer:
    """A user function of a query's text and its whole candidate list in order, called once a query; None gives null scores."""

    def score(pairs: DataFrame) -> DataFrame:
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("pos")
            found = get_scores(rows.column("query_text")[0].as_py(), rows.column("doc_text").to_pylist())
            if found is not None and len(found) != rows.num_rows:
                raise ValueError(f"get_scores gave {len(found)} scores for {rows.num_rows} documents")
            each = [None] * rows.num_rows if found is None else [None if s is None else float(s) for s in found]
            return rows.append_column("score", pa.array(each, pa.float64()))

        return pairs.groupBy("query").applyInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())]))

    return score


#: Fixed values, options of encoders: what stands before and after the texts of each side, and each side's own options.
ENCODER_OPTIONS = ("query_prompt", "document_prompt", "query_suffix", "document_suffix", "query_encode_kwargs", "document_encode_kwargs")


def adapt(model: object, options: dict | None = None) -> Scorer:
    """Anything with encode(texts) or get_scores(query, documents) is a scorer; other objects are refused. options go to the
    model with each call, but for ENCODER_OPTIONS, which a model without encode(), or whose lists are scored whole, refuses."""
    lists, encodes = (callable(getattr(model, name, None)) for name in ("get_scores", "encode"))
    rest = {name: value for name, value in (options or {}).items() if name not in ENCODER_OPTIONS}
    own = {name: value for name, value in (options or {}).items() if name in ENCODER_OPTIONS and value}
    if own and (lists or not encodes):
        raise ValueError(f"{', '.join(own)}: only a model that encodes takes these")
    if lists:
        return whole_lists(partial(model.get_scores, **rest))
    if encodes:
        query, document = (partial(model.encode, **rest | own.get(f"{side}_encode_kwargs", {})) for side in ("query", "document"))
        return embedding(query, own.get("query_prompt", ""), own.get("document_prompt", ""), None, own.get("query_suffix", ""), own.get("document_suffix", ""), document)
    if callable(model):
        return partial(model, **rest)
    raise ValueError("a scorer needs encode() or get_scores(), or must be callable")


def listwise_groups(pairs: DataFrame, size: int = 20, epochs: int = 2, seed: str = "42") -> DataFrame:
    """pairs with epoch, group and place: in each epoch a query's candidates are shuffled by hash and dealt into groups."""
    each = pairs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    nth = F.row_number().over(Window.partitionBy("query", "epoch").orderBy(portable_hash(seed, F.col("query"), F.col("epoch"), F.col("pos")), "pos")) - 1
    return each.withColumn("_n", nth).withColumn("group", F.floor(F.col("_n") / size).cast("int")).withColumn("place", F.col("_n") % size + 1).drop("_n")


def listwise_scores(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """listwise_groups() and answers (query, epoch, group, answer text) to (query, pos, score): scores over ten, averaged over the
    epochs. A group whose answer is missing or can't be parsed counts as 0 for each of its documents in that epoch; a document that
    a parsed answer leaves out has no score in that epoch; 0 where it has none at all."""
    keys = ["query", "epoch", "group"]
    parsed = answers.select(*keys, scan.answer_scores_of(F.col("answer")).alias("found"))
    # a group meets its entries as one row; places given twice count twice, and places beyond the group meet no document
    given = parsed.groupBy(*keys).agg(F.when(F.count("found") > 0, F.flatten(F.collect_list("found"))).alias("found"))
    met = groups.select(*keys, "place", "pos").join(given, keys, "left")
    own = F.transform(F.filter("found", lambda f: f["place"] == F.col("place")), lambda f: f["score"] / 10)
    scores = F.when(F.col("found").isNull(), F.array(F.lit(0.0))).otherwise(own)
    sums = met.select("query", "pos", scores.alias("s")).groupBy("query", "pos").agg(F.sum(F.aggregate("s", F.lit(0.0), lambda a, x: a + x)).alias("s"), F.sum(F.size("s")).alias("n"))
    return sums.select("query", "pos", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("score"))


def averaged_samples(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (query, pos, answer) with several samples a pair, each with a score tag: their mean over 100."""
    means = answers.groupBy("query", "pos").agg(F.avg(X.tagged_score(F.col("answer")) / 100).alias("score"))
    return pairs.join(means, ["query", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


REGISTRY: dict[str, Scorer] = {"bm25": bm25, "tf-idf": tf_idf, "jaccard": jaccard, "bm25-math": bm25_math, "tf-idf-math": tf_idf_math, "jaccard-math": jaccard_math, "math-structure": math_structure}


def make_scorer(model: str | object, init_options: dict | None = None, options: dict | None = None) -> Scorer:
    """A registered name, a class that is built with init_options, or any object that adapt() takes, which gets options with
    each call. Options that nothing would take raise: a name and a built object have no init_options, a name has none at all."""
    if isinstance(model, str):
        if model not in REGISTRY:
            raise ValueError(f"unknown scorer {model!r}; known: {', '.join(REGISTRY)}")
        if init_options or options:
            raise ValueError(f"scorer {model!r} takes no options")
        return REGISTRY[model]
    if isinstance(model, type):
        return adapt(model(**(init_options or {})), options)
    if init_options:
        raise ValueError("only a class is built with init_options")
    return adapt(model, options)
