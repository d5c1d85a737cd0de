"""Lexical scorers over whole candidate lists: BM25, TF-IDF cosine and set overlap of a query with each document of its list.

Texts are split once, in the JVM; a list's tokens go to a task as one Arrow table, are numbered there by a dictionary, and counted in
arrays. A list is one task's work, as it is in the reranking it serves; lists too long for a task go through lexical.py, whose plans
shuffle counts by token and give the same scores.

Defined results: a document that shares no token scores 0, as do documents of a list without a query (overlap leaves these out);
documents without tokens count as documents of the list; a query without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TokenList:
    """The tokens of a query and its documents, numbered: tf of each distinct (document, token), and the query's counts."""

    def __init__(self, query: pa.Table, documents: pa.Table):
        asked, held = (pc.list_flatten(t.column("tokens").combine_chunks()) for t in (query, documents))
        coded = pa.chunked_array([held, asked]).combine_chunks().dictionary_encode()
        self.lengths = pc.fill_null(pc.list_value_length(documents.column("tokens")), 0).to_numpy().astype(np.int64)
        codes, self.width = np.asarray(coded.indices), max(len(coded.dictionary), 1)
        self.n = len(self.lengths)
        owner = np.repeat(np.arange(self.n), self.lengths)
        cells, self.tf = np.unique(owner * self.width + codes[: len(held)], return_counts=True)
        self.doc, self.token = cells // self.width, cells % self.width
        self.df = np.bincount(self.token, minlength=self.width)
        self.times = np.bincount(codes[len(held) :], minlength=self.width)

    def summed(self, parts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, weights=parts, minlength=self.n)


def _bm25(x: TokenList, k1: float, b: float, epsilon: float) -> np.ndarray:
    idf = np.log(x.n - x.df + 0.5) - np.log(x.df + 0.5)
    known = x.df > 0
    idf = np.where(idf < 0, epsilon * idf[known].mean() if known.any() else 0.0, idf)
    met = x.times[x.token] > 0
    doc, token, tf = x.doc[met], x.token[met], x.tf[met]
    norm = k1 * (1 - b + b * x.lengths[doc] / max(x.lengths.mean(), 1e-300))
    return x.summed(x.times[token] * idf[token] * tf * (k1 + 1) / (tf + norm), doc)


def _tfidf(x: TokenList) -> np.ndarray:
    idf = np.where(x.df > 0, np.log((x.n + 1.0) / (x.df + 1.0)) + 1, 0.0)
    weight, asked = x.tf * idf[x.token], x.times * idf
    sizes = np.sqrt(x.summed(weight * weight, x.doc)) * np.sqrt((asked * asked).sum())
    return np.divide(x.summed(weight * asked[x.token], x.doc), sizes, out=np.zeros(x.n), where=sizes > 0)


def _overlap(x: TokenList, empty: float) -> np.ndarray:
    common = x.summed((x.times[x.token] > 0).astype(float), x.doc)
    union = np.bincount(x.doc, minlength=x.n) + (x.times > 0).sum() - common
    return np.divide(common, union, out=np.full(x.n, empty), where=union > 0)


def _scored(queries: DataFrame, candidates: DataFrame, score: Callable[[TokenList], np.ndarray], lone: bool = True) -> DataFrame:
    kinds = candidates.select("query", "doc").schema

    def run(query: pa.Table, documents: pa.Table) -> pa.Table:
        found = documents.select(["query", "doc"])
        if not documents.num_rows or not (lone or query.num_rows):
            return found.slice(0, 0).append_column("score", pa.array([], pa.float64()))
        return found.append_column("score", pa.array(score(TokenList(query, documents)), pa.float64()))

    out = T.StructType([*kinds.fields, T.StructField("score", T.DoubleType())])
    # both sides may come from the same rows, so one has names of its own
    wanted = queries.select(F.col("query").alias("_query"), F.col("tokens").alias("tokens")).groupBy("_query")
    return wanted.cogroup(candidates.select("query", "doc", "tokens").groupBy("query")).applyInArrow(run, out)


def bm25(queries: DataFrame, candidates: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query, doc, score) by Okapi BM25 of queries (query, tokens) and candidates (query, doc, tokens); a negative idf becomes epsilon
    times the mean idf of the list's vocabulary, and a token counts as often as the query has it."""
    return _scored(queries, candidates, lambda x: _bm25(x, k1, b, epsilon))


def tfidf(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, doc, score) by cosine of tf-idf vectors with smooth idf, fitted on the list; query tokens outside it are left out."""
    return _scored(queries, candidates, _tfidf)


def overlap(queries: DataFrame, candidates: DataFrame, empty: float = 0.0) -> DataFrame:
    """(query, doc, score) by set overlap; `empty` where neither side has a token."""
    return _scored(queries, candidates, lambda x: _overlap(x, empty), lone=False)
