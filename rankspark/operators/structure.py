"""Structural search for formulas: an inverted index of paths from leaves towards roots, scored by the paths that two texts share.

Texts whose formulas have the same structure (names and numbers aside) are one class. The index holds a posting for each path
of each class and the classes of all texts, so that copies and renamings are met once and no pair of copies is ever made;
it is written once, in blocks of classes, and read by any number of searches. A pair of blocks is scored in a task's arrays, so
paths that nearly all classes have make no rows.

The score of two texts is the Dice overlap of their weighted terms, repeats counted: 1 for equal structures. Texts without a
formula are in no class and match nothing in a search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scan

#: Classes in a block of the index or of queries: a pair of blocks has so many squared scores at a time (8 MB).
BLOCK = 1024
#: What terms weigh when lists of candidates are scored: structure, names, words.
WEIGHTS = {"s": 1.0, "n": 0.25, "w": 0.5}


def _weight(term: Column) -> Column:
    kind = F.substring(term, 1, 1)
    return F.when(kind == "s", WEIGHTS["s"]).when(kind == "n", WEIGHTS["n"]).otherwise(WEIGHTS["w"])


def shared_structure(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, doc, score) of queries (query, tokens) and candidates (query, doc, tokens), tokens being structure terms: twice the
    weight of shared terms over the weight of all. 0 where nothing is shared."""
    wanted = queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count("*").alias("wanted"))
    whole = wanted.groupBy("query").agg(F.sum(F.col("wanted") * _weight(F.col("term"))).alias("size_q"))
    have = candidates.select("query", "doc", F.explode_outer("tokens").alias("term")).groupBy("query", "doc", "term").agg(F.count("*").alias("have"))
    weight = F.coalesce(_weight(F.col("term")), F.lit(0.0))
    met = have.join(wanted, ["query", "term"], "left").groupBy("query", "doc").agg(
        F.coalesce(F.sum(F.when(F.col("wanted").isNotNull(), F.least("have", "wanted") * weight)), F.lit(0.0)).alias("shared"),
        F.sum(F.when(F.col("term").isNotNull(), F.col("have") * weight).otherwise(0.0)).alias("size_d"),
    )
    both = F.coalesce("size_q", F.lit(0.0)) + F.col("size_d")
    score = F.when(both > 0, 2 * F.col("shared") / both).otherwise(0.0)
    return met.join(whole, "query", "left").select("query", "doc", score.alias("score"))


def _classed(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, terms (counted) and signature of the texts that have a formula."""
    found = texts.select(F.col(id_col).alias("id"), scan.structure_counts_of(F.col(text_col)).alias("terms"))
    return found.where(F.size("terms") > 0).withColumn("signature", F.sha2(F.to_json("terms"), 256))


def _blocks(classes: DataFrame, key: str, rows: int) -> DataFrame:
    """Classes (key, terms) dealt into blocks of about BLOCK classes: key, lengths, terms and tf as arrays."""
    count = max(1, -(-rows // BLOCK))
    # as many parts as blocks: a block is few bytes and much work
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(count))).repartition(count, "block")
    held = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(key, "terms"))).alias("z"))
    flat = F.flatten("z.terms")
    return held.select("block", F.col(f"z.{key}").alias(key), F.transform("z.terms", F.size).alias("lengths"), flat["term"].alias("terms"), flat["tf"].alias("tf"))


def write_index(texts: DataFrame, folder: str, id_col: str = "id", text_col: str = "text") -> None:
    """Writes folder/members (id, terms, signature) and folder/blocks: the classes' postings, block by block. A class is known by its
    smallest id."""
    spark = texts.sparkSession
    classed = _classed(texts, id_col, text_col)
    classed.write.mode("overwrite").parquet(f"{folder}/members")
    written = spark.read.parquet(f"{folder}/members")
    classes = written.groupBy("signature").agg(F.min("id").alias("class"), F.first("terms").alias("terms"))
    rows = written.select("signature").distinct().count()
    _blocks(classes.select("class", "terms"), "class", rows).write.mode("overwrite").parquet(f"{folder}/blocks")


def _best_of_block(query: list[np.ndarray], block: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, class place, score) of each query's k best classes of a block. A side is the owner, term and tf of its postings,
    owners in order; classes are in order of their ids."""
    sizes = [np.bincount(owner, tf, n).astype(np.int64) for owner, _, tf, n in (query, block)]
    shared = np.zeros((query[3], block[3]), np.int64)
    sides = []
    for owner, term, tf, _ in (query, block):
        order = np.argsort(term, kind="stable")
        terms, starts = np.unique(term[order], return_index=True)
        sides.append({t: (owner[o], tf[o]) for t, o in zip(terms.tolist(), np.split(order, starts[1:]), strict=True)} if len(order) else {})
    for t in sides[0].keys() & sides[1].keys():
        (i, n), (j, m) = sides[0][t], sides[1][t]
        if 4 * len(i) * len(j) > shared.size:
            wide = [np.zeros(size, np.int64) for size in shared.shape]
            wide[0][i], wide[1][j] = n, m
            shared += np.minimum.outer(*wide)
        else:
            shared[np.ix_(i, j)] += np.minimum.outer(n, m)
    score = 2 * shared / np.maximum(sizes[0][:, None] + sizes[1][None, :], 1)
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    i, j = np.repeat(np.arange(len(best)), best.shape[1]), best.ravel()
    met = shared[i, j] > 0
    return i[met], j[met], score[i[met], j[met]]


def search(queries: DataFrame, folder: str, k: int = 10, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Per query: query, class, score and rank of its k best classes, ties to the smaller class. Queries of one structure are
    searched once. Each block of the index meets each block of queries in one step of a task, which gives on the k best of the block."""
    spark: SparkSession = queries.sparkSession
    asked = _classed(queries, id_col, text_col)
    each = asked.groupBy("signature").agg(F.first("terms").alias("terms"))
    index = spark.read.parquet(f"{folder}/blocks").drop("block")
    kind = index.schema["class"].dataType.elementType.simpleString()
    count = index.count()
    wanted = _blocks(each, "signature", asked.select("signature").distinct().count()).select("signature", *[F.col(c).alias(f"q_{c}") for c in ("lengths", "terms", "tf")])
    pairs = index.repartition(max(1, count)).join(F.broadcast(wanted))  # some MB for each thousand queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = dict(zip(batch.schema.names, (c[n].values for c in batch.columns), strict=True))
                coded = pa.concat_arrays([row["q_terms"], row["terms"]]).dictionary_encode().indices.to_numpy()
                lengths = [row[c].to_numpy() for c in ("q_lengths", "lengths")]
                owners = [np.repeat(np.arange(len(x)), x) for x in lengths]
                codes = coded[: len(owners[0])], coded[len(owners[0]) :]
                sides = [[o, c, row[tf].to_numpy(), len(x)] for o, c, tf, x in zip(owners, codes, ("q_tf", "tf"), lengths, strict=True)]
                i, j, score = _best_of_block(*sides, k)
                yield pa.RecordBatch.from_arrays([row["signature"].take(pa.array(i)), row["class"].take(pa.array(j)), pa.array(score)], names=["signature", "class", "score"])

    scored = pairs.mapInArrow(run, f"signature string, class {kind}, score double")
    place = F.row_number().over(Window.partitionBy("signature").orderBy(F.desc("score"), "class"))
    best = scored.withColumn("rank", place).where(F.col("rank") <= k)
    return asked.select(F.col("id").alias("query"), "signature").join(best, "signature").select("query", "class", "score", "rank")


def members(spark: SparkSession, folder: str) -> DataFrame:
    """(id, class) of all indexed texts."""
    written = spark.read.parquet(f"{folder}/members").select("id", "signature")
    return written.join(written.groupBy("signature").agg(F.min("id").alias("class")), "signature").select("id", "class")
