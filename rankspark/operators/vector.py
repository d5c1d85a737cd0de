"""Dense and sparse vector scoring: cosine of a query set against all rows, dot products, late interaction, pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries in one broadcast matrix; more are taken in further passes.
QUERY_BLOCK = 4096
#: Scores of queries and rows that a task holds at once (16 MB a matrix).
SCORE_CELLS = 1 << 21


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero vector raises."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.raise_error(F.lit("cosine of a zero vector")).cast("double")).otherwise(dot(a, b) / size)


def normalise(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def query_blocks(queries: DataFrame, id_col: str, vector_col: str, extra: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The query set as ids, matrices of at most QUERY_BLOCK rows, and the extra column's values (0 without)."""
    held: list[tuple] = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, rows, more = zip(*held, strict=True)
        return np.array(ids, np.int64), np.array(rows, np.float64), np.array(more)

    for r in queries.select(id_col, vector_col, F.col(extra) if extra else F.lit(0)).orderBy(id_col).toLocalIterator():
        held.append(tuple(r))
        if len(held) == QUERY_BLOCK:
            yield block()
            held = []
    if held:
        yield block()


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Whether each score is among the k largest of its row, ties with the last included."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    return scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]


def search(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", extra: str | None = None, extra_score=None) -> DataFrame:
    """For each query the k nearest rows by cosine within each partition, as (query, id, score[, extra]): a superset of the
    k nearest of all, ties by id. The query's own row is left out. `extra` is a column of both sides, and extra_score(query
    values, row values) a matrix of which each partition's k best are kept as well."""
    spark = rows.sparkSession
    parts = []
    for ids, matrix, labels in query_blocks(queries, id_col, vector_col, extra):
        lengths = np.linalg.norm(matrix, axis=1)
        if (lengths == 0).any():
            raise ValueError("cosine of a zero vector")
        held = spark.sparkContext.broadcast((ids, matrix / lengths[:, None], labels))
        few = max(k, SCORE_CELLS // len(ids))

        def run(batches: Iterator[pa.RecordBatch], held=held, few=few) -> Iterator[pa.RecordBatch]:
            names, unit, own = held.value
            # query numbers, row ids (whole 64-bit numbers), scores, extras: the best so far, cut to k a query after each slice
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            for batch in (b.slice(at, few) for b in batches for at in range(0, b.num_rows, few)):
                found = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                vectors = np.array(batch.column(1).to_pylist(), np.float64)
                sizes = np.linalg.norm(vectors, axis=1)
                if (sizes == 0).any():
                    raise ValueError("cosine of a zero vector")
                values = batch.column(2).to_numpy(zero_copy_only=False) if extra else np.zeros(len(found))
                scores = unit @ (vectors / sizes[:, None]).T
                extras = extra_score(own[:, None], values[None, :]) if extra else np.zeros_like(scores)
                mask = found[None, :] != names[:, None]
                near = mask & _top(np.where(mask, scores, -np.inf), k)
                if extra:
                    near |= mask & _top(np.where(mask, extras, -np.inf), k)
                q, j = np.nonzero(near)
                best = tuple(np.concatenate(x) for x in zip(best, (q, found[j], scores[q, j], extras[q, j]), strict=True))
                q, ids, points, more = best
                chosen = []
                for value in (points, more) if extra else (points,):
                    order = np.lexsort((ids, -value, q))
                    own_q = q[order]
                    chosen.append(order[np.arange(len(order)) - np.searchsorted(own_q, own_q) < k])
                keep = np.unique(np.concatenate(chosen))
                best = tuple(x[keep] for x in best)
            q, ids, points, more = best
            yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(ids), pa.array(points), pa.array(more)], names=["query", "id", "score", "extra"])

        source = rows.select(id_col, vector_col, *([extra] if extra else []))
        parts.append(source.mapInArrow(run, "query long, id long, score double, extra double"))
    if not parts:
        return spark.createDataFrame([], "query long, id long, score double, extra double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sparse_dot(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query, term, w) and (doc, term, w) to (query, doc, score): the sum of products over shared terms."""
    return queries.alias("q").join(documents.alias("d"), "term").groupBy("query", "doc").agg(F.sum(F.col("q.w") * F.col("d.w")).alias("score"))


def maxsim(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query, doc, q_vecs array<array>) joined rows to score: for each query vector its best dot product, summed."""
    return queries.join(documents, "pair").withColumn("score", F.aggregate(F.transform("q_vecs", lambda q: F.array_max(F.transform("d_vecs", lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x))


def mean_pool(rows: DataFrame, owner: str, vector: str) -> DataFrame:
    """(owner, vector): the mean of its vectors, dimension by dimension."""
    long = rows.select(owner, F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy(owner, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select(owner, F.transform("v", lambda z: z["x"]).alias(vector))
