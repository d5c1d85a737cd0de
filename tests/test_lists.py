"""List kernels against the relational scorers, which shuffle counts."""

import random

import pytest

from rankspark.operators import lexical, lists


@pytest.mark.parametrize("name", ["bm25", "tfidf", "overlap"])
def test_lists_score_as_plans_do(spark, name):
    draw = random.Random(7)
    words = [f"w{k}" for k in range(25)] + ["é", "", "🙂"]
    queries = spark.createDataFrame([(q, draw.choices(words, k=draw.randrange(0, 9))) for q in range(12)], "query int, tokens array<string>")
    candidates = spark.createDataFrame([(q, f"d{d}", draw.choices(words, k=draw.randrange(0, 30))) for q in range(1, 13) for d in range(q % 7)] + [(1, "d0x", []), (20, "only", []), (20, "too", [])], "query int, doc string, tokens array<string>")
    one, other = (sorted((r["query"], r["doc"], round(r["score"], 9)) for r in getattr(m, name)(queries, candidates).collect()) for m in (lists, lexical))
    assert one == other and any(r[2] for r in one)


def test_empty_tables(spark):
    queries = spark.createDataFrame([], "query int, tokens array<string>")
    candidates = spark.createDataFrame([], "query int, doc long, tokens array<string>")
    for f in (lists.bm25, lists.tfidf, lists.overlap):
        assert f(queries, candidates).collect() == []


def test_both_sides_from_the_same_rows(spark):
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(1, 0, "a b", "a"), (1, 1, "a b", "c"), (2, 0, "c", "c c")], "query int, pos int, q string, d string")
    queries = pairs.groupBy("query").agg(F.first("q").alias("t")).select("query", F.split("t", " ").alias("tokens"))
    candidates = pairs.select("query", F.col("pos").alias("doc"), F.split("d", " ").alias("tokens"))
    found = {(r["query"], r["pos"]): r["score"] for r in pairs.join(lists.tfidf(queries, candidates).withColumnRenamed("doc", "pos"), ["query", "pos"]).collect()}
    assert found[1, 0] > 0 == found[1, 1] and found[2, 0] == pytest.approx(1.0)
