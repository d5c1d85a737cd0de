import pytest
from pyspark.sql import functions as F

from rankspark.functions import labels as B
from rankspark.operators import replay as P


def test_rescore_and_ranks(spark):
    j = spark.createDataFrame([(1, i, s, r) for i, (s, r) in enumerate([(0.1, 3.0), (0.9, 1.0), (0.5, 0.0)])], "query int, pos int, score double, relevance double")
    got = {r.variant: r.ndcg for r in P.rescore(j, [("a", "linear", 1.0), ("b", "linear", 0.5), ("c", "exponential", 1.0)]).collect()}
    assert got["a"] == pytest.approx(got["b"]) and got["c"] < got["a"]
    stored = P.ndcg(j)
    assert P.replay_matches(j, stored).first().wrong == 0
    s = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.9)], "query int, doc int, score double")
    assert P.own_rank(s, spark.createDataFrame([(1, 1)], "query int, doc int")).first()["rank"] == 2


def test_checkpoints_and_expansion(spark):
    m = spark.createDataFrame([(1, "a", "b", "b", 1), (1, "a", "c", "c", 2), (1, "b", "c", "c", 3)], "target int, a string, b string, winner string, round int")
    truth = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 3.0)], "target int, player string, value double")
    got = {r["round"]: r.mean_inversions for r in P.checkpoint_inversions(m, truth, [1, 3]).collect()}
    assert got[3] == 0.0 and got[1] >= 1.0
    tree = spark.createDataFrame([("/M", None), ("/M/A", "/M"), ("/M/B", "/M"), ("/M/A/x", "/M/A")], "path string, parent_path string")
    kept = P.expand(tree, spark.createDataFrame([(7, "/M")], "item int, path string"), lambda d: d.where(~F.endswith("path", F.lit("B"))))
    assert sorted(r.path for r in kept.collect()) == ["/M/A", "/M/A/x"]


def test_labels(spark):
    df = spark.createDataFrame([("a $x$ b \\[y\\]", "/M/Alg/GeneralTopics/GroupTheory")], "t string, tag string")
    r = df.select(B.text_and_math(F.col("t")).alias("p"), B.marked_math(F.col("t")).alias("m"), B.topic(F.col("tag"), "M", ["misc"]).alias("x"), B.spaced_label(F.lit("GroupTheory")).alias("l")).first()
    assert [(x.kind, x.value) for x in r.p] == [("text", "a "), ("math", "$x$"), ("text", " b "), ("math", "\\[y\\]")]
    assert r.m == "a [imath]x[/imath] b [imath]y[/imath]" and r.x == "GroupTheory" and r.l == "Group Theory"
