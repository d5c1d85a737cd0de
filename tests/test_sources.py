import json

import pytest
from pyspark.sql import functions as F

from rankspark.functions import filters as L
from rankspark.sources import sinks, trees


def test_trees(spark, tmp_path):
    tree = {"title": "M", "idx": 0, "frequency": 1.0, "links": [{"title": "A", "idx": 1, "frequency": 0.5, "links": [{"title": "B", "idx": 2, "links": []}]}]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(tree))
    got = trees.load_tree(spark, str(path))
    assert {(r.idx, r.path, r.parent_path, r.depth) for r in got.collect()} == {(0, "/M", None, 1), (1, "/M/A", "/M", 2), (2, "/M/A/B", "/M/A", 3)}
    assert [r.path for r in trees.children(got, "M/").collect()] == ["/M/A"]
    back = json.loads(trees.tree_json(got))
    assert back["links"][0]["links"][0]["title"] == "B"
    tree["links"][0]["idx"] = 5
    path.write_text(json.dumps(tree))
    with pytest.raises(ValueError):
        trees.load_tree(spark, str(path))


def test_checkpoints_and_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"0": 0.5, "3": null, "x": 1}')
    assert {(r.query, r.value) for r in sinks.read_checkpoint(spark, str(tmp_path / "c.json")).collect()} == {(0, 0.5), (3, None)}
    (tmp_path / "b.json").write_text("{broken")
    assert sinks.read_checkpoint(spark, str(tmp_path / "b.json")).count() == 0
    assert sinks.read_checkpoint(spark, str(tmp_path / "none.json")).count() == 0
    df = spark.createDataFrame([("a_b", 1.23456, None), ("c", float("nan"), 2)], "m string, v double, n int")
    assert sinks.markdown(df).splitlines()[2] == "| a_b | 1.235 | - |"
    assert "a\\_b & 1.235 & -" in sinks.latex(df)
    sinks.write_rounded_csv(df, str(tmp_path / "csv"))
    assert {(r.m, r.v) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {("a_b", "1.2346"), ("c", None)}
    (tmp_path / "l.csv").write_text("﻿Model,Score\nx,1\n")
    assert sinks.leaderboard(spark, str(tmp_path / "l.csv"), ["Model"]).first().Model == "x"
    with pytest.raises(ValueError):
        sinks.leaderboard(spark, str(tmp_path / "l.csv"), ["Rank"])
    matches = spark.createDataFrame([("t", "a", "b", "1", "", 1)], sinks.MATCHES)
    sinks.append_matches(matches, str(tmp_path / "m"))
    sinks.append_matches(matches, str(tmp_path / "m"))
    assert sinks.read_matches(spark, str(tmp_path / "m")).count() == 2
    (tmp_path / "p.csv").write_text("target,first,second,who,id,n\nt,a,b,2,,3\n")
    assert tuple(sinks.read_matches(spark, str(tmp_path / "p.csv")).first()) == ("t", "a", "b", "2", None, 3)


def test_predicates(spark):
    df = spark.createDataFrame([(["/M/Algebra/x", "/M/Odd/y", "/M/Algebra/z", "/M"], "idea", [1.0, 2.0], {"a": 0.9, "b": 0.1, "p": 1.0})], "tags array<string>, idea string, rel array<double>, s map<string,double>")
    r = df.select(
        L.domains(F.col("tags"), {"Algebra": "alg"}).alias("d"), L.usable(F.col("tags"), F.lit("  ")).alias("u"), L.valid_relevance(F.col("rel"), 2).alias("v2"),
        L.valid_relevance(F.col("rel"), 3).alias("v3"), L.above(F.col("s"), F.lit("p"), 0.5).alias("a"), L.family(F.lit("org/bge-m3"), ["bge"]).alias("f"), L.family(F.lit("bgex"), ["bge"]).alias("g"),
        L.generic(F.lit("General Topics"), ["other"], F.lit("x")).alias("n"), L.basic(F.lit(None), F.lit(False), F.col("idea"), ["^x"]).alias("b"), L.not_blocked(F.col("idea"), ["00"]).alias("k"),
    ).first()
    assert (r.d, r.u, r.v2, r.v3, r.a, r.f, r.g, r.n, r.b, r.k) == (["alg"], False, True, False, {"a": 0.9}, True, False, True, True, True)
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception, match="unknown key: 3"):
        L.require_all_found(spark.createDataFrame([(1,), (3,)], "k int"), keys, "k").collect()
    a = spark.createDataFrame([(1, 1.0)], "k int, v double")
    assert L.require_equal(a, a, ["k"], "v", 1e-12).first().compared == 1
    with pytest.raises(Exception, match="results differ"):
        L.require_equal(a, a.withColumn("v", F.lit(2.0)), ["k"], "v", 1e-12).collect()
