"""Rewrite caches: batches, restarts, instructions, and scorers that read them."""

import pytest
from pyspark.sql import functions as F

from rankspark import scorers
from rankspark.operators import rewrites as W


def answers():
    """A function that executors get by value."""

    def two(texts):
        return [[f"{t} one", f"{t} two"] if t != "mute" else [] for t in texts]

    return two


def test_a_stopped_run_goes_on_with_what_is_missing(spark, tmp_path):
    names = [f"t{k}" for k in range(40)] + ["mute", "t3", "t3", None]
    texts, log = spark.createDataFrame([(t,) for t in names], "text string"), str(tmp_path / "log")
    shouted = answers()

    def logged(batch):
        with open(log, "a") as file:
            file.writelines(f"{t}\n" for t in batch)
        return shouted(batch)

    def failing(batch):
        if "t7" in batch:
            raise RuntimeError("no answer")
        return logged(batch)

    with pytest.raises(Exception, match="no answer"):
        W.fill_cache(texts, str(tmp_path / "cache"), failing, 5)
    done = {r.text for r in spark.read.schema(W.CACHE).parquet(str(tmp_path / "cache")).collect()}
    assert "t7" not in done
    before = set(open(log).read().split()) if (tmp_path / "log").exists() else set()
    assert done <= before
    open(log, "w").close()
    cache = W.fill_cache(texts, str(tmp_path / "cache"), logged, 5)
    asked = open(log).read().split()
    assert len(asked) == len(set(asked)) and done.isdisjoint(asked) and "mute" in asked
    want = {(t, n, s) for t in set(names) - {None, "mute"} for n, s in enumerate(shouted([t])[0])}
    rows = [(r.text, r.sample, r.rewrite) for r in cache.collect()]
    assert len(rows) == len(want) and set(rows) == want
    with pytest.raises(Exception, match="answers for"):
        W.fill_cache(spark.createDataFrame([("new",)], "text string"), str(tmp_path / "cache"), lambda batch: [], 1)
    assert W.fill_cache(texts.limit(0), str(tmp_path / "none"), shouted).collect() == []


def test_samples_and_instructions(spark):
    cache = spark.createDataFrame([("a", 1, "a two"), ("a", 0, "a one"), ("b", 0, None)], W.CACHE)
    texts = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "text string")
    found = {r.text: r.rewrites for r in W.samples_of(texts, cache).collect()}
    assert found == {"a": ["a one", "a two"], "b": [None], "c": None, None: None}
    with pytest.raises(Exception, match="no rewrite of"):
        W.samples_of(texts, cache, strict=True).collect()
    one = W.samples_of(texts.where("text = 'a'"), cache, strict=True)
    assert one.select(W.reinstructed(F.col("rewrites"), "find").alias("r")).first().r == ["Instruct: find\nQuery: a one", "Instruct: find\nQuery: a two"]
    assert one.select(W.reinstructed(F.col("rewrites"), None).alias("r")).first().r == ["a one", "a two"]


def test_scorers_meet_rewrites(spark):
    pairs = spark.createDataFrame([(0, 0, 5, "cat", "red fox"), (0, 1, 6, "cat", "cat"), (1, 0, 5, "sky", "sky blue"), (1, 1, 6, "sky", "fox")], "query long, pos int, doc long, query_text string, doc_text string")
    cache = spark.createDataFrame([("cat", 0, "fox"), ("cat", 1, "cat")], W.CACHE)
    overlap = scorers.pointwise(lambda q, d: [float(len(set(a.split()) & set(b.split()))) for a, b in zip(q, d, strict=True)])
    scored = W.on_rewrites(overlap, cache)(pairs)
    assert sorted(scored.columns) == sorted([*pairs.columns, "score"])
    assert {(r.query, r.pos, r.query_text): r.score for r in scored.collect()} == {(0, 0, "cat"): 1.0, (0, 1, "cat"): 0.0, (1, 0, "sky"): 1.0, (1, 1, "sky"): 0.0}
    assert {(r.query, r.pos): r.score for r in W.averaged(overlap, cache, 2)(pairs).collect()} == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 1.0, (1, 1): 0.0}
    with pytest.raises(Exception, match="no rewrite of sky"):
        W.on_rewrites(overlap, cache, strict=True)(pairs).collect()
