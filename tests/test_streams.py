"""Progress and upserts over restarts, partial rewrites, shard checks, row sets and reassembly against plain versions."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankspark.operators import rowsets as B
from rankspark.sources import partial as P
from rankspark.streaming import progress as G
from rankspark.streaming import upserts as U


def test_partial_results_grow_and_end_whole(spark, tmp_path):
    items = spark.range(1000).select((F.col("id") % 3).alias("g"), "id").repartition(2)
    path = G.written_items(items, str(tmp_path), 100)
    told = []

    def aggregate(rows):
        return rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("id").alias("s"))

    G.run_with_progress(spark, path, aggregate, str(tmp_path), 3, told.append).awaitTermination()
    counts = [r["n"] for r in G.partials(spark, str(tmp_path)).groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()]
    assert len(counts) >= 3 and counts == sorted(set(counts)) and counts[-1] == 1000 and told == list(range(len(counts)))
    assert sorted(G.whole(spark, str(tmp_path)).select("g", "n", "s").collect()) == sorted(aggregate(items).collect())


def test_a_lost_step_is_done_again(spark, tmp_path):
    path = G.written_items(spark.range(60).repartition(1), str(tmp_path), 10)

    def fails(step):
        if step == 2:
            raise RuntimeError("lost")

    def aggregate(rows):
        return rows.agg(F.count("*").alias("n"))

    with pytest.raises(Exception, match="lost"):
        G.run_with_progress(spark, path, aggregate, str(tmp_path), 1, fails).awaitTermination()
    G.run_with_progress(spark, path, aggregate, str(tmp_path)).awaitTermination()
    assert [r["n"] for r in G.partials(spark, str(tmp_path)).orderBy("step").collect()] == [10, 20, 30, 40, 50, 60]


MATCHES = "a string, b string, version long, winner string, at timestamp"


def test_replayed_matches_come_once(spark, tmp_path):
    """A batch is killed after it wrote; files come again after the restart, and older versions late."""
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def give(*rows):
        spark.sql("select 1").count()
        data = [(a, b, v, w, f"2024-01-0{v + 1 if v is not None else 1} 00:00:00") for a, b, v, w in rows]
        spark.createDataFrame(data, "a string, b string, version long, winner string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def rows():
        return spark.readStream.schema(MATCHES).option("maxFilesPerTrigger", 1).parquet(source)

    give(("p", "q", 1, "p"), ("p", "r", 1, "r"), (None, "q", 1, "x"), ("p", "s", None, "x"))
    U.upsert(rows(), ["a", "b"], "version", "at", sink, state).awaitTermination()
    give(("p", "q", 2, "q"), ("p", "q", 1, "p"), ("p", "r", 1, "r"))

    def killed(batch, number):
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        U.newer(rows(), ["a", "b"], "version", "at").writeStream.outputMode("update").foreachBatch(killed).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    give(("p", "r", 0, "old"), ("p", "q", 2, "q"), ("p", "t", 3, "t"), ("p", "t", 3, "t"))
    U.upsert(rows(), ["a", "b"], "version", "at", sink, state).awaitTermination()
    found = sorted((r["a"], r["b"], r["version"], r["winner"]) for r in U.current(spark, sink, ["a", "b"], "version").collect())
    assert found == [("p", "q", 2, "q"), ("p", "r", 1, "r"), ("p", "t", 3, "t")]
    everything = sorted((r["b"], r["version"]) for r in spark.read.parquet(sink).collect())
    assert everything == [("q", 1), ("q", 2), ("r", 1), ("t", 3)]  # nothing was let through twice


def files(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(folder).rglob("*.parquet")}


def test_a_patch_leaves_other_parts_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    P.write_parts(spark.range(500).select("id", (F.col("id") * 2).alias("x"), F.lit("old").alias("y")), path, "id", 16)
    before = files(path)
    changes = spark.createDataFrame([(3, None, 1), (3, 7, 2), (900, 8, 1)], "id long, x long, at int")
    assert P.patch(spark, path, changes, "id", 16, "at") in (1, 2)
    after = files(path)
    parts = {r[0] for r in changes.select(P.part_of("id", 16)).distinct().collect()}
    assert {k for k in before if after.get(k) == before[k]} == {k for k in before if int(k.split("/")[0].split("=")[1]) not in parts}
    rows = {r["id"]: (r["x"], r["y"]) for r in spark.read.parquet(path).collect()}
    assert rows == {i: (2 * i, "old") for i in range(500)} | {3: (7, "old"), 900: (8, None)}
    assert P.patch(spark, path, changes.limit(0), "id", 16) == 0 and files(path) == after
    P.patch(spark, path, spark.createDataFrame([(4, None)], "id long, x long"), "id", 16)
    assert spark.read.parquet(path).where("id = 4").first()["x"] is None


def test_shards_are_merged_when_whole(spark, tmp_path):
    def table(rows):
        return spark.createDataFrame(rows, "run string, shard int, shards int, n_rows long, n_stated long, seed int")

    whole = [("w", 0, 2, 2, 2, 1), ("w", 1, 2, 1, 1, 1)]
    bad = [("few", 0, 3, 1, 1, 1), ("few", 2, 3, 1, 1, 1), ("mix", 0, 2, 1, 1, 1), ("mix", 1, 2, 1, 1, 9), ("twice", 0, 2, 1, 1, 1), ("twice", 0, 2, 1, 1, 1), ("twice", 1, 2, 1, 1, 1)]
    bad += [("short", 0, 1, 1, 2, 1), ("many", 0, 1, 1, 1, 1), ("many", 1, 2, 1, 1, 1), ("off", 1, 2, 1, 1, 1), ("off", 2, 2, 1, 1, 1), ("dim", 0, 1, 1, None, 1)]
    faults = {r["run"]: r["fault"] for r in P.shard_faults(table(whole + bad), ["seed"]).collect()}
    assert faults == {
        "w": None, "few": "shards are missing: 1", "mix": "shards differ in seed", "twice": "a shard is there twice", "short": "shards without all their rows: 1",
        "many": "shards disagree on how many they are", "off": "shards are missing: 0", "dim": "shards without all their rows: 1",
    }
    rows = spark.createDataFrame([("w", 0, 0, 0.5), ("w", 0, 2, 0.7), ("w", 1, 1, 0.6)], "run string, shard int, row int, score double")
    path = str(tmp_path / "merged")
    with pytest.raises(P.IncompleteShards, match="few: shards are missing"):
        P.merge_shards(table(whole + bad), rows, path, ["seed"])
    with pytest.raises(P.IncompleteShards, match="more than one shard"):
        P.merge_shards(table(whole), rows.unionByName(rows.limit(1)), path, ["seed"])
    assert not Path(path).exists()
    P.merge_shards(table(whole), rows, path, ["seed"])
    assert [r["row"] for r in spark.read.parquet(path).where("run = 'w'").collect()] == [0, 1, 2]


def test_row_sets_against_sets(spark, tmp_path):
    draw = random.Random(2)
    own = {d: {draw.randrange(100_000) for _ in range(n)} for d, n in (("a", 400), ("b", 3000), ("c", 1))}
    own["a"] |= {0, 32_767, 32_768, 65_535, 65_536}
    rows = spark.createDataFrame([(r, d) for d, s in own.items() for r in s] + [(5, None)] + [(0, "a")], "row long, domain string")
    B.write_index(rows, str(tmp_path / "sets"), "row", "domain")
    index = B.read_index(spark, str(tmp_path / "sets"))
    a, b = B.rows_of(index, "a"), B.rows_of(index, "b")
    for how, want in (("and", own["a"] & own["b"]), ("or", own["a"] | own["b"]), ("not", own["a"] - own["b"])):
        assert {r["row"] for r in B.members(B.meet(a, b, how)).collect()} == want
    assert {r["domain"]: r["n"] for r in B.size(index, "n").collect()} == {d: len(s) for d, s in own.items()}
    assert {r["domain"]: r["first"] for r in B.first_row(index, "first").collect()} == {d: min(s) for d, s in own.items()}
    assert B.members(B.meet(a, B.rows_of(index, "none"), "and")).collect() == []


def test_answers_are_reassembled(spark):
    asked = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 5)], "batch int, id int")
    answers = spark.createDataFrame([(1, 3, "late", 2), (1, 3, "c", 1), (1, 1, "a", 1), (1, 9, "?", 1), (3, 1, "?", 1)], "batch int, id int, answer string, place int")
    got = {r["batch"]: tuple(r)[1:] for r in B.reassembled(asked, answers, "batch", "id", "answer", "place").collect()}
    assert got == {1: (3, 2, 1, 1, 1, "a,,c"), 2: (1, 0, 1, 0, 0, ""), 3: (0, 0, 0, 0, 1, "")}


def test_evaluation_in_steps_equals_the_whole_and_goes_on_after_a_loss(spark, tmp_path):
    from rankspark.evaluation import evaluate

    rows = [(q, f"red {q}", "s", ["x"] if q % 2 else ["y", "x"], [0, 1, 2], [float(q % 3), 1.0, 0.0]) for q in range(7)]
    queries = spark.createDataFrame(rows, "row_idx long, problem string, solution string, domains array<string>, candidates array<bigint>, relevance_scores array<double>").coalesce(1)
    docs = spark.createDataFrame([(0, "red fox runs", "a"), (1, "blue 3 sky", "b"), (2, "green 5 red 1 tea", "c")], "row_idx long, problem string, solution string")
    items, seen, fail = G.written_items(queries, str(tmp_path), 2), [], [2]

    def told(step, report):
        if step in fail:
            fail.remove(step)
            raise RuntimeError("lost")
        seen.append((step, {(r.branch, r.n) for r in report.where("branch is null").collect()}))

    def run():
        return G.evaluate_in_steps(items, docs, "bm25", str(tmp_path), ["x", "y", "z"], on_progress=told, tasks=["full-full"])

    with pytest.raises(Exception, match="lost"):
        run()
    got = {(r.branch, round(r["mean"], 9), r.n) for r in run().collect()}
    assert got == {(r.branch, round(r["mean"], 9), r.n) for r in evaluate(queries, docs, "bm25", ["full-full"], branches=["x", "y", "z"]).collect()}
    assert [s for s, _ in seen] == [0, 1, 2, 3] and [n for _, found in seen for _, n in found] == [2, 4, 6, 7]
    empty = G.evaluate_in_steps(G.written_items(queries.limit(0), str(tmp_path / "none"), 2), docs, "bm25", str(tmp_path / "none"), tasks=["full-full"])
    assert empty.collect() == []


def test_options_reach_the_model_and_affixes_only_encoders(spark):
    from rankspark import scorers

    class Coder:
        def __init__(self, word):
            self.word = word

        def encode(self, texts, plus=0):
            return [[1.0 + t.count(self.word), plus + t.count("!")] for t in texts]

    class Lists:
        def get_scores(self, query, documents, times=1):
            return [times * len(d) for d in documents]

    pairs = spark.createDataFrame([(0, 0, 5, "red", "red red"), (0, 1, 6, "red", "sky")], "query long, pos int, doc long, query_text string, doc_text string")
    plain = {r.pos: r.score for r in scorers.make_scorer(Coder, {"word": "red"}, {"plus": 1})(pairs).collect()}
    assert plain[0] == pytest.approx((2 * 3 + 1) / (5**0.5 * 10**0.5)) and plain[1] == pytest.approx((2 + 1) / (5**0.5 * 2**0.5))
    marked = {r.pos: r.score for r in scorers.make_scorer(Coder("red"), None, {"query_suffix": "!!", "document_prompt": "red !", "document_encode_kwargs": {"plus": 1}})(pairs).collect()}
    assert marked[1] == pytest.approx((2 * 2 + 2 * 2) / (8**0.5 * 8**0.5))
    assert [r.score for r in scorers.make_scorer(Lists(), None, {"times": 3})(pairs).orderBy("pos").collect()] == [21.0, 9.0]
    for model, init, options in (("bm25", {"a": 1}, None), ("bm25", None, {"k1": 2}), (Coder("x"), {"word": "y"}, None), (Lists(), None, {"query_prompt": "q"}), (lambda pairs: pairs, None, {"document_suffix": "d"})):
        with pytest.raises(ValueError):
            scorers.make_scorer(model, init, options)


def test_more_items_take_larger_steps_of_evaluation(spark, tmp_path, monkeypatch):
    from rankspark.evaluation import evaluate

    monkeypatch.setattr(G, "STEPS", 3, raising=False)
    rows = [(q, f"red {q}", "s", ["x"], [0, 1], [float(q % 3), 1.0]) for q in range(8)]
    queries = spark.createDataFrame(rows, "row_idx long, problem string, solution string, domains array<string>, candidates array<bigint>, relevance_scores array<double>").coalesce(1)
    docs = spark.createDataFrame([(0, "red fox", "a"), (1, "blue 3 sky", "b")], "row_idx long, problem string, solution string")
    steps = []
    got = G.evaluate_in_steps(G.written_items(queries, str(tmp_path), 1), docs, "bm25", str(tmp_path), on_progress=lambda step, _: steps.append(step), tasks=["full-full"])
    want = evaluate(queries, docs, "bm25", ["full-full"])
    assert {(r.branch, round(r["mean"], 9), r.n) for r in got.collect()} == {(r.branch, round(r["mean"], 9), r.n) for r in want.collect()}
    assert steps == [0, 1, 2]


def test_more_items_take_larger_steps_of_progress(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "STEPS", 3, raising=False)
    path = G.written_items(spark.range(80).repartition(1), str(tmp_path), 10)
    G.run_with_progress(spark, path, lambda rows: rows.agg(F.count("*").alias("n")), str(tmp_path)).awaitTermination()
    assert [r["n"] for r in G.partials(spark, str(tmp_path)).orderBy("step").collect()] == [30, 60, 80]
