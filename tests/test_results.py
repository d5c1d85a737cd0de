"""Result files, vector caches, similarity blocks, chains of checks, and what raises."""

import json
import math
import pickle
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark import evaluation
from rankspark.functions import names as N
from rankspark.functions import text as X
from rankspark.operators import reports as R
from rankspark.operators import vector
from rankspark.sources import results, sinks, vectors


def report(tasks, **more):
    return {"reports": {"m": {"tasks": [{"task": t, "ndcg_at_k": v} for t, v in tasks.items()], "ndcgs_by_task": {t: [v] for t, v in tasks.items()}, "model": "lab/m", **more}}}


def test_reports_are_merged_task_by_task(tmp_path):
    path = str(tmp_path / "deep" / "m__p0.json")
    results.upsert_report(path, "m", {"domains": [["a"]], **report({"x": 0.1, "y": 0.2}, k=5)})
    error = {"reports": {"m": {"error": "gone"}}}
    assert results.upsert_report(path, "m", error)["reports"]["m"]["tasks"]
    body = results.upsert_report(path, "m", report({"y": 0.5, "z": 0.6}, k=10) | {"query_row_idxs": [3]})
    own = body["reports"]["m"]
    assert [(t["task"], t["ndcg_at_k"]) for t in own["tasks"]] == [("x", 0.1), ("y", 0.5), ("z", 0.6)]
    assert own["ndcgs_by_task"] == {"x": [0.1], "y": [0.5], "z": [0.6]} and own["k"] == 10
    assert body["domains"] == [["a"]] and body["query_row_idxs"] == [3]
    assert json.loads((tmp_path / "deep" / "m__p0.json").read_text()) == body
    (tmp_path / "broken.json").write_text("{")
    assert results.upsert_report(str(tmp_path / "broken.json"), "m", error) == error
    assert results.upsert_report(str(tmp_path / "broken.json"), "m", report({"x": 1})) == report({"x": 1})


def test_writers_take_turns(tmp_path):
    path = str(tmp_path / "meta.json")
    threads = [threading.Thread(target=results.upsert_meta, args=(path, {"tasks": [f"t{i}", "t0"], "n": i})) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(results.read_json(results.Path(path))["tasks"]) == sorted(f"t{i}" for i in range(12))
    assert results.versions()["pyspark"]


def test_files_by_stem(spark, tmp_path):
    for folder, name, body in (("a", "m1", '{"mean_seconds": 1.5}'), ("a", "query_sample", '{"mean_seconds": 9}'), ("b", "m 2", '{"mean_seconds": 2.5}'), ("b", "bad", "{nope")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.json").write_text(body)
    got = results.by_stem(spark, f"{tmp_path}/*/*.json", "mean_seconds double").collect()
    assert sorted((r.folder, r.stem, r.mean_seconds) for r in got) == [("a", "m1", 1.5), ("b", "m 2", 2.5)]


def test_checkpoints_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0.5), (3, None), (7, float("nan")), (2**40, 1.0)], "query long, value double")
    sinks.write_checkpoint(rows, str(tmp_path / "c"))
    assert {(r.query, r.value) for r in sinks.read_checkpoint(spark, str(tmp_path / "c")).collect()} == {(0, 0.5), (3, None), (7, None), (2**40, 1.0)}
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), most=4)


def test_vector_caches(spark, tmp_path):
    np.savez(tmp_path / "v.npz", query_full=np.eye(2), document_statement=np.ones((3, 2)))
    held = vectors.from_npz(spark, str(tmp_path / "v.npz"))
    assert sorted((r.side, r.version, r.row_idx) for r in held.collect()) == [("document", "statement", 0), ("document", "statement", 1), ("document", "statement", 2), ("query", "full", 0), ("query", "full", 1)]
    texts = spark.createDataFrame([("query", "full", 1, "why")], "side string, version string, row_idx long, text string")
    assert [(r.text, r.vector) for r in vectors.keyed_by_text(held, texts).collect()] == [("why", [0.0, 1.0])]
    (tmp_path / "v.pkl").write_bytes(pickle.dumps({("query", "why"): np.array([5.0, 6.0]), ("query", "how"): [1, 2]}))
    with pytest.raises(ValueError):
        vectors.from_pickle(spark, str(tmp_path / "v.pkl"))
    both = vectors.merged(vectors.keyed_by_text(held, texts), vectors.from_pickle(spark, str(tmp_path / "v.pkl"), trusted=True))
    assert {r.text: r.vector for r in both.collect()} == {"why": [5.0, 6.0], "how": [1.0, 2.0]}
    rows = spark.range(50).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(0.25).alias("bma"), F.lit(0.5).alias("jaccard"))
    vectors.write_blocks(rows, str(tmp_path / "blocks"), 20)
    assert vectors.blocks_in(spark, str(tmp_path / "blocks")) == [0, 1, 2]
    assert [(r.i, r.j, r.jaccard) for r in vectors.read_rows(spark, str(tmp_path / "blocks"), [41], 20).collect()] == [(41, 42, 0.5)]
    vectors.write_rankings(spark.createDataFrame([("m", 1, [3, 1, 2])], "model string, row int, ranking array<int>"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).first().ranking == [3, 1, 2]


def test_lists_that_do_not_match_raise(spark):
    left, right = spark.range(3).withColumnRenamed("id", "row_idx"), spark.range(2).withColumnRenamed("id", "row_idx")
    with pytest.raises(Exception, match="differ in length"):
        R.zipped(left, right).collect()
    with pytest.raises(Exception, match="no domain"):
        spark.range(1).select(N.first_domain(F.array().cast("array<string>"))).collect()
    queries = spark.createDataFrame([(0, "p", "s", ["a"], [0, 9], [1.0, 0.0])], "row_idx long, problem string, solution string, domains array<string>, candidates array<long>, relevance_scores array<double>")
    documents = spark.createDataFrame([(0, "p", "s")], "row_idx long, problem string, solution string")
    with pytest.raises(Exception, match="no document 9"):
        evaluation.judged_pairs(queries, documents, "statement-full").collect()


def test_listwise_answers(spark):
    cases = {
        '<answer>```json\n{"[1]": 8, "[2]]": 3\n```</answer>': {"[1]": 8.0, "[2]": 3.0},
        'so {"[1]": 1} and then {"[4]": 2.5}': {"[4]": 2.5},
        "no scores": None,
        '```\n{"[3]": 7}\n```': {"[3]": 7.0},
        '```json {"a": 1} ``` ```json {"b": 2} ```': {"b": 2.0},
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(X.group_scores(F.col("t"))).collect()] == list(cases.values())


def test_ids_beyond_doubles_and_ties(spark):
    big = 2**53
    rows = [(big + i, [1.0, float(i % 3)]) for i in range(30)]
    found = vector.search(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>"), spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), 4)
    got = {}
    for r in found.collect():
        got.setdefault(r.query, []).append((-r.score, r.id))
    for q in (0, 1):
        a = rows[q][1]
        want = sorted((-round(sum(x * y for x, y in zip(a, v, strict=True)) / math.hypot(*a) / math.hypot(*v), 12), i) for i, v in rows if i != big + q)[:4]
        assert sorted((round(s, 12), i) for s, i in got[big + q]) == want


def test_small_pieces(spark):
    one = spark.range(1)
    assert one.select(N.wrapped(F.lit("aa bb cccc d"), 5)).first()[0] == "aa bb\ncccc\nd"
    assert one.select(R.packed(F.array(*[F.lit(x) for x in (5, 5, 3, 20, 1)]), 10)).first()[0] == [0, 0, 1, 2, 3]
    assert [one.select(N.short_count(F.lit(x))).first()[0] for x in (12, 1200, 2_500_000)] == ["12", "1.2k", "2.5M"]
    assert one.select(N.as_list(F.lit(None).cast("string"), False), N.as_list(F.lit("a"), False)).first()[:] == ([], ["a"])
    # two-sided Student's t: tabled values
    for t, df, p in ((2.228139, 10, 0.05), (12.7062, 1, 0.05), (4.302653, 2, 0.05), (1.0, 7, 0.350617), (3.18245, 3, 0.05)):
        assert abs(one.select(R.t_two_sided(F.lit(t), F.lit(df))).first()[0] - p) < 1e-5
