"""Operators against hand-computed values and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankspark import evaluation, scorers
from rankspark.functions import text as X
from rankspark.operators import ranking as R
from rankspark.operators import selection as S
from rankspark.operators import statistics as A
from rankspark.operators import taxonomy as T
from rankspark.operators import tournament as G
from rankspark.operators import vector as V
from rankspark.sources import runs
from rankspark.sources.tables import with_row_idx
from rankspark.streaming import resume


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ndcg_edges(spark):
    data = [(1, i, s, r) for i, (s, r) in enumerate([(0.1, 3.0), (0.9, 1.0), (0.5, 0.0)])] + [(2, 0, 1.0, 0.0), (2, 1, 0.0, 0.0)] + [(3, i, 10.0 - i, 5.0 - i) for i in range(4)]
    j = spark.createDataFrame(data, "query int, pos int, score double, relevance double")
    got = dict(rows(R.ndcg(j)))
    dcg = 1 / math.log2(2) + 0 + 7 / math.log2(4)
    ideal = 7 / math.log2(2) + 1 / math.log2(3)
    assert got[1] == pytest.approx(dcg / ideal) and got[2] == 0.0 and got[3] == pytest.approx(1.0)
    linear = dict(rows(R.ndcg(j, variant="linear")))
    scaled = dict(rows(R.ndcg(j, variant="linear", scale=0.6)))
    assert all(linear[q] == pytest.approx(scaled[q]) for q in linear)
    with pytest.raises(ValueError):
        R.gain(F.lit(1.0), "other")


def test_branches_and_ties(spark):
    s = spark.createDataFrame([(1, 0.5, ["a", "b"]), (2, None, ["a"]), (3, 1.0, [])], "query int, ndcg double, domains array<string>")
    got = {r.branch: (r["mean"], r.n) for r in R.with_all_branches(R.branch_means(s), ["a", "b", "c"]).collect()}
    assert got == {None: (0.75, 2), "a": (0.5, 1), "b": (0.5, 1), "c": (0.0, 0)}
    t = spark.createDataFrame([([1.0, 2.0, 2.0, 0.5], [5, 7, 9, 1])], "s array<double>, i array<int>")
    top = t.select(R.top_tuples(F.col("s"), F.col("i"), 2).alias("t")).first().t
    assert [(x.score, x.id) for x in top] == [(2.0, 7), (2.0, 9)]


def test_average_rank_and_summary(spark):
    v = spark.createDataFrame([(float(x),) for x in [3, 1, 3, 2]], "v double")
    assert rows(R.average_rank(v, "v").select("v", "avg_rank")) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]
    ranks = spark.createDataFrame([(i,) for i in range(1, 101)], "rank int")
    got = R.rank_summary(ranks).first()
    assert (got.avg_rank, got.median_rank, got.max_rank, got.top_8) == (50.5, 50.5, 100, pytest.approx(0.08))
    assert got.trimmed_mean_rank_95 == pytest.approx(48.0)


def test_statistics(spark):
    j = spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate([(1.0, 1.0), (2.0, 2.0), (2.0, 2.0), (3.0, 1.0)])], "g string, i int, a double, b double")
    got = A.pair_statistics(j, "g", "i", "a", "b").first()
    # concordant 2, discordant 2, tied in a only 0, in b only 1, in both 1
    assert got.inversions == 2 and got.pairs == 6 and got.tau == pytest.approx(0.0)
    p = spark.createDataFrame([("c", 1.0, 5.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0), ("c", 3.0, 7.0), ("c", 0.5, 1.0)], "c string, cost double, score double")
    assert rows(A.pareto(p, "c", "cost", "score").where("frontier").select("cost", "score")) == [(0.5, 1.0), (1.0, 5.0), (1.0, 5.0), (3.0, 7.0)]


def test_taxonomy(spark):
    tags = spark.createDataFrame([("/r/a/x",), ("/r/a",), ("/r/b",)], "path string")
    freq = {r.path: r.frequency for r in T.frequencies(tags).collect()}
    assert freq == {"/r": 1.0, "/r/a": pytest.approx(2 / 3), "/r/a/x": pytest.approx(1 / 3), "/r/b": pytest.approx(1 / 3)}
    sims = T.lin(T.frequencies(tags))
    got = {(r.a, r.b): r.sim for r in sims.collect()}
    assert abs(got["/r", "/r"]) < 1e-9 and got["/r/b", "/r/b"] == pytest.approx(1.0) and got["/r/a/x", "/r/b"] == pytest.approx(0.0)
    pairs = spark.createDataFrame([(1, ["/r/a"], ["/r/a/x", "/r/b"]), (2, [], ["/r/b"])], "k int, a_tags array<string>, b_tags array<string>")
    bma = {r.k: r.bma for r in T.best_match_average(pairs, sims).collect()}
    s = got["/r/a", "/r/a/x"]
    assert bma[2] == 0.0 and bma[1] == pytest.approx((s + s + got["/r/a", "/r/b"]) / 3)
    sets = spark.createDataFrame([(1, ["/r/a"]), (2, ["/r/a/x", "/r/b"]), (3, [])], "id int, tags array<string>")
    full = {(r.i, r.j): (r.bma, r.jac) for r in T.set_pairs(sets, sets, sims, "id", "tags", block=2).collect()}
    assert len(full) == 9 and full[1, 2][0] == pytest.approx(bma[1]) and full[3, 3] == (0.0, 1.0)
    one = spark.createDataFrame([(["/a", "/a b", "/a/b", "/a/b/c", "/a/b"],), ([],)], "t array<string>").select(T.clear_tags(F.col("t")).alias("t")).collect()
    assert [r.t for r in one] == [["/a", "/a b", "/a/b/c"], []]


def test_set_pairs_equal_plain_loops(spark, monkeypatch):
    rnd = random.Random(3)
    names = [f"t{i}" for i in range(8)]
    table = {(a, b): round(rnd.random(), 3) for a in names for b in names}
    sets = {i: [rnd.choice([*names, "unknown"]) for _ in range(rnd.randrange(5))] for i in range(150)}
    sets[150] = None
    monkeypatch.setattr(T, "MOST_CELLS", 150)  # blocks of some ten queries
    every = spark.createDataFrame(list(sets.items()), "id long, tags array<string>")
    sims = spark.createDataFrame([(*k, v) for k, v in table.items()], "a string, b string, sim double")
    got = {(r.i, r.j): (r.bma, r.jac) for r in T.set_pairs(every.where("id % 5 = 0"), every, sims, "id", "tags").collect()}
    assert len(got) == 31 * 151
    for (i, j), (bma, jac) in got.items():
        a, b = set(sets[i] or []), set(sets[j] or [])
        best = sum(max(table.get((x, y), 0) for y in b) for x in a if b) + sum(max(table.get((x, y), 0) for x in a) for y in b if a)
        assert bma == pytest.approx(best / (len(a) + len(b)) if a and b else 0.0)
        assert jac == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert T.set_pairs(every.where("id < 0"), every, sims, "id", "tags").count() == 0


def test_row_positions_of_any_key(spark):
    texts = [(None if i == 7 else f"k{i % 40:02d}é", i) for i in range(900)]
    df = spark.createDataFrame(texts, "t string, n long").repartition(5)
    got = {r.n: r.row_idx for r in with_row_idx(df, "t", "n").collect()}
    want = {n: place for place, (_, n) in enumerate(sorted(texts, key=lambda x: (x[0] is not None, x[0] or "", x[1])))}
    assert got == want
    days = spark.range(300).selectExpr("date_add(date'2024-01-01', cast(id as int)) as d", "cast(id as decimal(12, 2)) as m", "id")
    assert all(r.row_idx == r.id + 5 for r in with_row_idx(days, "d", start=5).collect())
    assert all(r.row_idx == r.id for r in with_row_idx(days, "m").collect())
    assert with_row_idx(df.where("n < 0"), "t", "n").count() == 0


def test_selection(spark):
    v = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(float("nan"),), (None,)], "v double")
    assert S.order_statistic(v, "v", 0.55).first()[0] == 6.0
    with pytest.raises(Exception, match="quota not filled"):
        S.quota_sample(spark.createDataFrame([("a", 1)], "s string, k int"), "s", {"a": 2}, "x", "k").collect()
    got = with_row_idx(spark.createDataFrame([(i * 3,) for i in range(500)], "k long").repartition(7), "k", start=5)
    assert sorted((r.k, r.row_idx) for r in got.collect()) == [(i * 3, i + 5) for i in range(500)]


def test_tournament(spark):
    raw = spark.createDataFrame([(1, "b", "a", "1", "", 1), (1, "a", "b", "1", "", 2), (1, "a", "c", "", "c", 3)], "target int, model_a string, model_b string, winner string, winner_id string, at int")
    games = G.canonical(raw, F.col("at"))
    assert rows(games) == [(1, "a", "b", "a"), (1, "a", "c", "c")]
    rated = {r.player: r.rating for r in G.bradley_terry(games).collect()}
    assert rated["c"] > rated["a"] > rated["b"] and sum(rated.values()) == pytest.approx(0, abs=1e-6)
    tie = spark.createDataFrame([(1, "a", "b", "tie")], "target int, a string, b string, winner string")
    assert {r.rating for r in G.bradley_terry(tie).collect()} == {0.0}
    flat = spark.createDataFrame([(1, 2.0), (1, 2.0)], "g int, v double")
    assert [r.relevance for r in G.min_max(flat, "g", "v").collect()] == [0.0, 0.0]
    players = spark.createDataFrame([(1, p, i) for i, p in enumerate("abcdef")], "target int, player string, points int")
    met = spark.createDataFrame([(1, "a", "b")], "target int, a string, b string")
    pairs = rows(G.swiss_pairs(players, met, "7"))
    assert len(pairs) == 3 and (1, "a", "b") not in pairs and len({p for _, a, b in pairs for p in (a, b)}) == 6


def test_parsers(spark):
    t = spark.createDataFrame([("$x^2$ is Éa two \\(\\frac{1}{2}\\)",), (None,), ("plain",)], "t string")
    got = [tuple(r) for r in t.select(X.math_tokens(F.col("t")), X.word_tokens(F.col("t"))).collect()]
    assert got[0] == (["x", "^", "2", "\\frac", "{", "1", "}", "{", "2", "}"], ["is", "two"]) and got[1] == ([], []) and got[2] == ([], ["plain"])
    g = spark.createDataFrame([('```json\n{"[1]": 5, "[2]]": 3\n```',), ('{"[1]": 5, "[2]]": 3',), ('a {"[1]": 1} b {"[2]": 2}',)], "t string")
    assert [r[0] for r in g.select(X.group_scores(F.col("t"))).collect()] == [{"[1]": 5.0, "[2]": 3.0}, None, {"[2]": 2.0}]
    b = spark.createDataFrame([("\\boxed{a{b}c} \\boxed{d}",), (None,)], "t string").select(X.balanced_boxes(F.col("t")), X.last_boxed(F.col("t"))).collect()
    assert (b[0][0], b[0][1]) == (["a{b}c", "d"], "d")
    p = spark.createDataFrame([("1",), (" P2 ",), (None,), ("p0",)], "t string").select(X.prompt_key(F.col("t"))).collect()
    assert [r[0] for r in p] == ["p1", "p2", "p0", "p0"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.query, r.id): r.score for r in V.search(v.where("vec_id = 1"), v, 5).collect()}
    assert got == {(1, 2): pytest.approx(math.sqrt(0.5)), (1, 3): pytest.approx(0.0)}
    zero = spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="zero vector"):
        zero.select(V.cosine(F.col("a"), F.col("b"))).collect()


def test_runs(spark, tmp_path):
    for stem in ("m__p1__n20_seed42__shard0of2", "m__p1", "a b__p0__part-x"):
        (tmp_path / f"{stem}.json").write_text("{}")
    got = {(r.model, r.prompt, r.n, r.shard, r.part) for r in runs.scan_runs(spark, str(tmp_path)).collect()}
    assert got == {("m", "p1", 20, 0, None), ("m", "p1", None, None, None), ("a b", "p0", None, None, "x")}
    with pytest.raises(Exception, match="shards overlap"):
        runs.merge_shards(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()
    old = spark.createDataFrame([("a", None), ("b", "bad"), ("c", None)], "k string, error string")
    new = spark.createDataFrame([("a", "boom"), ("b", None), ("d", "boom")], "k string, error string")
    assert rows(runs.merge_upsert(old, new, ["k"], F.col("error").isNotNull()).fillna("")) == [("a", ""), ("b", ""), ("c", ""), ("d", "boom")]


def test_evaluate(spark):
    queries = spark.createDataFrame([(0, "red fox", "s", ["x"], [0, 1, 2], [5.0, 0.0, 1.0]), (1, "blue sky", "s", ["x", "y"], [2, 1], [0.0, 3.0])], "row_idx long, problem string, solution string, domains array<string>, candidates array<bigint>, relevance_scores array<double>")
    docs = spark.createDataFrame([(0, "red fox runs", "a"), (1, "blue blue sky", "b"), (2, "green tea", "c")], "row_idx long, problem string, solution string")
    for name in scorers.REGISTRY:
        if name != "math-structure":
            got = {(r.task, r.branch): r["mean"] for r in evaluation.evaluate(queries, docs, name, ["statement-statement"], branches=["x", "y", "z"]).collect()}
            assert 0.4 < got["statement-statement", None] <= 1.0 and got["statement-statement", "z"] == 0.0
    done = spark.createDataFrame([("full-full", 0, 0.25), ("full-full", 1, None)], "task string, query long, ndcg double")
    got = evaluation.evaluate(queries, docs, "bm25", ["full-full"], done=done)
    assert {(r.branch, r["mean"], r.n) for r in got.collect()} == {(None, 0.25, 1), ("x", 0.25, 1), ("y", 0.0, 0)}

    class Model:
        def encode(self, texts):
            return [[1.0 + t.count("red"), 1.0 + t.count("blue")] for t in texts]

    assert evaluation.evaluate(queries, docs, Model(), ["statement-statement"]).where("branch is null").first()["mean"] > 0.5
    with pytest.raises(ValueError):
        scorers.make_scorer("nothing")


def test_bootstrap_is_brute_force(spark):
    import hashlib

    import numpy as np
    from rankspark.plans import statistics

    data = [("a", i, float(i * i % 7)) for i in range(9)] + [("all", i, float(i)) for i in range(5)]
    got = {r.g: (r["mean"], r.lo, r.hi) for r in A.bootstrap(spark.createDataFrame(data, "g string, idx long, v double"), "g", "v", {"a": 4, "all": None}, statistics._REPS, "42411").collect()}
    assert statistics._REPS == 10_000
    for g, k in (("a", 4), ("all", 5)):
        values = [v for h, _, v in data if h == g]
        means = [np.mean([values[int(hashlib.md5(f"42411|{g}|{rep}|{draw}".encode()).hexdigest()[:8], 16) % len(values)] for draw in range(k)]) for rep in range(10_000)]
        assert got[g] == pytest.approx((np.mean(values), np.percentile(means, 2.5), np.percentile(means, 97.5)))


def test_confidence_scores_anew(spark):
    import hashlib

    import numpy as np

    words = ["red", "blue", "green", "tea", "fox"]
    docs = spark.createDataFrame([(i, f"{words[i % 5]} {words[(i * 3) % 5]} n{i}", "s") for i in range(12)], "row_idx long, problem string, solution string")
    asked = [(q, words[q % 5], "s", ["x"] if q % 2 else ["x", "y", "other"], [q, (q + 3) % 12, (q + 5) % 12], [2.0, 0.0, float(q % 3)]) for q in range(9)]
    queries = spark.createDataFrame(asked, "row_idx long, problem string, solution string, domains array<string>, candidates array<bigint>, relevance_scores array<double>")
    scores = {r.query: r.ndcg for r in evaluation.per_query(queries, docs, "bm25", ["statement-statement"]).collect()}
    got = {r.branch: (r["mean"], r.lo, r.hi) for r in evaluation.confidence(queries, docs, "bm25", "statement-statement", ["x", "y", "z"], branch_draws=4, reps=50, seed="s").collect()}
    assert set(got) == {"all", "x", "y"}
    for branch, draws in (("all", 9), ("x", 4), ("y", 4)):
        values = [scores[q] for q, _, _, domains, _, _ in asked if branch in ("all", *domains)]
        means = [np.mean([values[int(hashlib.md5(f"s|{branch}|{rep}|{d}".encode()).hexdigest()[:8], 16) % len(values)] for d in range(draws)]) for rep in range(50)]
        assert got[branch] == pytest.approx((np.mean(values), np.percentile(means, 2.5), np.percentile(means, 97.5)))


def test_user_scores_see_the_whole_list(spark):
    queries = spark.createDataFrame([(0, "red fox", "s", ["x"], [2, 0, 1], [1.0, 5.0, 0.0]), (1, "none", "s", ["x"], [2, 1], [0.0, 3.0])], "row_idx long, problem string, solution string, domains array<string>, candidates array<bigint>, relevance_scores array<double>")
    docs = spark.createDataFrame([(0, "red fox runs", "a"), (1, "blue sky", "b"), (2, "green tea", "c")], "row_idx long, problem string, solution string")

    class Model:
        def get_scores(self, query, documents):
            if "none" in query:
                return None
            return [100.0 * len(documents) + 10 * i + ("red" in d) for i, d in enumerate(documents)]

    pairs = evaluation.judged_pairs(queries, docs, "statement-statement").repartition(7)
    got = {(r["query"], r.pos): (r.doc, r.score) for r in scorers.make_scorer(Model())(pairs).collect()}
    assert got == {(0, 0): (2, 300.0), (0, 1): (0, 311.0), (0, 2): (1, 320.0), (1, 0): (2, None), (1, 1): (1, None)}
    each = {r["query"]: r.ndcg for r in evaluation.per_query(queries, docs, Model(), ["statement-statement"]).collect()}
    assert each[1] is None and 0 < each[0] < 1

    class Short:
        def get_scores(self, query, documents):
            return [1.0]

    with pytest.raises(Exception, match="1 scores for"):
        scorers.make_scorer(Short())(pairs).collect()


def test_listwise(spark):
    pairs = spark.createDataFrame([(0, i) for i in range(45)], "query int, pos int")
    groups = scorers.listwise_groups(pairs)
    assert groups.groupBy("epoch", "group").count().where("count > 20").count() == 0 and groups.count() == 90
    answers = groups.where("group = 0").select("query", "epoch", "group").distinct().withColumn("answer", F.lit('{"[1]": 10, "[2]": 5}'))
    got = scorers.listwise_scores(groups, answers)
    assert got.count() == 45 and 2 <= got.where("score > 0").count() <= 4


def test_streaming_resume(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)

    def score(batch):
        return batch.withColumn("score", F.col("id") * 2)

    resume.score_new(stream, score, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    spark.range(5, 9).write.mode("append").parquet(source)
    resume.score_new(stream, score, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(9))
