"""Faults that showed on larger tables, each on the least input that has it."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import oracle
from pyspark.sql import functions as F
from rankspark import scorers
from rankspark.functions import scan
from rankspark.functions import text as N
from rankspark.operators import statistics as A
from rankspark.operators import structure as S
from rankspark.operators import taxonomy as X
from rankspark.operators import tournament as T
from rankspark.operators import vector as V
from rankspark.plans import construction, registry
from rankspark.streaming import upserts as U


def test_grid_means_between_two_thousandths(spark):
    # hundreds of the means end in a 5; the twin sums in the order of ids when one thread reads the table
    folder = "/root/testdata/sf0.1"
    con = oracle.duck(folder)
    con.execute("set threads = 1")
    assert oracle.differences(spark, con, folder, "pivot_grid", registry.QUERIES["pivot_grid"], registry.ORACLES["pivot_grid"]) == ""


def test_grid_sums_in_the_order_of_the_table(spark, tmp_path):
    # rows that are not stored by id, ids that come twice, several files; one thread of the twin reads them in this order
    rows = pq.read_table("/root/testdata/sf0.1/events.parquet", columns=["event_id", "user_id", "event_type", "value"])
    rows = rows.take(np.random.default_rng(6).permutation(len(rows)))
    rows = rows.set_column(0, "event_id", pa.array(np.arange(len(rows)) // 2 * 7 % 50_000))
    (tmp_path / "events.parquet").mkdir()
    for i, n in enumerate((5_000, 70_000, 25_000)):  # Spark reads larger files first
        pq.write_table(rows.slice((0, 5_000, 75_000)[i], n), tmp_path / f"events.parquet/part-{i}.parquet", row_group_size=9_000)
    con = oracle.duck("")
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert oracle.differences(spark, con, str(tmp_path), "pivot_grid", registry.QUERIES["pivot_grid"], registry.ORACLES["pivot_grid"]) == ""


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_swiss_pairs_call_no_python_for_each_target(spark):
    standings = spark.createDataFrame([(t, p, n) for t in range(50) for n, p in enumerate("abcd")], "target long, player string, points long")
    pairs = T.swiss_pairs(standings, spark.createDataFrame([(0, "a", "b")], "target long, a string, b string"), "1")
    assert "CoGroup" not in _plan(pairs)
    found = [tuple(r) for r in pairs.where("target = 0").collect()]
    assert sorted(found) == [(0, "a", "c"), (0, "b", "d")] and pairs.count() == 100


def test_ratings_call_no_python_for_each_target(spark):
    rng = np.random.default_rng(3)
    rows = [(t, f"p{a}", f"p{b}", f"p{(a, b, 'tie')[rng.integers(3)]}") for t, n in enumerate([2, 3, 9, 40, 9, 2] * 5) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6 or b == a + 1]
    rows = [(t, a, b, "tie" if w == "ptie" else w) for t, a, b, w in rows]
    rated = T.bradley_terry(spark.createDataFrame(rows, "target long, a string, b string, winner string"))
    assert "FlatMapGroups" not in _plan(rated)
    got = {(r.target, r.player): r.rating for r in rated.collect()}
    for t in range(30):
        own = [r[1:] for r in rows if r[0] == t]
        names = sorted({p for r in own for p in r[:2]})
        a, b = (np.array([names.index(r[k]) for r in own]) for k in (0, 1))
        wins = [np.array([0.5 if r[2] == "tie" else float(r[2] == r[k]) for r in own]) for k in (0, 1)]
        want = T.fit_bradley_terry(a, b, *wins, len(names))
        assert np.allclose([got.pop((t, p)) for p in names], want, atol=1e-9)
    assert not got


def test_pair_statistics_call_no_python_for_each_group(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, *(None if rng.random() < 0.1 else float(rng.integers(6)) for _ in range(2))) for g in range(40) for i in range(g % 7 + 1)]
    found = A.pair_statistics(spark.createDataFrame(rows, "g long, i long, a double, b double"), "g", "i", "a", "b")
    assert "FlatMapGroups" not in _plan(found)
    got = {r.g: (r.inversions, r.pairs) for r in found.collect()}
    want = {}
    for g in range(40):
        own = [r[2:] for r in rows if r[0] == g]
        if len(own) > 1:
            pairs = [(x, y) for i, x in enumerate(own) for y in own[i + 1 :]]
            want[g] = (sum(None not in x + y and (x[0] - y[0]) * (x[1] - y[1]) < 0 for x, y in pairs), len(pairs))
    assert got == want


def test_bootstrap_shuffles_no_draw(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BITS", 3)  # more blocks than one
    values = spark.createDataFrame([("all", i, float(i * i % 17)) for i in range(50)] + [("b", i, float(i)) for i in range(9)], "g string, idx long, v double")
    found = A.bootstrap(values, "g", "v", {"all": None, "b": 4}, 100, "s")
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert any("block" in line and "broadcast" in line for line in joins)
    got = {r.g: (r.mean, r.lo, r.hi) for r in found.collect()}
    for g, n, k in (("all", 50, 50), ("b", 9, 4)):
        held = np.array([i * i % 17 if g == "all" else i for i in range(n)], float)
        means = [held[[int(hashlib.md5(f"s|{g}|{rep}|{draw}".encode()).hexdigest()[:8], 16) % n for draw in range(k)]].mean() for rep in range(100)]
        assert np.allclose(got[g], (held.mean(), *np.quantile(means, (0.025, 0.975))))


def test_bootstrap_hashes_draws_in_arrays(spark, monkeypatch):
    # not a row a draw; groups of unlike names and lengths, unknown values, parts of a resample
    monkeypatch.setattr(A, "BLOCK_BITS", 3)
    monkeypatch.setattr(A, "LANES", 70, raising=False)
    long = "é" * 60
    held = {"all": [float(i * i % 17) for i in range(120)], long: [None if i % 3 else float(i) for i in range(9)], "none": [None] * 4}
    values = spark.createDataFrame([(g, i, v) for g, vs in held.items() for i, v in enumerate(vs)], "g string, idx long, v double")
    found = A.bootstrap(values, "g", "v", {"all": None, long: 105, "none": 2, "absent": 3}, 120, "s")
    assert "MapInArrow" in _plan(found) and "md5" not in _plan(found)
    got = {r.g: (r.mean, r.lo, r.hi) for r in found.collect()}
    assert got.pop("none") == (None, None, None) and got.keys() == {"all", long}
    for g, k in (("all", 120), (long, 105)):
        vs = np.array(held[g], float)
        means = [np.nanmean(vs[[int(hashlib.md5(f"s|{g}|{rep}|{draw}".encode()).hexdigest()[:8], 16) % len(vs) for draw in range(k)]]) for rep in range(120)]
        assert np.allclose(got[g], (np.nanmean(vs), *np.quantile(means, (0.025, 0.975))))


def test_copies_of_sets_meet_once(spark, tmp_path):
    tags = [["x", "y"], ["y", "x", "x"], [], None, ["y"], ["z", None], ["x"], ["x", "y"]] * 5
    sets = spark.createDataFrame(list(enumerate(tags)), "id long, tags array<string>")
    sims = spark.createDataFrame([(a, b, 1.0 if a == b else 0.3 if "x" in (a, b) else -0.2) for a in "xy" for b in "xy"], "a string, b string, sim double")
    asked = sets.where("id % 3 = 0")
    found = X.set_pair_summaries(asked, sets, sims, "id", "tags", str(tmp_path), block=2)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 5
    got = {r.id: tuple(r)[1:] for r in found.collect()}
    want = {}
    for r in X.set_pairs(asked, sets, sims, "id", "tags").collect():
        want.setdefault(r.i, []).append((r.bma, r.jac))
    assert got.keys() == want.keys()
    for i, pairs in want.items():
        bma, jac = np.array(pairs).T
        assert np.allclose(got[i], (len(pairs), bma.mean(), bma.max(), jac.mean(), (jac == 1).sum()))


def test_search_makes_no_row_for_each_shared_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    texts = spark.createDataFrame([(i, " ".join(["$a+b$"] * (i + 1) + ["$c^d$"] * (i % 3))) for i in range(30)], "id long, text string")
    S.write_index(texts, str(tmp_path))
    found = S.search(texts, str(tmp_path), 3)
    assert "MapInArrow" in _plan(found)
    counts = {i: Counter(t for t in scan.structure_terms(text) if t[0] == "s") for i, text in texts.collect()}
    want = set()
    for q, a in counts.items():
        scores = sorted((-2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())), i) for i, b in counts.items())
        want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(scores[:3])}
    assert {tuple(r) for r in found.collect()} == want


def test_chunks_split_a_text_once(spark):
    text = spark.createDataFrame([(" ".join(map(str, range(10))),), ("",)], "t string")
    found = text.select(N.chunks(F.split("t", " "), 4).alias("c"))
    plan = _plan(found)
    assert plan.count("split(") == 1
    assert [r.c for r in found.collect()] == [[["0", "1", "2", "3"], ["4", "5", "6", "7"], ["8", "9"]], [[""]]]


def test_listwise_answers_are_met_by_one_join(spark):
    groups = spark.createDataFrame([(1, p, 0, p // 2, p % 2 + 1) for p in range(4)], "query int, pos int, epoch int, group int, place int")
    answers = spark.createDataFrame([(1, 0, 0, '{"[1]": 8, "[1] ": 6}'), (1, 0, 1, "none")], "query int, epoch int, group int, answer string")
    found = scorers.listwise_scores(groups, answers)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {r.pos: round(r.score, 9) for r in found.collect()} == {0: 0.7, 1: 0.0, 2: 0.0, 3: 0.0}


def test_sparse_dot_counts_no_token_that_no_query_has(spark):
    plan = _plan(registry.QUERIES["sparse_dot_rerank"](spark, "/root/testdata/sf0.001"))
    assert "LeftSemi" in plan and "REPARTITION_BY_COL" not in plan


def test_upserts_hold_many_keys_in_one_state(spark, tmp_path):
    # three versions of 3,000 keys in three files; state of a key alone is a call and a row of the store for each
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    kinds = "k long, j string, version long, at timestamp"
    for v in (1, 3, 2):
        spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("j"), F.lit(v).cast("long").alias("version"), F.expr(f"timestamp'2024-01-01' + make_interval(0, 0, 0, {v})").alias("at")).coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source)
    query = U.upsert(rows, ["k", "j"], "version", "at", str(tmp_path / "out"), state)
    query.awaitTermination()
    let = Counter(r.version for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert let[1] == let[3] == 3000 and let[2] in (0, 3000)
    assert U.current(spark, str(tmp_path / "out"), ["k", "j"], "version").where("version = 3").count() == 3000
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= U.GROUPS


def test_a_key_in_a_group_expires_alone(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def give(day, *rows):
        data = [(k, v, f"2024-01-{day:02} 00:00:00") for k, v in rows]
        spark.createDataFrame(data, "k long, version long, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        U.upsert(spark.readStream.schema("k long, version long, at timestamp").parquet(source), ["k"], "version", "at", out, state, "2 days").awaitTermination()

    U.GROUPS, before = 1, U.GROUPS
    try:
        give(1, (1, 5), (2, 5))
        give(2, (1, 4), (2, 6))
        give(10, (3, 1))  # keys 1 and 2 are 8 days behind
        give(11, (1, 4), (3, 1))
    finally:
        U.GROUPS = before
    found = sorted((r.k, r.version) for r in spark.read.parquet(out).collect())
    assert found == [(1, 4), (1, 5), (2, 5), (2, 6), (3, 1)]


def test_points_meet_matches_without_a_join(spark):
    rows = [(1, "a", "b", "a"), (1, "a", "c", "tie"), (1, "b", "c", "c"), (2, "a", "b", None), (2, "b", "c", "a"), (3, "x", "y", "z"), (3, None, "y", "y")]
    games = spark.createDataFrame(rows, "target long, a string, b string, winner string")
    players = games.select("target", F.col("a").alias("player")).union(games.select("target", "b")).distinct()
    found = T.points(games)
    assert "Join" not in _plan(found) and found.schema["points"].dataType.simpleString() == "bigint"
    assert Counter(tuple(r) for r in found.collect()) == Counter(tuple(r) for r in T.points(games, players).collect())


def test_matches_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(construction, "TASK_ROWS", 500, raising=False)
    for name in ("tournament_points", "unplayed_pairs"):
        plan = _plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "hashpartitioning(l_partkey" in plan and "REPARTITION_BY_NUM" in plan


def test_unplayed_pairs_stay_where_matches_are_made(spark, monkeypatch):
    # a join deals both sides by pair once more, to as many tasks as the session has at any size
    monkeypatch.setattr(construction, "TASK_ROWS", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(registry.QUERIES["unplayed_pairs"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(l_partkey") == 2
    kinds = "target long, a string, b string"
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "a", "c"), (2, "a", "b"), (2, "a", None), (None, "a", "b"), (3, "x", "y"), (3, "x", "y")], kinds)
    known = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "a", None), (None, "a", "b"), (3, "x", "y"), (4, "x", "y")], kinds)
    found = Counter(tuple(r) for r in T.unplayed(pairs, known).collect())
    assert found == Counter(tuple(r) for r in pairs.join(known, ["target", "a", "b"], "left_anti").collect()) and found[1, "a", "c"] == 2


def test_texts_are_scanned_in_slices(spark):
    # a text alone, empty and null ones, and more than a slice holds; what a task holds is bounded by the slice
    texts = ["$a$ b " * 60_000, None, "", *(["x $y$ \\(z\\) é"] * 2500), "no math"]
    parts = list(scan._slices(pa.array(texts)))
    assert [t for p in parts for t in p.to_pylist()] == texts and max(len(p) for p in parts) <= 1000 and len(parts[0]) == 1
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    found = rows.select("id", scan.tex_pieces_of(F.col("t"), True).alias("p"), scan.structure_terms_of(F.col("t")).alias("s"), scan.structure_counts_of(F.col("t")).alias("c")).where("id > 0").collect()
    for r in found:
        assert [tuple(p) for p in r.p] == scan.tex_pieces(texts[r.id], True) and r.s == scan.structure_terms(texts[r.id])
        assert [tuple(p) for p in r.c] == scan._counted(texts[r.id])
    assert len(found) == len(texts) - 1


def test_search_holds_a_bounded_matrix_of_scores(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=4)], int(rng.integers(9))) for i in range(900)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label long").coalesce(1)

    def near(own, other):
        if own.size * other.size > 30 * 64:
            raise ValueError("a larger matrix")
        return -np.abs(own - other).astype(float)

    monkeypatch.setattr(V, "SCORE_CELLS", 30 * 64, raising=False)
    found = V.search(rows.where("vec_id % 30 = 0"), rows, 5, extra="label", extra_score=near).collect()
    unit = np.array([v for _, v, _ in vectors])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for q in range(0, 900, 30):
        score = unit @ unit[q]
        score[q] = -2
        own = sorted(((r.score, r.id) for r in found if r["query"] == q), reverse=True)[:5]
        assert [i for _, i in own] == np.argsort(-score)[:5].tolist()


def test_lists_longer_than_a_slice_score_by_structure(spark):
    texts = ["$x^{2}+1$ word " * 30_000, "$y^{2}+1$ word", "no math", "$a=b$"]
    assert len(list(scan._slices(pa.array(texts)))) == 2
    pairs = spark.createDataFrame([(0, i, i, texts[1], t) for i, t in enumerate(texts)], "query long, pos int, doc long, query_text string, doc_text string").coalesce(1)
    got = {r.pos: r.score for r in scorers.make_scorer("math-structure")(pairs).collect()}
    weigh = lambda t: S.WEIGHTS[t[0]]
    asked = Counter(scan.structure_terms(texts[1]))
    for i, t in enumerate(texts):
        own = Counter(scan.structure_terms(t))
        size = sum(n * weigh(x) for c in (asked, own) for x, n in c.items())
        assert abs(got[i] - 2 * sum(n * weigh(x) for x, n in (asked & own).items()) / size) < 1e-9
