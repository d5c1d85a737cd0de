"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from rankspark.llm import importance_resampling as ir


def grams(text, longest):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets

    raw, goal = Counter(), Counter()
    for _, text in docs:
        raw.update(map(bucket, grams(text, longest)[1]))
    for text in target:
        goal.update(map(bucket, grams(text, longest)[1]))
    s, t = sum(raw.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in raw}
    out = []
    for doc, text in docs:
        words, found = grams(text, longest)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((r[0], *r[2:], ranks.get(id(r))) for r in out), key=repr)


def found(spark, docs, target, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, ir.digest(ir.resample(frame, goal, **options)).collect()), key=repr)


DOCS = [(None, None), (None, "Some WORDS here"), (1, ""), (2, "!? ..."), (3, "Été É été 漢字 a1 _b_"), (4, "x " * 20_000), (4, "x " * 20_000)]
DOCS += [(k, " ".join(f"w{(k * j) % 29}" + ("É" if j % 7 == 0 else "") for j in range(k % 60))) for k in range(10, 210)]
GOAL = ["w1 w2 w3 w3 W3", None, "", "w5É w4", "x"]


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 97, "percent": 45, "least": 3, "seed": 5}])
def test_against_a_plain_version(spark, options):
    given = {("least_words" if k == "least" else k): v for k, v in options.items()}
    assert found(spark, DOCS, GOAL, **given) == plain(DOCS, GOAL, **options)


def test_ranks_are_gapless_over_partitions(spark):
    ranks = sorted(r[-1] for r in found(spark, DOCS, GOAL, percent=100, least_words=0) if r[-1])
    assert ranks == list(range(1, len(DOCS) + 1))


def test_repeated_rows_are_drawn_each(spark):
    docs = [(1, "a b c d")] * 40 + [(2, "b c")]
    rows = found(spark, docs, ["a"], percent=100, least_words=4)
    assert sorted(r[-1] for r in rows if r[0] == 1) == list(range(1, 41)) and len({r[:4] for r in rows if r[0] == 1}) == 1
    assert [r[-1] for r in rows if r[0] == 2] == [None]


def test_ties_go_to_smaller_ids(spark):
    scored = spark.createDataFrame([(k, k % 7, 25, 25, 0, 5) for k in range(70)], "row long, doc_id long, n_words long, n_features long, weight long, score long")
    ranked = sorted(map(tuple, ir.drawn(scored, 50, 20).where("rank is not null").select("rank", "doc_id").collect()))
    assert ranked == [(k + 1, k // 10) for k in range(35)]


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], GOAL) == []
    assert found(spark, DOCS, []) == plain(DOCS, [])
    clash = spark.createDataFrame([(1, "a b", 2, 3, 4, 5, "y")], "doc_id long, text string, row int, rank int, bucket int, buckets int, n_words string")
    goal = spark.createDataFrame([("a",)], "text string")
    assert [tuple(r) for r in ir.digest(ir.resample(clash, goal)).collect()] == plain([(1, "a b")], ["a"])


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    plan = ir.weighed(docs, docs.select("text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
