import zlib

import pytest
from pyspark.sql import functions as F

from rankspark.llm import mixing, sharding


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, ("hot " * 20) if i % 3 == 0 else "x" * (i % 97)) for i in range(3000)] + [(3000, None), (3001, ""), (3002, "y" * 3000), (None, "z"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as shard", "3 as r")
    got = [r.asDict() for r in sharding.shard_documents(docs).collect()]
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(by) == set(range(16))
    total = sum(r["size"] for r in got)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 16) < 0.02 * total / 16 + 3001
    one = next(r for r in got if r["doc_id"] == 3002)
    assert one["size"] == 3001 and one["text_crc32"] == zlib.crc32(b"y" * 3000)
    assert next(r for r in got if r["doc_id"] == 3000)["text_crc32"] == 0
    again = sharding.shard_documents(docs.repartition(7))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again.collect()}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.shard_documents(docs).collect() == []
    assert mixing.mix(docs).collect() == []
    assert mixing.mixed_documents(docs).collect() == []


def test_targets_by_water_filling():
    got = mixing.targets({"b": 100, "a": 1, None: 1000})
    # weights: a 1, b 2, None 3; a stops at 3, b at 300 only if above
    assert got["a"] == 3
    left = 1101 - 3
    assert got["b"] == 300 and got[None] == pytest.approx(left - 300)
    assert mixing.targets({}) == {}


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 7}" if i % 11 else None, i) for i in range(4000)] + [(4000, None, "s1", 1), (4001, "one two three", "lone", 2), (4002, "", "empty", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    source = {i: s for i, _, s, _ in rows}
    sums, target, sizes = {}, {}, {}
    for r in got:
        assert r["size"] == len((dict((i, t) for i, t, _, _ in rows[-3:]).get(r["doc_id"], "w " * (r["doc_id"] % 50)) or "").split())
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"]]
        sums[s] = sums.get(s, 0) + r["taken"]
        target[s], sizes[s] = r["target"], r["source_size"]
    assert target == pytest.approx(mixing.targets(sizes))
    for s in sums:
        assert abs(sums[s] - target[s]) <= 50
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.mix(docs.repartition(9)).collect())
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in got}
    counts = {r["doc_id"]: r["n"] for r in copies.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in got:
        if r["size"]:
            assert counts.get(r["doc_id"], 0) * r["size"] == taken[r["doc_id"]]
        else:
            assert counts[r["doc_id"]] == 1
