"""Binary matrices against numpy, pairs in n log n against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.operators import statistics as A
from rankspark.sources import matrices as M


def table(spark, held):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(held)], "row long, values array<double>").repartition(5)


def test_npy_files_are_read_as_numpy_reads_them(spark, tmp_path):
    held = np.random.default_rng(1).normal(size=(250, 7))
    M.write_matrix(table(spark, held), str(tmp_path / "m"), chunk=64)
    files = sorted(tmp_path.glob("m/*"), key=lambda p: int(p.stem.split("-")[1]))
    assert [p.name for p in files] == [f"chunk-{k}.npy" for k in range(4)]
    assert np.array_equal(np.concatenate([np.load(p) for p in files]), held)
    rows = M.read_matrix(spark, str(tmp_path / "m"), bytes="300").collect()
    assert np.array_equal(np.array([r["values"] for r in sorted(rows)]), held)


def test_foreign_npy_file(spark, tmp_path):
    for kind in ("<f4", "<i8", "<f2", ">f8"):
        held = np.arange(60).reshape(12, 5).astype(kind)
        np.save(tmp_path / "one.npy", held)
        rows = M.read_matrix(spark, str(tmp_path / "one.npy")).collect()
        assert [r["values"] for r in sorted(rows)] == held.astype(float).tolist()
    np.save(tmp_path / "one.npy", np.asfortranarray(np.zeros((3, 2))))
    with pytest.raises(Exception, match="row order"):
        M.read_matrix(spark, str(tmp_path / "one.npy")).collect()


def test_interleaved_pairs(spark, tmp_path):
    a, b = np.random.default_rng(2).random((2, 30, 30)).astype(np.float16)
    rows = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(30)], "row long, first array<float>, second array<float>").repartition(3)
    M.write_matrix(rows, str(tmp_path / "p"), "pairs", 8)
    raw = np.fromfile(tmp_path / "p" / "chunk-1.f16", np.float16).reshape(8, 60)
    assert np.array_equal(raw[:, 0::2], a[8:16]) and np.array_equal(raw[:, 1::2], b[8:16])
    got = M.read_matrix(spark, str(tmp_path / "p"), "pairs", columns="30").where("row = 17").first()
    assert got["first"] == a[17].astype(float).tolist() and got["second"] == b[17].astype(float).tolist()


def test_filters_prune_ranges():
    def reader(*filters):
        r = M._PruningReader({})
        assert list(r.pushFilters(list(filters))) == list(filters)
        return r

    at = ("row",)
    assert list(reader(M.EqualTo(at, 12))._wanted(10, 10)) == [(2, 3)]
    assert list(reader(M.EqualTo(at, 12))._wanted(20, 10)) == []
    assert list(reader(M.In(at, (3, 11, 12, 15, 40)))._wanted(10, 10)) == [(1, 3), (5, 6)]
    assert list(reader(M.GreaterThan(at, 12), M.LessThanOrEqual(at, 14))._wanted(10, 10)) == [(3, 5)]
    assert list(reader(M.EqualTo(("other",), 1))._wanted(0, 4)) == [(0, 4)]


def test_one_row_reads_its_range_only(spark, tmp_path):
    """Bytes outside the wanted row are spoilt: nobody reads them."""
    held = np.arange(4000.0).reshape(400, 10)
    M.write_matrix(table(spark, held), str(tmp_path / "m"), chunk=100)
    path = str(tmp_path / "m")
    for found in (M.read_matrix(spark, path).where("row = 250"), M.read_matrix(spark, path, rows=[250])):
        assert found.rdd.getNumPartitions() == 1 and [r["values"] for r in found.collect()] == [held[250].tolist()]
    assert M.read_matrix(spark, path).where(F.col("row").isin(0, 399)).count() == 2
    reader = M._Reader({"path": path, "layout": "npy", "rows": "250"})
    only = reader.partitions()
    assert [(r.first, r.rows) for r in only] == [(250, 1)]
    for p in tmp_path.glob("m/chunk-*.npy"):
        raw = bytearray(p.read_bytes())
        keep = bytes(raw[only[0].at : only[0].at + 80])
        raw[128:] = b"\xff" * (len(raw) - 128)
        if p.name == only[0].path.rsplit("/", 1)[1]:
            raw[only[0].at : only[0].at + 80] = keep
        p.write_bytes(raw)
    assert [r["values"] for r in M.read_matrix(spark, path, rows=[250]).collect()] == [held[250].tolist()]


def test_refused_rows_nulls_and_overwriting(spark, tmp_path):
    path = str(tmp_path / "m")
    M.write_matrix(table(spark, np.zeros((20, 2))), path, chunk=4)
    M.write_matrix(spark.createDataFrame([(0, [1.0, None])], "row long, values array<double>"), path, chunk=4)
    rows = M.read_matrix(spark, path).collect()
    assert len(rows) == 1 and rows[0]["values"][0] == 1.0 and np.isnan(rows[0]["values"][1])
    for bad in ([(0, [1.0]), (2, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])]):
        with pytest.raises(Exception, match="not the next one"):
            M.write_matrix(spark.createDataFrame(bad, "row long, values array<double>"), path, chunk=4)
    assert len(list(tmp_path.glob("m/.*-*"))) == 0 and len(M.read_matrix(spark, path).collect()) == 1
    with pytest.raises(Exception, match="no .npy file"):
        (tmp_path / "none").mkdir()
        M.read_matrix(spark, str(tmp_path / "none")).collect()


def test_descents():
    draw = random.Random(4)
    for n in (0, 1, 2, 3, 50, 200):
        v = [draw.randrange(n // 3 + 1) for _ in range(n)]
        assert A.descents(np.array(v, np.int64)) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))
    assert A.descents(np.arange(100_000)[::-1]) == 100_000 * 99_999 // 2


def test_pairs_with_ties_and_nulls(spark):
    draw = random.Random(5)
    rows = [(g, i, draw.choice([None, 0.5, 1.5, 2.5, 9.0]), draw.choice([None, 1, 2, 3])) for g in ("x", "y") for i in range(40)] + [("one", 0, 1.0, 1)]
    got = {r["g"]: r for r in A.pair_statistics(spark.createDataFrame(rows, "g string, i int, a double, b int"), "g", "i", "a", "b").collect()}
    assert set(got) == {"x", "y"}
    for g, r in got.items():
        own = [x for x in rows if x[0] == g]
        c = d = ta = tb = 0
        for k, x in enumerate(own):
            for y in own[k + 1 :]:
                da = None if None in (x[2], y[2]) else np.sign(x[2] - y[2])
                db = None if None in (x[3], y[3]) else np.sign(x[3] - y[3])
                ta, tb = ta + (da == 0), tb + (db == 0)
                if da and db:
                    c, d = c + (da == db), d + (da != db)
        assert (r["inversions"], r["pairs"]) == (d, 780)
        assert r["tau"] == pytest.approx((c - d) / ((c + d + ta) * (c + d + tb)) ** 0.5)


def test_a_group_of_100_000(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("g").alias("g"), "id", F.col("id").cast("double").alias("a"), (-F.col("id")).alias("b"))
    r = A.pair_statistics(rows, "g", "id", "a", "b").first()
    assert r["inversions"] == r["pairs"] == n * (n - 1) // 2 and r["tau"] == -1.0
