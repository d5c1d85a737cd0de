"""Tournaments and work lists in rounds, against plain loops."""

import hashlib

from pyspark.sql import functions as F

from rankspark.operators import rounds as W
from rankspark.streaming import resume


def test_tournament_equals_a_plain_loop(spark, tmp_path):
    people = {t: [f"p{i}" for i in range(n)] for t, n in ((1, 7), (2, 2), (3, 1))}
    silent = {(1, "p0", "p1"), (1, "p2", "p3"), (2, "p0", "p1")}  # no verdict at first; (2, p0, p1) never
    asked = []

    def judge(pairs, attempt):
        rows = [(r.target, r.a, r.b) for r in pairs.collect()]
        asked.append((attempt, sorted(rows)))
        out = [(t, a, b, "?" if (t, a, b) in silent and (attempt == 1 or t == 2) else "\\boxed{ %d }" % (1 if (int(a[1]) * 7) % 5 >= (int(b[1]) * 7) % 5 else 2)) for t, a, b in rows]
        return spark.createDataFrame(out, "target int, a string, b string, answer string")

    players = spark.createDataFrame([(t, p) for t, ps in people.items() for p in ps], "target int, player string")
    got = sorted(tuple(r) for r in W.swiss_tournament(players, judge, 4, "s", str(tmp_path)).collect())

    want, won, met = [], {}, set()
    for n in range(1, 5):
        new = []
        for t, ps in people.items():
            queue = sorted(ps, key=lambda p, t=t: (won.get((t, p), 0), hashlib.md5(f"s|{n}|{t}|{p}".encode()).hexdigest()))
            while queue:
                p = queue.pop(0)
                q = next((q for q in queue if (t, *sorted((p, q))) not in met), None)
                if q is not None:
                    queue.remove(q)
                    new.append((t, *sorted((p, q))))
        for t, a, b in new:
            if t == 2:
                continue
            met.add((t, a, b))
            best = a if (int(a[1]) * 7) % 5 >= (int(b[1]) * 7) % 5 else b
            won[t, best] = won.get((t, best), 0) + 1
            want.append((t, a, b, best, n))
    assert got == sorted(want) and len({m[:3] for m in got}) == len(got)
    assert all(set(rows) <= silent for attempt, rows in asked if attempt == 2)
    calls = len(asked)
    assert sorted(tuple(r) for r in W.swiss_tournament(players, judge, 4, "s", str(tmp_path)).collect()) == got
    assert len(asked) == calls  # whole rounds are read again, not judged


def test_work_is_tried_until_none_is_left(spark, tmp_path):
    items = spark.range(20).withColumnRenamed("id", "k")
    done, left = W.tried(items, "k", lambda rows, n: rows.where(F.col("k") % 4 < n), 9, str(tmp_path / "a"))
    assert {r.k: r.attempt for r in done.collect()} == {k: k % 4 + 1 for k in range(20)} and left.count() == 0
    assert not (tmp_path / "a" / "attempt=5").exists()
    done, left = W.tried(items, "k", lambda rows, n: rows.where("k < 3"), 2, str(tmp_path / "b"))
    assert done.count() == 3 and left.count() == 17
    done, left = W.tried(items.where("k < 0"), "k", lambda rows, n: rows, 2, str(tmp_path / "c"))
    assert done.count() == 0 and left.count() == 0


def test_windows_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for day, values in ((1, [1.0, 2.0]), (2, [4.0])):
        spark.createDataFrame([(v,) for v in values], "v double").select(F.expr(f"timestamp_ntz'2024-01-0{day} 10:30:00'").alias("at"), F.lit("x").alias("k"), "v").write.mode("append").parquet(source)
    events = spark.readStream.schema("at timestamp_ntz, k string, v double").option("maxFilesPerTrigger", 1).parquet(source)
    resume.latest(resume.windowed_counts(events, "at", ["k"], "v"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert dict(found.dtypes)["start"] == "timestamp_ntz"
    assert sorted((str(r.start), r.n, r.total) for r in found.collect()) == [("2024-01-01 10:00:00", 2, 3.0), ("2024-01-02 10:00:00", 1, 4.0)]
