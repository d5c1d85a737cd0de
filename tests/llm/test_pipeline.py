"""The pipeline's stages on a small corpus with planted cases, and on an empty one."""

import random

import pytest

import corpus_pipeline
from rankspark.llm import mixing

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
EN, DE = ("the of and to in is that for it".split(), "der die und in den von zu das mit".split())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    rows = []
    for i in range(240):
        words = [rnd.choice(EN if i % 2 else DE) + str(rnd.choice(["a", "er", "on", "ing"])) + rnd.choice("bcdfg") for _ in range(rnd.randint(30, 80))]
        rows.append([i, " ".join(words), "en" if i % 2 else "de", f"s{i % 4}"])
    for i in range(240, 250):  # near copies of document 1
        words = rows[1][1].split()
        words[rnd.randrange(2)] = "changed"
        rows.append([i, " ".join(words), "en", "s0"])
    for i in range(250, 260):  # exact copies of document 2
        rows.append([i, rows[2][1], "de", "s1"])
    rows[7][1] += f" {ITEM.upper()} and more of the text"
    rows[9][1] = ITEM
    rows += [[300, None, "en", "s0"], [301, "... 123", None, None], [302, "", "en", None]]
    docs = [(*r, len(r[1] or "")) for r in rows]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], folder)
        if name != "shard":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.mode("overwrite").parquet(f"{folder}/out-{name}")
        seen.append(spark.read.parquet(f"{folder}/out-{name}"))
    _, language, deduped, clean, mixed, shards = seen
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert set(range(260)) == ids[1]
    assert ids[2] == set(range(240))
    texts = {r.doc_id: r for r in clean.collect()}
    assert ids[3] == ids[2] - {9}
    assert "alpha" not in texts[7].text.lower() and texts[7].text.endswith("and more of the text") and texts[7].n_chars == len(texts[7].text)
    before = {r.doc_id: r.text for r in deduped.collect()}
    assert all(texts[i].text == before[i] for i in ids[3] if i != 7)
    sizes, taken = {}, {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in mixed.collect():
        assert r.text == texts[r.doc_id].text
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    goal = mixing.targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= 80 for s in goal)
    rows = shards.collect()
    assert len(rows) == mixed.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in own) == list(range(len(own))) for own in by.values())
    total = sum(r.size for r in rows)
    assert all(abs(sum(x.size for x in own) - total / 16) < 900 for own in by.values())


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
