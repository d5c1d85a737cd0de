"""What lies beyond the sizes that the driver or a broadcast may hold."""

import random
import zlib

from rankspark.llm import language_id, mixing, quality, sharding
from rankspark.llm.common import mix as scramble


def test_many_sources_are_mixed_as_few_are(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randint(0, 30), rnd.choice([None, "", "é", "日本", "\U0001f600", "￮", *[f"s{k}" for k in range(40)]]) if i % 3 else "hot") for i in range(1500)]
    rows += [rows[5], (None, "a b c", "s1"), (7, None, None), (8, "alone " * 40, "zz"), (9, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as h", "2 as g", "3 as s")
    few = sorted(map(str, mixing.mix(docs).collect()))
    copies = sorted(map(str, mixing.mixed_documents(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    many = sorted(map(str, mixing.mix(docs).collect()))
    assert len(few) == len(rows) and few == many
    assert copies == sorted(map(str, mixing.mixed_documents(docs).collect()))


def test_repeated_rows_are_cut_between_shards(spark):
    rows = [(5, "same text")] * 4000 + [(i, f"text {i}") for i in range(100, 4100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.text_crc32 == zlib.crc32((b"same text" if r.doc_id == 5 else f"text {r.doc_id}".encode()))
        by.setdefault(r.shard, []).append(r)
    mean = sum(r.size for r in got) / 16
    assert set(by) == set(range(16))
    assert all(abs(sum(r.size for r in own) - mean) < 0.03 * mean for own in by.values())
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())


def test_languages_of_long_or_few_texts_are_learned(spark):
    rnd = random.Random(3)
    rows = []
    for lang, letters, sizes in (("aa", "abcde", (40, 80)), ("bb", "vwxyz", (9000, 9500)), ("cc", "mnopq", (50, 60))):
        for _ in range({"aa": 60, "bb": 8, "cc": 2}[lang]):
            rows.append((len(rows), " ".join("".join(rnd.choices(letters, k=4)) for _ in range(rnd.randint(*sizes))), lang))
    rows += [(1000, "²½ ① Ⅷ 12", "aa"), (1002, None, "aa"), (1003, "xyzv wxvy zzyx vwxy yxwv zyxw vvww", None)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string")
    got = language_id.predict(docs, language_id.learnt(docs, learn=docs["doc_id"] < 1000)).collect()
    assert len(got) == len(rows) + 1
    pred = {r.doc_id: r for r in got}
    assert all(pred[i].lang_pred == lang for i, _, lang in rows[:70])
    assert pred[1003].lang_pred == "bb"
    assert pred[1000].lang_pred == pred[1002].lang_pred == "und" and not pred[1000].accepted


def naive_buckets(text, bits):
    import numpy as np

    from rankspark.llm.common import word_hashes

    words, now = [], []
    for b in (text or "").encode():
        c = b + 32 if 65 <= b <= 90 else b
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            now.append(c)
        elif now:
            words.append(bytes(now))
            now = []
    words += [bytes(now)] if now else []
    hashes = [int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]

    def bucket(x):
        return int(scramble(np.array([x % (1 << 64)], np.uint64))[0]) >> (64 - bits)

    return [bucket(h) for h in hashes] + [bucket(a * 0xD6E8FEB86659FD93 + b) for a, b in zip(hashes, hashes[1:], strict=False)]


def test_importance_weights_equal_a_naive_loop(spark):
    import math

    rnd = random.Random(6)
    good, bad = [f"g{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choices(good if i % 3 == 0 else bad, k=rnd.randint(1, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "é" * 5000 + " G1 g2"), rows[7], rows[7], (403, "g1 g2 g3 " * 3000)]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 300, 2)] + [(6, 1), (9, 0), (9, 1), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as crc")
    got = quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), share=0.5).collect()
    bits = quality.BITS
    each = [naive_buckets(t, bits) for _, t in rows]
    one = {i for i, y in labels if y == 1 and i is not None}
    target, raw = [1.0] * (1 << bits), [1.0] * (1 << bits)
    for (i, _), own in zip(rows, each, strict=True):
        for b in own:
            raw[b] += 1
            target[b] += i in one
    n_t, n_r = sum(target), sum(raw)
    weight = {}
    for (i, _), own in zip(rows, each, strict=True):
        weight[i] = sum(math.log(target[b] / n_t) - math.log(raw[b] / n_r) for b in own)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.log_weight - weight[r.doc_id]) < 1e-5 * max(1, abs(weight[r.doc_id])), r
    order = sorted(got, key=lambda r: -r.gumbel_key)
    k = len(rows) // 2
    cut = order[k - 1].gumbel_key
    assert all(r.selected for r in got if r.gumbel_key > cut) and not any(r.selected for r in got if r.gumbel_key < cut)
    picked = {r.doc_id for r in got if r.selected}
    assert sum(i % 3 == 0 for i in picked) > 0.6 * len(picked)
    same = [r for r in got if r.doc_id == 7]
    assert len({(r.log_weight, r.gumbel_key, r.selected) for r in same}) == 1
