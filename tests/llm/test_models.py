"""Language ID, toxicity, quality resampling and token output on small and odd tables."""

import random
import zlib

import numpy as np
import pytest

from rankspark.llm import budgets, language_id, quality, subwords, token_output, toxicity
from rankspark.llm.subwords import normalised, train

EN = "the of and to in is that for it as was with be by on not he his but at are this have from or".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split()


def sentences(rnd, words, n):
    return " ".join(rnd.choice(words) + rnd.choice(["", "en", "er", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def bilingual(spark):
    rnd = random.Random(2)
    rows = [(i, sentences(rnd, EN if i % 2 else DE, rnd.randint(8, 60)), "en" if i % 2 else "de") for i in range(300)]
    rows += [(300, None, "en"), (301, "", "en"), (302, "123 !!", None), (303, sentences(rnd, EN, 30_000), None), (None, "the and of", "en"), (1, rows[1][1], "en")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0 as score", "'x' as lang_pred")


def test_language(spark, bilingual):
    rows, docs = bilingual
    fitted = language_id.learnt(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, fitted).collect()}
    held = [i for i, t, lang in rows if lang and t and i is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and sum(got[i].lang_pred == ("en" if i % 2 else "de") for i in held) >= 0.98 * len(held)
    for i in (300, 301, 302):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[303].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_accepted(docs, fitted)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({300, 301, 302})
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs.repartition(5), language_id.learnt(docs.repartition(3))).collect()}
    assert all(again[i][0] == r.lang_pred and again[i][1] == pytest.approx(r.score) for i, r in got.items())


def test_language_without_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.learnt(docs) is None
    assert [r.lang_pred for r in language_id.predict(docs, None).collect()] == ["und"]
    assert language_id.predict(docs.limit(0), None).collect() == []


def test_language_rejects_what_it_has_not_learned(spark):
    rnd = random.Random(3)
    words = {"en": EN, "de": DE, "fr": "le la les des une dans pour que qui sur avec plus pas sont cette comme mais nous leur être".split(), "es": "el los las una del por para con que como más pero sus este cuando muy sin sobre también hasta".split()}
    odd = {200_000 + n: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(n)) for n in range(8, 60)}
    odd |= {300_000 + n: " ".join(rnd.choices("wszyscy ludzie rodzą się wolni równi pod względem swej godności swych praw obdarzeni rozumem sumieniem powinni postępować".split(), k=n)) for n in range(8, 60)}
    odd[400_000] = "for (int i = 0; i < n; ++i) { buf[i] = queue.front(); queue.pop_front(); } return static_cast<size_t>(n);"
    for k in (1, 2, 4):
        known = list(words)[:k]
        rows = [(i, sentences(rnd, words[known[i % k]], rnd.randint(8, 60)), known[i % k]) for i in range(200 * k)]
        rows += [(5000 + i, "qxj zvkq wjx pqz " * 5, known[0]) for i in range(2)]  # foreign text under a known label
        short = [(100_000 + i, sentences(rnd, words[known[i % k]], 1 + i % 6), None) for i in range(100)]
        docs = spark.createDataFrame(rows + short + [(i, t, None) for i, t in odd.items()], "doc_id long, text string, lang string")
        fitted = language_id.learnt(docs)
        got = {r.doc_id: r.accepted for r in language_id.predict(docs, fitted).collect()}
        assert not [odd[i] for i in odd if got[i]], k
        assert not [t for i, t, _ in rows + short if not got[i] and i // 1000 != 5], k
        assert {r.doc_id for r in language_id.keep_accepted(docs, fitted).collect()} == {i for i in got if got[i]}


def test_toxicity_finds_misspellings_in_long_texts(spark):
    rnd = random.Random(4)
    bad = ["stinkhead", "blockwit", "nastyface"]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(EN) + rnd.choice(["a", "e", "on"]) for _ in range(rnd.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(words) // 40)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(toxic)))
    rows += [(1000, "thea ofon nastyfaces blokwit stinkheads thea", 1), (1001, "thea ofon ofa thea ofe " * 4000 + "stinkhead blockwit nastyface", 1), (1002, None, 1), (1003, "", 1), (1004, "thea ofon ina", 1)]
    labels += [(5, 0), (8, 0), (None, 1), (2000, 1), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    judge = toxicity.learnt(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, judge).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[1000] >= 0.5 and got[1001] >= 0.5 and got[1004] < 0.5
    assert got[1002] == got[1003] and 0 <= got[1002] <= 1
    assert toxicity.learnt(docs, marks.limit(0)).model is None
    assert {r.score for r in toxicity.score(docs, toxicity.Judge(None)).collect()} == {0.0}


def test_toxicity_learns_the_end_of_long_texts(spark):
    """The insult stands only behind 100,000 characters of the toxic training texts; a stretch or a prefix would miss it."""
    rnd = random.Random(9)
    words = [w + e for w in EN for e in ("a", "e", "on")]
    rows = [(i, " ".join(rnd.choices(words, k=60))) for i in range(400)]
    long_ids = [i for i in range(1000, 1060) if zlib.crc32(str(i).encode()) % 5]
    rows += [(i, " ".join(rnd.choices(words, k=20_000)) + " zorgblatt vexmurk") for i in long_ids]
    rows += [(i, " ".join(rnd.choices(words, k=20_000))) for i in range(2000, 2060)]
    rows += [(3000, " ".join(rnd.choices(words, k=12)) + " zorgblatt vexmurk zorgblatts"), (3001, " ".join(rnd.choices(words, k=15)))]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "'k' as key", "1L as n", "'t' as t", "0 as y", "0.5 as draw").repartition(6)
    marks = spark.createDataFrame([(i, int(i in set(long_ids))) for i, _ in rows if i < 3000], "doc_id long, toxic int").selectExpr("*", "'k' as key", "1L as n")
    judge = toxicity.learnt(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, judge).collect()}
    assert got[3000] >= 0.5 > got[3001]
    assert sum(got[i] >= 0.5 for i in range(400)) <= 8 and sum(got[i] >= 0.5 for i in long_ids) >= 0.9 * len(long_ids)
    again = toxicity.learnt(docs.repartition(2), marks.repartition(3))
    assert (again.model.table == judge.model.table).all() and again.slopes == pytest.approx(judge.slopes)


def test_bags_and_scores_equal_naive_loops(spark):
    """Bags counted by tasks, and a folded model's logits, against loops over n-grams."""
    texts = ["Nasty nasty  face", "a", "", "über-Straße 12 straße", "long words inside " * 900]
    frame = spark.createDataFrame(list(enumerate(texts)), "n long, t string").repartition(3)
    got = toxicity.collected_bags(frame, np.array([True, True, False, True, True]))
    raw, begins = normalised(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
    model = subwords.Subwords(toxicity.ORDERS, toxicity.BITS, np.random.default_rng(3).normal(size=(3, 1 << toxicity.BITS, 2)).astype(np.float32), np.array([0.25, -0.5]), [0, 1], True, 1)
    logits = model.logits(raw, begins)
    assert sorted(got) == [0, 1, 3, 4]
    for t in range(len(texts)):
        one, want, scores = raw[begins[t] : begins[t + 1]], {}, []
        for k, n in enumerate(toxicity.ORDERS):
            for at in range(len(one) - n + 1):
                gram = one[at : at + n]
                if 0x20 not in gram[1:-1].tolist():
                    b = int(subwords.buckets(gram.copy(), n, toxicity.BITS)[0])
                    want[b + (k << toxicity.BITS)] = want.get(b + (k << toxicity.BITS), 0) + 1
                    scores.append(model.table[k, b].astype(float))
        if t in got:
            assert dict(zip(got[t][0].tolist(), got[t][1].tolist(), strict=True)) == want and list(got[t][0]) == sorted(want)
        assert logits[t] == pytest.approx((np.sum(scores, axis=0) / len(scores) if scores else 0) + model.bias)


def test_training_is_deterministic():
    raw, offsets = normalised(np.frombuffer(b"abc abc xyz xyz", np.uint8), np.array([0, 7, 15]))
    a, b = (train(raw, offsets, np.array([0, 1]), ["a", "b"], (2, 3), 10, epochs=2) for _ in range(2))
    assert (a.table == b.table).all() and a.logits(raw, offsets).argmax(1).tolist() == [0, 1]


def test_thresholds_meet_budgets(spark):
    rnd = random.Random(8)
    rows = [(g, rnd.randint(1, 9), rnd.randrange(budgets.SPAN)) for g in range(3) for _ in range(500)]
    frame = spark.createDataFrame(rows, "g int, w long, h long")
    sums = {g: sum(w for q, w, _ in rows if q == g) for g in range(3)}
    goal = {0: 0.3 * sums[0], 1: 0.0, 2: float(sums[2])}
    got = budgets.thresholds(frame, goal)
    for g in range(3):
        assert abs(sum(w for q, w, h in rows if q == g and h < got[g]) - goal[g]) <= 5


def test_quality_prefers_the_target(spark):
    rnd = random.Random(6)
    rows = [(i, sentences(rnd, EN if i % 2 else DE, 30)) for i in range(400)] + [(400, None), (401, ""), (402, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as selected", "2 as h")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.resample(docs, labels, share=0.4).collect()}
    assert len(got) == len(rows) and abs(sum(r.selected for r in got.values()) - int(0.4 * len(rows))) <= 1
    picked = [i for i in range(400) if got[i].selected]
    assert sum(i % 2 for i in picked) > 0.9 * len(picked)
    assert got[400].log_weight == got[401].log_weight == 0.0
    counts = quality.counts(docs, labels)
    want = sum(len(t.split()) * 2 - 1 for i, t in rows if t)
    assert counts[1].sum() == want
    assert quality.resample(docs.limit(0), labels).collect() == []
    assert {r.log_weight for r in quality.resample(docs, labels.limit(0)).collect()} == {0.0}


def test_token_planes_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rnd.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        for bits in (False, True):
            names, counts, back = token_output.unpack(token_output.pack([5, None], [n, 0], ids, bits, block=64))
            assert names == [5, None] and counts.tolist() == [n, 0] and (back == ids).all()
    with pytest.raises(ValueError):
        token_output.unpack(b"\0" * 64)


def test_tokens_equal_plain_encoding(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [None, "", "  a  b\n c", "x  <|endoftext|>  y", "it's 's don't", " 　 é", "word " * 60_000, "tab\t x  \n  y ", "日本 語12 3a"]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "null id"), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as part", "'q' as ids").repartition(6)
    for bits in (False, True):
        got = token_output.read_tokens(token_output.write_tokens(docs, path, bits=bits)).orderBy("start").collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        at = 0
        for r, (i, t) in zip(got, order, strict=True):
            ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
            raw = np.array(ids, "<u4").tobytes()
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, at, len(ids), zlib.crc32(raw), raw)
            at += len(ids)
    assert token_output.read_tokens(token_output.write_tokens(docs.limit(0), path)).collect() == []


def test_pieces_cut_finely_equal_plain_encoding():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain, coder, draw = Tokenizer.from_file(path), token_output.PieceEncoder(path), random.Random(4)
    parts = ["a", "The", "é", "²", "½", "é", "7", "_", "'", "'s", "'ll", ".", "***", "&&&", "$", "(", '"', "-", "~", "\n", "\n\n", "\r\n", "\t", " ", " ", "  ", "　", "\xa0", "語", "\U0001f600", "word"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 30))) for _ in range(4000)]
    texts += ["end.\nNext", " it***\nline,!!", "don't.\n's", "a<|endoftext|> b", "x" * 300 + ".\n" + "y" * 300 + " z", " \n", ""]
    for _ in range(2):  # once with an empty cache, once with a full one
        for at in range(0, len(texts), 500):
            for text, ids in zip(texts[at : at + 500], coder.encode(texts[at : at + 500]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
