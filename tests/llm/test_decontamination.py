import hashlib
import random
import re

from rankspark.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, length=10):
    sets = []
    for i, t in items:
        w = words(t)
        n = min(length, len(w))
        sets.append((i, n, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for i, n, s in sets:
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in s:
                    hit |= set(range(k, k + n))
                    got.add(i)
        named = sorted(str(i) for i in got if i is not None)
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def cases():
    rnd = random.Random(3)
    vocab = ["Éa", "bc", "d9", "été", "x", "YY", "zz", "日本"]
    items = [(i, " ".join(rnd.choices(vocab, k=k))) for i, k in enumerate([30, 12, 10, 25, 3])] + [(100, "Only This"), (101, ""), (102, None), (9, "Only... this!"), (None, "lost words"), (None, "only this"), (200, "x " * 30)]
    docs = []
    for d in range(60):
        parts = rnd.choices(vocab, k=rnd.randint(0, 40))
        if d % 3 == 0:
            parts += (items[d % 5][1] or "").split()
        docs.append((d, rnd.choice([" ", "-", ", ", "\n"]).join(parts)))
    return docs + [(900, None), (901, ""), (902, "only this"), (903, "this only"), (904, "w" * 700_000 + " only-THIS " + "x " * 50_000), (905, "--- !!"), (905, "only this")], items


def test_scan_equals_brute_force(spark):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "'z' as n_words")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for most in (1 << 20, 40, 400):
        got = sorted(tuple(r) for r in D.digest(D.scan_documents(frame, bench, most=most)).collect())
        assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.digest(D.scan_documents(docs, none)).collect()] == [(1, 3, 0, 0)]
    assert D.scan_documents(docs.limit(0), none).count() == 0
    assert D.decontaminate(docs, none).collect() == docs.collect()


def test_spans_go_and_clean_text_stays(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rest = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{rest}. {item}! {rest}", 7, "r"), (2, rest, 7, "r"), (3, item.upper(), 7, "r"), (4, None, 7, "r")], "doc_id long, text string, n_chars int, row string")
    bench = spark.createDataFrame([(5, item), (None, "w7 w8 w9 w10 w11 w12 w13 w14 w15 x")], "item_id long, text string")
    for most in (1 << 20, 10):
        clean = D.decontaminate(docs, bench, most=most)
        assert clean.columns == docs.columns
        got = {r.doc_id: r for r in clean.collect()}
        assert set(got) == {1, 2, 4}
        assert got[1].text == f"{rest}. ! {rest}" and got[1].n_chars == len(got[1].text)
        assert got[2].text == rest and got[2].n_chars == 7
    gone = D.decontaminate(docs, spark.createDataFrame([(None, rest)], "item_id long, text string"))
    assert {r.doc_id for r in gone.collect()} == {3, 4}  # an item without an id cuts as well


def test_one_bounded_broadcast_at_a_time(spark, monkeypatch):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choices([f"v{k}" for k in range(300)], k=400))) for i in range(120)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(i, t) for i, t in items[::7]], "doc_id long, text string")
    most, sizes, alive = 20_000, [], []
    real = spark.sparkContext.broadcast

    def broadcast(value):
        held = real(value)
        sizes.append((len(value.raw), value.nbytes))
        alive.append(held)
        assert len(alive) == 1
        destroy = held.destroy
        held.destroy = lambda: (alive.remove(held), destroy())
        return held

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    got = D.scan_documents(docs, bench, most=most).collect()
    assert len(sizes) > 5 and not alive
    assert all(text <= most and held <= 60 * text + (1 << 21) for text, held in sizes)
    assert all(r.n_hit == r.n_words == 400 and r.doc_id in r["items"] for r in got)
