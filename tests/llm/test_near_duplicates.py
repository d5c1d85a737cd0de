import random
import re

import pytest

from rankspark.llm import near_duplicates as N


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def rows():
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    base = rnd.choices(vocab, k=120)
    out = [(0, None), (1, ""), (2, "  \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "Étè x y z"), (7, "étè x y z")]
    for i in range(150):  # one large family, linked and not
        own = list(base)
        for _ in range(rnd.randint(0, 12)):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(10**6)}"
        out.append((100 + i, " ".join(own)))
    for i in range(60):
        out.append((400 + i, " ".join(rnd.choices(vocab, k=rnd.randint(3, 60)))))
    for i in range(40):
        out.append((500 + i, out[rnd.randrange(158, 218)][1].upper() + "\t"))
    return out + [(600, "long " * 30_000), (601, "long " * 20_000)]


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as keys").repartition(5)
    got = {r.doc_id: r for r in N.link_documents(docs, shingle=k).collect()}
    want = brute(data, k)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    kept = N.keep_one(docs, shingle=k)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_empty_and_odd_rows(spark):
    assert N.link_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "x y z x y z")], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in N.link_documents(docs, shingle=2).collect())))
    assert got == sorted(["(None, 5, False)", "(5, 5, True)", "(5, 5, True)", "(None, None, True)"])


def test_bounds_rise():
    bounds = N.posterior_bounds(0.8)
    assert len(bounds) == N.HASHES // N.BATCH and bounds == sorted(bounds) and bounds[-1] < 0.8 * N.HASHES


@pytest.mark.parametrize(("block", "shingles"), [(4, 1 << 20), (512, 200), (2, 50)])
def test_small_parts_give_the_same(spark, monkeypatch, block, shingles):
    """The same path as on large tables: buckets in many parts, keys and leaders in many salts."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", shingles)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.link_documents(docs, shingle=2).collect()}
    assert got == brute(data, 2)


def test_groups_that_only_meet_in_parts(spark, monkeypatch):
    """Chains of texts, each linked with the next alone, share bands with many others: leaders do not join them."""
    monkeypatch.setattr(N, "BLOCK", 3)
    rnd = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    data = []
    for chain in range(12):
        own = [f"k{chain}x{i}" for i in range(40)]
        for step in range(6):
            own = own[4:] + [f"k{chain}s{step}x{i}" for i in range(4)]
            data.append((len(data), " ".join(common + own)))
    rnd.shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.link_documents(docs, shingle=2).collect()}
    assert got == brute(data, 2)


def test_rows_without_an_id_keep_one_of_a_class(spark):
    texts = ["a b c d e f", "a b c d e f", "x y z u v w", "x y z u v w", "x y z  u v w", "", "", "g h i j k l"]
    rows_ = [(5, texts[0], "p"), *[(None, t, "q") for t in texts[1:]], (7, "", "r"), (7, "", "r")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, rep string")
    got = sorted(((r.doc_id, " ".join(r.text.split())) for r in N.keep_one(docs, shingle=2).collect()), key=str)
    assert got == sorted([(5, texts[0]), (None, texts[2]), (None, ""), (None, ""), (None, texts[7]), (7, ""), (7, "")], key=str)
