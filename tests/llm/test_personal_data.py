import hashlib
import random
import re

from rankspark.llm import personal_data as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def card(rnd, n):
    d = "".join(rnd.choices("0123456789", k=n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def texts():
    rnd = random.Random(5)
    bits = ["a.b@c.de", "x@y", "a@b.c+d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.2.3", "+1 (017) 555-7713", "+44 20", "+123456789012345678", "é", "日本 ", "\x01", "\x02", " ", "  ", "-", ".", "@", "12", "12-34 5", "word ", "\n", "0001.02.3.255", "(", "+"]
    out = [None, "", "plain words", "\x01a@b.co\x01 1.1.1.1", "5" * 3000 + ".1.2.3", "x" * 200_000 + " a@b.co", "a." * 20_000 + "b@c.d", " ".join("10.0.0.1" for _ in range(3000)), "a@" + "b." * 20_000 + "c"]
    for _ in range(400):
        own = rnd.choices(bits, k=rnd.randint(1, 12))
        if rnd.random() < 0.5:
            d = card(rnd, rnd.randint(15, 20))
            own.insert(rnd.randrange(len(own) + 1), d if rnd.random() < 0.5 else rnd.choice("- ").join(d[i : i + 4] for i in range(0, len(d), 4)))
        out.append(rnd.choice(["", " "]).join(own))
    return out


def test_base_spans_equal_plain_patterns(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as b_email", "'s' as spans")
    got = {r.doc_id: r for r in P.digest(P.find(docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in want) for k in P.KINDS], t[:200]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i].spans.split(","))


def test_wider_spans_join_and_plain_text_stays_clean(spark):
    rows = [(i, f"please call our phone (212) 555-{1000 + i} or mail jo{i} (at) site.org today") for i in range(40)]
    rows += [(100 + i, f"mail a{i}@b.com, call +1 (212) 555-{2000 + i} now") for i in range(40)] + [(900, "no numbers here, version 1.2.3 of 2024-10-11, look at that")]
    got = {r.doc_id: r.spans for r in P.digest(P.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[900] == ""
    assert "phone:" in got[3] and "email:" in got[3]


def test_secrets_need_more_than_their_form(spark):
    rnd = random.Random(8)
    hexes = ["".join(rnd.choices("0123456789abcdef", k=40)) for _ in range(60)]
    rows = [(i, f'some words token = "{h}" and more') for i, h in enumerate(hexes[:30])]
    rows += [(100 + i, f"see commit {h} of the repository") for i, h in enumerate(hexes[30:])]
    rows += [(200 + i, f"https://example.org/a{i}b/some/long/path/to/page{i} is read") for i in range(30)]
    rows += [(300, "AKIA" + "Q7Z3" * 5), (301, "key: " + "schberchbeheitschaueinbeenst"), (302, "a" * 300_000 + "1"), (303, "7" * 40)]
    got = {r.doc_id: r for r in P.digest(P.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(got[i].spans == "secret:20:60" and got[i].n_spans == 1 for i in range(30))
    assert all(got[i].spans == "" for i in got if 100 <= i < 300 or i in (301, 302, 303))
    assert got[300].spans == "secret:0:24"


def wider_truth():
    """Texts with one planted span each, obfuscated or national, and look-alikes without one."""
    rnd = random.Random(13)
    plants, clean = [], []
    for i in range(60):
        plants.append(("email", f"jo{i} (at) site{i % 7}.org", "please mail {} today"))
        plants.append(("email", f"ann{i}[at]corp.com", "contact {} for it"))
        plants.append(("phone", f"({rnd.randint(201, 289)}) 555-{1000 + i}", "call {} now"))
        plants.append(("phone", f"{rnd.randint(201, 289)}-555-{1000 + i}", "they gave {} then"))
        plants.append(("ip", ":".join(f"{rnd.randrange(4096, 65536):x}" for _ in range(8)), "the host {} fell"))
        d = "3" + rnd.choice("47") + "".join(rnd.choices("0123456789", k=12))
        plants.append(("card", next(d + c for c in "0123456789" if luhn(d + c)), "card {} was paid"))
        clean += [f"order x{rnd.randint(201, 289)}-555-{1000 + i}y came", f"ref={rnd.randint(201, 289)}-555-{1000 + i} is old", f"number {''.join(rnd.choices('0123456789', k=11))}00 of it", f"look at page {i} dot it"]
    return plants, clean


def test_wider_spans_of_each_kind_are_found_where_planted(spark):
    plants, clean = wider_truth()
    rows = [(i, text.format(m)) for i, (_, m, text) in enumerate(plants)] + [(10_000 + i, t) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[0][1])], "doc_id long, text string")  # a repeated row, a null id
    found = P.digest(P.find(docs)).collect()
    got = {r.doc_id: r.spans for r in found}
    right = {k: [] for k in P.KINDS}
    for i, (kind, m, text) in enumerate(plants):
        at = text.index("{")
        right[kind].append(got[i] == f"{kind}:{at}:{at + len(m)}")
    assert all(sum(x) >= 0.9 * len(x) for x in right.values()), {k: sum(x) / len(x) for k, x in right.items()}
    assert sum(got[10_000 + i] != "" for i in range(len(clean))) <= 0.05 * len(clean)
    assert len(found) == len(rows) + 2 and got[None] == got[0] and [r.spans for r in found if r.doc_id == 0] == [got[0]] * 2


def test_empty(spark):
    assert P.digest(P.find(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_em_tells_good_labelers():
    post = P.estimate([("email", (1, 1, 1, -1), 50), ("email", (0, -1, -1, 0), 50)])
    assert post["email", (1, 1, 1, -1)] > 0.9 > 0.1 > post["email", (0, -1, -1, 0)]


def test_pieces_of_longer_tokens_are_refused_on_large_tables(spark):
    for n in (100, 10_000):
        rows = [(i, f"please call our phone (212) 555-{1000 + i % 9000} today" if i % 2 else f"mail a{i}@b.com or call +1 (212) 555-{1000 + i % 9000} now") for i in range(n)]
        rows += [(20_000 + i, f"the token x212-555-{1000 + i}y and ref=312-555-{1000 + i} are no numbers") for i in range(12)]
        rows += [(30_000 + i, f"key/2001:0db8:0000:0000:0000:ff00:0042:{8000 + i} and zé.jo{i} (at) site.org#7") for i in range(12)]
        rows += [(40_000 + i, f"our host is 2001:0db8:0000:0000:0000:ff00:0042:{8000 + i} or write to jo{i} (at) site.org") for i in range(12)]
        got = {r.doc_id: r.spans for r in P.digest(P.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
        assert all(got[i] == "" for i in got if 20_000 <= i < 40_000), n
        assert all("phone:" in got[i] for i in range(n)) and all("ip:" in got[i] and "email:" in got[i] for i in got if i >= 40_000), n


def test_a_vote_says_the_same_at_any_number_of_candidates():
    for n in (100, 10_000, 1_000_000):
        post = P.estimate([("phone", (1, -1, 0, 1), n), ("phone", (1, -1, 0, 0), n // 10), ("phone", (1, -1, 1, 1), n)])
        assert post["phone", (1, -1, 0, 0)] < 0.3 < 0.7 < post["phone", (1, -1, 0, 1)]
