"""Scanners, formula trees, structural search and listwise scores against plain versions."""

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rankspark import scorers
from rankspark.functions import scan
from rankspark.operators import structure as S
from rankspark.plans import formulas

FORMS = r"\$\$(.+?)\$\$|\$(.+?)\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\\begin\{equation\*?\}(.+?)\\end\{equation\*?\}|\\begin\{align\*?\}(.+?)\\end\{align\*?\}"


def plain_pieces(text, delimiters):
    out, at = [], 0
    for m in re.finditer(FORMS, text, re.DOTALL):
        out += [("term", text[at : m.start()]), ("tex", m[0] if delimiters else next(g for g in m.groups() if g is not None))]
        at = m.end()
    out.append(("term", text[at:]))
    return [(k, v.strip()) for k, v in out if v.strip()]


def test_pieces_against_patterns():
    draw = random.Random(3)
    some = [*scan.FORMS, *{e for ends in scan.FORMS.values() for e in ends}, "a", " b ", "\n", "{x}", "\\", "é"]
    for _ in range(3000):
        text = "".join(draw.choices(some, k=draw.randrange(0, 14)))
        for delimiters in (False, True):
            assert scan.tex_pieces(text, delimiters) == plain_pieces(text, delimiters), text
    assert scan.tex_pieces(None) == [] and scan.tex_pieces("a\0$x\0$") == [("term", "a"), ("tex", "x")]


def test_long_texts_of_open_marks_take_linear_time():
    text = r"\[ \( $$$ \begin{align} " * 40_000
    assert scan.tex_pieces(text)[0][0] in ("term", "tex")
    assert scan.formula_tree("{" * 200_000 + "x" + "}" * 100_000) == ("VAR", "x")
    assert len(scan.leaf_paths(scan.formula_tree("+".join(["x"] * 50_000)), 4)) == 50_000


def test_trees():
    var = {n: ("VAR", n) for n in "abcnxy"}
    one, two = ("NUM", "1"), ("NUM", "2")
    cases = {
        r"a+b+c": ("add", [var["a"], var["b"], var["c"]]),
        r"\frac{a}{b+2}": ("frac", [var["a"], ("add", [var["b"], two])]),
        r"\frac12": ("frac", [("NUM", "12")]),
        r"x^{2}y=a": ("eq", [("times", [("power", [var["x"], two]), var["y"]]), var["a"]]),
        r"a-b": ("add", [var["a"], ("negative", [var["b"]])]),
        r"2(a+b)": ("times", [two, ("add", [var["a"], var["b"]])]),
        r"\sqrt{x_n+1}": ("root", [("add", [("index", [var["x"], var["n"]]), one])]),
        r"\sin^2 x": ("times", [("power", [("VAR", r"\sin"), two]), var["x"]]),
        r"\left\{a, b\right\}": ("list", [var["a"], var["b"]]),
        r"a+": var["a"],
        r"+ )": None,
        r"\frac{a}": ("frac", [var["a"]]),
        r"((a)": var["a"],
        "": None,
    }
    cases[r"\sin^2 x"] = ("times", [("power", [("VAR", "sin"), two]), var["x"]])
    for tex, tree in cases.items():
        assert scan.formula_tree(tex) == tree, tex


def test_paths_name_ordered_operands_only():
    paths = sorted(scan.leaf_paths(scan.formula_tree(r"\frac{a}{b+2}=c"), 2))
    assert paths == [("NUM", "2", ["add", "frac.1"]), ("VAR", "a", ["frac.0", "eq"]), ("VAR", "b", ["add", "frac.1"]), ("VAR", "c", ["eq"])]


def test_answers():
    cases = {
        None: None,
        "": None,
        '{"[1]": 3, "[2]": "4.5", "x": 1, "[3]": null, "[0]": 2, "[99999999999]": 1}': [(1, 3.0), (2, 4.5)],
        'a {"[1]": 3 <answer>{"[7]]": 2}</answer> {"[5]": 1}': [(7, 2.0)],
        '```json\n{"[1]": 1}\n``` or ```json {"[2]":\n 2 ``` {"[3]": 3}': [(2, 2.0)],
        '{"[1]": 3, "[2]"': None,
        '{"a": {"[1]": 5}': [],
        "```json [1, 2] ```": None,
        '{"[1]": 1} x {"[2]": 2} y {"[3]"': [(2, 2.0)],
    }
    for text, want in cases.items():
        assert scan.answer_scores(text) == want, text


def test_listwise_failures_enter_the_mean(spark):
    groups = spark.createDataFrame([(1, p, e, 0, p + 1) for p in range(3) for e in range(2)], "query int, pos int, epoch int, group int, place int")
    answers = spark.createDataFrame([(1, 0, 0, json.dumps({"[1]": 8, "[2]": 6})), (1, 1, 0, "no idea")], "query int, epoch int, group int, answer string")
    scores = {r["pos"]: r["score"] for r in scorers.listwise_scores(groups, answers).collect()}
    assert scores == {0: 0.4, 1: 0.3, 2: 0.0}
    one = answers.where("epoch = 0")  # an answer that never came is a failed group as well
    assert {r["pos"]: r["score"] for r in scorers.listwise_scores(groups, one).collect()} == scores


def dice(a, b):
    both = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / both if both else 0.0


def test_search_against_all_pairs(spark, tmp_path):
    draw = random.Random(1)
    parts = [r"\frac{%s}{%s+1}", "%s^{%s}", r"\sqrt{%s+%s}", "%s_{%s}<3", "%s(%s-2)"]
    rows = [(k, "say " + " and ".join(f"${draw.choice(parts) % (draw.choice('abcxyz'), draw.choice('mnpq'))}$" for _ in range(draw.randrange(0, 4)))) for k in range(60)]
    rows += [(100, r"given \(\frac{u}{v+1}\) and \[w^{t}\]"), (101, r"$$\frac{a}{b+7}$$ twice $c^{d}$"), (102, None), (103, "no formula"), (103, "no formula")]
    texts = spark.createDataFrame(rows, "id long, text string")
    S.write_index(texts, str(tmp_path / "index"))
    counts = {k: Counter(x for x in scan.structure_terms(t) if x[0] == "s") for k, t in rows}
    classes = {}
    for k in sorted(counts):
        if counts[k]:
            classes.setdefault(frozenset(counts[k].items()), k)
    assert {r["id"]: r["class"] for r in S.members(spark, str(tmp_path / "index")).collect()} == {k: classes[frozenset(c.items())] for k, c in counts.items() if c}
    want = set()
    for q, c in counts.items():
        if c:
            best = sorted(((-dice(c, counts[k]), k) for k in classes.values() if dice(c, counts[k]) > 0))[:5]
            want |= {(q, k, round(-s, 9), i + 1) for i, (s, k) in enumerate(best)}
    found = S.search(texts, str(tmp_path / "index"), 5).collect()
    assert {(r["query"], r["class"], round(r["score"], 9), r["rank"]) for r in found} == want
    assert any(r["query"] == 101 and r["class"] == classes[frozenset(counts[100].items())] and r["score"] == 1.0 for r in found)


def test_scorer_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["id"]: r["text"] for r in formulas.formula_texts(spark, folder).collect()}
    terms = {k: Counter(scan.structure_terms(t)) for k, t in texts.items()}

    def weight(c):
        return sum(n * S.WEIGHTS[t[0]] for t, n in c.items())

    for r in formulas.math_structure_rerank(spark, folder).collect():
        a, b = terms[r["query"]], terms[r["pos"]]
        assert abs(r["score"] - 2 * weight(a & b) / (weight(a) + weight(b))) < 1e-5
    pairs = spark.createDataFrame([(1, 0, "$a+b$", "$x+y$"), (1, 1, "$a+b$", None), (1, 2, "$a+b$", ""), (2, 0, None, "w")], "query int, pos int, query_text string, doc_text string")
    got = {(r["query"], r["pos"]): r["score"] for r in scorers.make_scorer("math-structure")(pairs).collect()}
    assert got[1, 0] > 0.6 and got[1, 1] == got[1, 2] == got[2, 0] == 0.0


def test_search_query_finds_itself(spark):
    found = formulas.math_structure_search(spark, "/root/testdata/sf0.001").where(F.col("rank") == 1).collect()
    assert found and all(r["score"] == 1.0 for r in found)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    S.write_index(none, str(tmp_path / "none"))
    assert S.search(none, str(tmp_path / "none")).collect() == []
