"""Fill-in-middle against a plain version, and the way back."""

import hashlib
import re

from rankspark.llm import fill_in_middle as fim


def plain(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 50:
        return doc, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ROWS = [
    (None, None), (None, "a\nb"), (1, ""), (2, "\n"), (3, "\n\n\n"), (4, "one"), (5, "a\nb\nc"), (5, "a\nb\nc"), (5, "other\ntext\n"),
    (6, "with <P> mark\nx"), (7, "x<S>"), (8, "<M>"), (9, "<P\n>S>\n<\n<<S\n<M"), (10, "é\n漢字🙂\r\n\x0b\x0c z\n"), (11, "\r\r\na\n"),
    *((k, "".join(f"line {j} é\n" * (j % 3) for j in range(k % 17)) + "end" * (k % 2)) for k in range(20, 120)), (200, "y" * 300_000 + "\n" + "z\n" * 50_000),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def by_text(rows):
    return sorted(rows, key=repr)


def test_against_a_plain_version(spark):
    found = fim.transform(frame(spark)).drop("text")
    assert by_text(map(tuple, found.collect())) == by_text(plain(*r) for r in ROWS)


def test_texts_come_back_from_output_and_form(spark):
    found = fim.transform(frame(spark)).select("text", fim.restored(fim.F.col("output"), fim.F.col("form")).alias("back"))
    assert all(r["text"] == r["back"] for r in found.collect())
    digest = fim.digest(fim.transform(frame(spark)))
    whole = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS)
    assert sorted(r["restored_sha256"] for r in digest.collect()) == whole


def test_shares_of_forms_and_other_parameters(spark):
    rows = [(k, f"a{k}\nb\nc\nd\n") for k in range(400)]
    forms = {r["form"]: r["count"] for r in fim.transform(frame(spark, rows), percent=50, spm_percent=25).groupBy("form").count().collect()}
    assert 140 < forms["plain"] < 260 and forms["psm"] > 2 * forms["spm"]
    marks = fim.Marks("«pre»", "«suf»", "«mid»")
    found = fim.transform(frame(spark, rows), marks=marks, pattern="(?s).")
    back = found.select("n", "text", fim.restored(fim.F.col("output"), fim.F.col("form"), marks).alias("back")).collect()
    assert all(r["text"] == r["back"] and r["n"] == len(r["text"]) for r in back)


def test_empty_table_clashing_columns_and_text_ids(spark):
    assert fim.digest(fim.transform(frame(spark, []))).collect() == []
    clash = spark.createDataFrame([(4, "a\nb\n", 1, "n", True, "p", 5)], "doc_id long, text string, row int, name string, known boolean, form string, n int")
    assert [tuple(r) for r in fim.transform(clash).drop("text").collect()] == [plain(4, "a\nb\n")]
    named = spark.createDataFrame([("x7", "a\nb\n"), (None, "c\nd")], "key string, body string")
    found = fim.transform(named, id_col="key", text_col="body").drop("text")
    assert by_text(map(tuple, found.collect())) == by_text([plain("x7", "a\nb\n"), plain(None, "c\nd")])


def test_texts_are_exchanged_once(spark):
    """Unit offsets, requests and texts read one exchange; nothing else is exchanged."""
    found = fim.transform(frame(spark))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2
