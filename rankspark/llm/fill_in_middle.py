"""Fill-in-middle transformation with relational units: a text's units (lines here) become rows, their lengths are summed up in
a window, a document's two cuts meet the units whose ordinals they name, the offsets found are aggregated per document, and
the text is cut there by substring.

Plan: every row gets a number and is dealt once by it, with its id and text. Unit lengths, cut requests and texts are three
readings of that one exchange: it is hashed on all of KEYS, which no reading can do without, and each reading takes the
text, so their plans are alike and the exchange is made once. Window, joins and aggregates keep its partitioning: texts cross
the network once, unit rows never. Joins hash the smaller side (a few numbers a document), so no texts are sorted. Row numbers are
unique, so no partition can be hot, however often an id or a text repeats.

A cut request names the number of units before the cut. Which units, the form and whether a text is changed at all come from
a hash of the id. Prefix-suffix-middle puts prefix, suffix, middle after their marks; suffix-prefix-middle the suffix first.
restored() rebuilds the text from output and form alone: the marks' first letters stand nowhere else in them, so the first
mark found is the true one.

Defined results: null is the empty text; empty texts and those which contain a mark stay plain; a null id hashes as the empty
string; repeated rows are transformed each on its own and alike; texts without the unit pattern's match have no units; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units are matched left to right; the pattern must cover the whole text.
LINES = "[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Marks:
    """The three marks; none may begin inside another."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


MARKS = Marks()


def draws(id_text: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a hash of the id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


#: The row's number, its id as text (empty if null), whether there is one, and a hash of the text. With the hash every reading of the
#: rows needs every column below their numbers, so that numbers agree even where a caller drops a column and with it the reuse.
KEYS = ("row", "name", "known", "stamp")


def unit_offsets(rows: DataFrame, pattern: str = LINES) -> DataFrame:
    """Per unit of rows (KEYS, text): KEYS, ordinal (from 1), the end offset in code points, and n, the row's number of units."""
    units = rows.select(*KEYS, F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "unit"))
    sized = units.select(*KEYS, (F.col("pos") + 1).cast("long").alias("ordinal"), F.char_length("unit").cast("long").alias("length"))
    document = Window.partitionBy(*KEYS)
    running = document.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return sized.select(*KEYS, "ordinal", F.sum("length").over(running).alias("end"), F.count("*").over(document).alias("n"))


def cut_requests(rows: DataFrame, percent: int, spm_percent: int, seed: int, marks: Marks) -> DataFrame:
    """Per row: KEYS, form and two draws; a cut follows draw % (n + 1) units."""
    first, second, chance, way = draws(F.col("name"), seed)
    free = F.col("text") != ""
    for mark in (marks.prefix, marks.suffix, marks.middle):
        free &= ~F.contains(F.col("text"), F.lit(mark))
    form = F.when(~free | (chance % 100 >= percent), "plain").when(way % 100 < spm_percent, "spm").otherwise("psm")
    return rows.select(*KEYS, form.alias("form"), first.alias("draw_a"), second.alias("draw_b"))


def cut_offsets(units: DataFrame, requests: DataFrame) -> DataFrame:
    """Per row with units: KEYS, form, n and the code points before its two cuts. A cut before all units meets none of them and
    keeps offset 0."""
    first, second = F.col("draw_a") % (F.col("n") + 1), F.col("draw_b") % (F.col("n") + 1)
    # ordinals are met within the row, so the exchange serves; the last unit is always met, so that n comes through
    wanted = F.array(F.least(first, second), F.greatest(first, second), F.col("n"))
    met = units.join(requests.hint("shuffle_hash"), list(KEYS)).where(F.array_contains(wanted, F.col("ordinal")))

    def end(cut: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("ordinal") == cut, F.col("end"))), F.lit(0)).cast("long")

    return met.groupBy(*KEYS).agg(F.max("form").alias("form"), F.max("n").alias("n"), end(F.least(first, second)).alias("cut_a"), end(F.greatest(first, second)).alias("cut_b"))


def transform(documents: DataFrame, percent: int = 100, spm_percent: int = 50, seed: int = 7, pattern: str = LINES, marks: Marks = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    kind = documents.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbered = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.col(id_col).isNotNull().alias("known"),
        F.xxhash64(text).alias("stamp"),
        text.alias("text"),
    )
    rows = numbered.repartition(*KEYS)
    offsets = cut_offsets(unit_offsets(rows, pattern), cut_requests(rows, percent, spm_percent, seed, marks))
    found = rows.join(offsets.hint("shuffle_hash"), list(KEYS), "left").withColumn("form", F.coalesce("form", F.lit("plain")))
    a, b = F.col("cut_a").cast("int"), F.col("cut_b").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), a), F.substr("text", a + 1, b - a), F.substr("text", b + 1)
    psm = F.concat(F.lit(marks.prefix), prefix, F.lit(marks.suffix), suffix, F.lit(marks.middle), middle)
    spm = F.concat(F.lit(marks.suffix), suffix, F.lit(marks.prefix), prefix, F.lit(marks.middle), middle)
    changed = F.col("form") != "plain"
    return found.select(
        F.when(F.col("known"), F.col("name")).cast(kind).alias("doc_id"),
        "text",
        F.coalesce("n", F.lit(0)).alias("n"),
        "form",
        F.when(changed, F.col("cut_a")).alias("prefix_chars"),
        F.when(changed, F.col("cut_b") - F.col("cut_a")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column, marks: Marks = MARKS) -> Column:
    """The text, from output and form."""

    def between(rest: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(rest, mark, 1)
        return head, F.substr(rest, F.char_length(head) + len(mark) + 1)

    prefix, rest = between(F.substr(output, F.lit(len(marks.prefix) + 1)), marks.suffix)
    suffix, middle = between(rest, marks.middle)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = between(F.substr(output, F.lit(len(marks.suffix) + 1)), marks.prefix)
    prefix, middle = between(rest, marks.middle)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digest(found: DataFrame, marks: Marks = MARKS) -> DataFrame:
    """The contract's columns from transform()."""
    back = restored(F.col("output"), F.col("form"), marks)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))
