"""Queries on delimited math, formula structure and listwise answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scorers
from ..functions import scan
from ..functions.portable import sql_hash
from ..operators import structure as S
from ..sources.tables import load, shared_folder
from .common import JUDGMENTS, judgments, query, rounded

#: What stands for marks of math in the documents: marks open, close, nest and stay open as words fall.
_MARKS = (("\n", "$"), ("!!", "$$"), (", ", " \\[ "), (". ", " \\] "), ("ing", "\\("), ("es", "\\)"), ("ent", "\\begin{equation*}"), ("er", "\\end{equation}"), ("qu", "\\begin{align}"), ("th", "\\end{align*}"))
_FORMS = r"\$\$(?:.+?)\$\$|\$(?:.+?)\$|\\\[(?:.+?)\\\]|\\\((?:.+?)\\\)|\\begin\{equation\*?\}(?:.+?)\\end\{equation\*?\}|\\begin\{align\*?\}(?:.+?)\\end\{align\*?\}"
_MARKED = reduce(lambda t, m: f"replace({t}, {'chr(10)' if m[0] == chr(10) else repr(m[0])}, '{m[1]}')", _MARKS, "coalesce(text, '')")


@query(f"""with d as (select doc_id, {_MARKED} as t from documents), p as (select doc_id, regexp_extract_all(t, '(?s)(?:{_FORMS})') as tex, regexp_split_to_array(t, '(?s)(?:{_FORMS})') as term from d),
c as (select doc_id, tex, list_filter(list_transform(term, lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ')), lambda x: x <> '') as term from p)
select doc_id, len(tex)::int as n_tex, len(term)::int as n_term, md5(array_to_string(tex, chr(31))) as tex_md5, md5(array_to_string(term, chr(31))) as term_md5 from c""")
def math_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Running text and delimited math of whole documents in all six forms, marks kept; marks that never close are text."""
    text = reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), _MARKS, F.coalesce(F.col("text"), F.lit("")))
    found = load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", scan.tex_pieces_of(text, True).alias("p"))

    def values(kind: str) -> Column:
        return F.transform(F.filter("p", lambda x: x["kind"] == kind), lambda x: x["value"])

    each = found.select("doc_id", values("tex").alias("tex"), values("term").alias("term"))
    return each.select("doc_id", F.size("tex").alias("n_tex"), F.size("term").alias("n_term"), *[F.md5(F.array_join(c, "\x1f")).alias(f"{c}_md5") for c in ("tex", "term")])


@query(f"""with {JUDGMENTS}, e as (select query, pos, relevance, epoch, row_number() over (partition by query, epoch order by {sql_hash("'42|' || query || '|' || epoch || '|' || pos")}, pos) - 1 as n from j, (select unnest([0, 1]) as epoch)),
g as (select *, n // 20 as grp, n % 20 + 1 as place, {sql_hash("query || '|' || epoch || '|' || n // 20")} % 5 as kind from e),
s as (select query, pos, case when kind = 0 then 0 when kind = 1 and place % 3 = 0 then null when kind = 4 and place % 2 = 0 then null else relevance / 10 end as s from g)
select query, pos, round(coalesce(avg(s), 0), 6) as score from s group by 1, 2""")
def listwise_group_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates scored in shuffled groups over two epochs, from answers of five kinds that vary by group: cut off before any
    brace closes (the group fails), places left out, fenced with doubled brackets and a lost brace, after thinking aloud, and with
    values that are no numbers."""
    groups = scorers.listwise_groups(judgments(spark, sf).select("query", "pos", "relevance"))
    kind = F.conv(F.substring(F.md5(F.concat_ws("|", "query", "epoch", "group")), 1, 8), 16, 10).cast("long") % 5
    rows = groups.withColumn("kind", kind)
    entry = F.format_string('"[%d%s": %s', "place", F.when((F.col("kind") == 2) & (F.col("place") % 2 == 0), "]]").otherwise("]"), F.when((F.col("kind") == 4) & (F.col("place") % 2 == 0), F.lit('"none"')).otherwise(F.col("relevance").cast("string")))
    said = F.when((F.col("kind") != 1) | (F.col("place") % 3 != 0), F.struct("place", entry.alias("e")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["e"]), ",\n ")
    lists = rows.groupBy("query", "epoch", "group", "kind").agg(body.alias("b"))
    answer = (
        F.when(F.col("kind") == 0, F.concat(F.lit("so <answer> {"), "b"))
        .when(F.col("kind") == 1, F.concat(F.lit("{"), "b", F.lit("}")))
        .when(F.col("kind") == 2, F.concat(F.lit("<answer>```json\n{"), "b", F.lit("\n```</answer>")))
        .when(F.col("kind") == 3, F.concat(F.lit('first {"[1]": 9} then <answer>{"[2]": 1} or {'), "b", F.lit("}</answer> and {}")))
        .otherwise(F.concat(F.lit("```json {} ``` and ```json\n{"), "b", F.lit("}\n``` done")))
    )
    return rounded(scorers.listwise_scores(groups, lists.select("query", "epoch", "group", answer.alias("answer"))), "score")


def formula_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text): each line of a document as a formula, its form by the line's length, its names by the line's words."""

    def name(line: Column, nth: int) -> Column:
        first = F.lower(F.substring(F.get(F.split(line, " "), F.lit(nth)), 1, 1))
        return F.when(first.rlike("^[a-z]$"), first).otherwise(F.lit("x"))

    def formula(line: Column) -> Column:
        a, b, c = (name(line, i) for i in range(3))
        forms = ("$\\frac{%s}{%s+%s}$", "\\(%s^{%s}=%s\\)", "$$\\sqrt{%s+%s}%s$$", "\\[%s_{1}+%s<%s\\]", "\\begin{equation}%s(%s-%s)=0\\end{equation}")
        kind = F.char_length(line) % len(forms)
        return F.concat(F.substring_index(line, " ", 2), F.lit(" "), reduce(lambda other, i: F.when(kind == i, F.format_string(forms[i], a, b, c)).otherwise(other), range(1, len(forms)), F.format_string(forms[0], a, b, c)))

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return load(spark, sf, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("id"), F.array_join(F.transform(lines, formula), " ").alias("text"))


@query()
def math_structure_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best structures for the formulas of each document whose id is divisible by 100, among those of all documents."""
    texts, folder = formula_texts(spark, sf), shared_folder(spark, "formula-index")
    S.write_index(texts, folder)
    return rounded(S.search(texts.where("id % 100 = 0"), folder), "score")


@query()
def math_structure_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The registered scorer over lists: a document whose id is divisible by 20 asks, it and the 19 after it are its candidates."""
    texts = formula_texts(spark, sf).withColumn("query", F.col("id") - F.col("id") % 20)
    asked = texts.where("id = query").select("query", F.col("text").alias("query_text"))
    pairs = texts.join(asked, "query").select("query", F.col("id").alias("pos"), F.col("id").alias("doc"), "query_text", F.col("text").alias("doc_text"))
    return rounded(scorers.make_scorer("math-structure")(pairs).select("query", "pos", "score"), "score")
