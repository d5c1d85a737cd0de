"""Text views, tokenizers and parsers, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Delimited math, in the forms $$..$$, $..$, \(..\) and \[..\].
MATH = r"(?s)\$\$.*?\$\$|\$[^$]*?\$|\\\(.*?\\\)|\\\[.*?\\\]"
#: The lexemes of math text: commands, numbers, single symbols.
MATH_LEXEME = r"\\[a-zA-Z]+|[0-9]+(?:\.[0-9]+)?|[a-zA-Z]|[^\s\\a-zA-Z0-9]"
#: Frequent English words left out of idea tokens.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def statement_view(problem: Column) -> Column:
    return problem


def full_view(problem: Column, solution: Column) -> Column:
    """Problem and solution in one text; a missing part reads None."""
    return F.concat(F.lit("Problem: "), F.coalesce(problem, F.lit("None")), F.lit("\n\nSolution: "), F.coalesce(solution, F.lit("None")))


def text_view(version: str, problem: Column, solution: Column) -> Column:
    if version == "statement":
        return statement_view(problem)
    if version == "full":
        return full_view(problem, solution)
    raise ValueError(f"unknown version {version!r}")


#: Task to (query version, document version).
TASK_VIEWS = {"statement-statement": ("statement", "statement"), "statement-full": ("statement", "full"), "full-full": ("full", "full")}


def instructed(instruction: Column | str | None, text: Column) -> Column:
    """'Instruct: ..' before the query; without an instruction the text alone."""
    if instruction is None:
        return text
    instruction = F.lit(instruction) if isinstance(instruction, str) else instruction
    return F.when(instruction.isNull(), text).otherwise(F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery: "), text))


def affixed(text: Column, prefix: Column | None = None, suffix: Column | None = None) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("")) if prefix is not None else F.lit(""), text, F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit(""))


def labelled(**columns: Column) -> Column:
    """'NAME: value' parts, a blank line between; null ones are left out."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"{n}: "), c) for n, c in columns.items()])


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def math_expressions(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MATH), F.lit(0))


def without_math(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), MATH, ""))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(without_math(text)), F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]+(?![\p{L}\p{N}_])"), F.lit(0))


def math_tokens(text: Column) -> Column:
    """Lexemes of all math expressions, delimiters left out. A stand-in for a native math lexer."""
    inner = F.regexp_replace(F.array_join(math_expressions(text), " "), r"\$|\\\(|\\\)|\\\[|\\\]", " ")
    return F.regexp_extract_all(inner, F.lit(MATH_LEXEME), F.lit(0))


def math_word_tokens(text: Column) -> Column:
    """Math lexemes, then words."""
    return F.concat(math_tokens(text), word_tokens(text))


def idea_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-cased tokens without stop words; a caller with a full list of its own passes it."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z0-9^_]+"), F.lit(0))
    return F.filter(tokens, lambda x: ~x.isin(*stop_words))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Set overlap of two arrays; `empty` if both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def path_parts(tag: Column) -> Column:
    return F.filter(F.split(tag, "/"), lambda x: x != "")


def boxed_choice(text: Column) -> Column:
    r"""The 1 or 2 in \boxed{..}; null without."""
    return F.nullif(F.regexp_extract(text, r"\\boxed\{\s*([12])\s*\}", 1), F.lit("")).cast("int")


def last_boxed(text: Column) -> Column:
    r"""What the last \boxed{ holds up to the first closing brace; empty without."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{(.*?)\}"), F.lit(1)), F.lit(-1)), F.lit(""))


def without_thinking(text: Column) -> Column:
    """What follows the first </think>, trimmed; else the text without analysis..assistantfinal."""
    return F.when(F.contains(text, F.lit("</think>")), F.trim(F.split_part(text, F.lit("</think>"), F.lit(2)))).otherwise(F.regexp_replace(text, "(?s)analysis.*?assistantfinal", ""))


def tagged_score(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"<score>\s*(\d+)\s*</score>", 1), F.lit("")).try_cast("int"), F.lit(0))


def number_in(text: Column) -> Column:
    """The first number of a text, percent signs and commas left out; null without."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "[%,]", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def group_scores(text: Column) -> Column:
    """map<string,double> of a listwise answer: the answer section, its last JSON block or else its last braces, with the
    second bracket after "[number]" left out, a brace added where fewer close than open, and white space collapsed; null if it
    can't be parsed."""
    body = F.when(F.contains(text, F.lit("<answer>")), F.split_part(F.split_part(text, F.lit("<answer>"), F.lit(2)), F.lit("</answer>"), F.lit(1))).otherwise(text)
    fenced = F.try_element_at(F.regexp_extract_all(body, F.lit(r"```json\s*([\s\S]+?)\s*```"), F.lit(1)), F.lit(-1))
    braces = F.try_element_at(F.regexp_extract_all(body, F.lit(r"\{[\s\S]*?\}"), F.lit(0)), F.lit(-1))
    mended = F.trim(F.regexp_replace(F.coalesce(fenced, braces), r"(\[\d+\])\]", "$1"))
    opened, shut = (F.length(mended) - F.length(F.replace(mended, F.lit(c), F.lit(""))) for c in "{}")
    closed = F.when(opened > shut, F.concat(mended, F.lit("}"))).otherwise(mended)
    return F.from_json(F.regexp_replace(closed, r"\s+", " "), "map<string,double>")


def core_idea(answer: Column) -> Column:
    """The idea of a JSON answer; empty if it says there is none or has none."""
    none = F.lower(F.coalesce(F.get_json_object(answer, "$.noCoreIdea"), F.lit("false")))
    return F.when(~none.isin("false", "0", "null", ""), F.lit("")).otherwise(F.coalesce(F.get_json_object(answer, "$.coreIdea"), F.lit("")))


def chunks(tokens: Column, size: int) -> Column:
    """Fixed-size token chunks; an empty text gives one empty chunk."""

    def cut(held: Column) -> Column:
        n = F.greatest(F.ceil(F.size(held) / size).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(held, i * size + 1, size))

    # bound by a lambda, or a text would be split anew for each of its chunks
    return F.transform(F.array(tokens), cut)[0]


def truncated(text: Column, tokens: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, tokens), " ")


#: The parts of a result file's name, with a prompt key and, in older files, without one.
RUN_NAME = r"^(.+?)__(p\d+)(?:__n(\d+)_seed(\d+))?(?:__shard(\d+)of(\d+))?(?:__part-(.+))?$"
RUN_NAME_WITHOUT_PROMPT = r"^(.+?)()(?:__n(\d+)_seed(\d+))?(?:__shard(\d+)of(\d+))?(?:__part-(.+))?$"


def run_name(stem: Column) -> Column:
    """struct of a run file's stem: model, prompt (null in names of the older form), n, seed, shard, shards, part."""
    def part(i: int) -> Column:
        return F.nullif(F.when(stem.rlike(RUN_NAME), F.regexp_extract(stem, RUN_NAME, i)).otherwise(F.regexp_extract(stem, RUN_NAME_WITHOUT_PROMPT, i)), F.lit(""))

    return F.struct(part(1).alias("model"), part(2).alias("prompt"), *[part(3 + i).try_cast("int").alias(n) for i, n in enumerate(("n", "seed", "shard", "shards"))], part(7).alias("part"))


def run_stem(model: Column, prompt: Column, n: Column, seed: Column, shard: Column, shards: Column, part: Column) -> Column:
    return F.concat_ws("__", model, prompt, F.concat(F.lit("n"), n, F.lit("_seed"), seed), F.concat(F.lit("shard"), shard, F.lit("of"), shards), F.concat(F.lit("part-"), part))


def base_name(stem: Column) -> Column:
    return F.regexp_replace(stem, r"__shard\d+of\d+", "")


def prompt_key(value: Column) -> Column:
    """'1', 'p1', ' P1 ' and null to p1, p1, p1 and p0."""
    low = F.lower(F.trim(F.coalesce(value, F.lit("0"))))
    return F.when(low.rlike(r"^\d+$"), F.concat(F.lit("p"), low)).otherwise(low)


def linked_label(text: Column) -> Column:
    """The label of a markdown link; other texts stay."""
    label = F.regexp_extract(F.trim(text), r"^\[([^\]]+)\]\((.*)\)$", 1)
    return F.when(label != "", label).otherwise(F.trim(text))


#: The dashes that count as a hyphen.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text)
    return re.sub(r"\s+", " ", re.sub(f"[{DASHES}]", "-", text)).strip().lower()


canonical_name = F.udf(_canonical, T.StringType(), useArrow=True)


def _boxed(text: str | None) -> list[str]:
    out, at = [], 0
    text = text or ""
    while (at := text.find(r"\boxed{", at)) >= 0:
        begin = at = at + 7
        depth = 1
        while at < len(text) and depth:
            depth += (text[at] == "{") - (text[at] == "}")
            at += 1
        if depth:
            break
        out.append(text[begin : at - 1])
    return out


#: All contents of \boxed{..} with balanced braces: not a regular language, so an Arrow function.
balanced_boxes = F.udf(_boxed, T.ArrayType(T.StringType()), useArrow=True)
