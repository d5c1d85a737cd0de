"""Text and math pieces, tag labels and topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MATH, path_parts

#: Delimited math and the environments that hold it.
MATH_BLOCKS = MATH + r"|\\begin\{(equation|align)\*?\}.*?\\end\{\1\*?\}"


def clean(text: Column) -> Column:
    """NUL becomes a space, null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "\u0000", " ")


def text_and_math(text: Column, delimiters: bool = True) -> Column:
    """array<struct<kind, value>> of alternating text and math pieces, empty ones left out."""
    source = F.translate(clean(text), "\u0001", " ")
    cut = F.split(F.regexp_replace(source, MATH_BLOCKS, "\u0001$0\u0001"), "\u0001", -1)
    inner = r"^(?:\$\$|\$|\\\(|\\\[)|(?:\$\$|\$|\\\)|\\\])$"
    pieces = F.transform(cut, lambda s, i: F.struct(F.when(i % 2 == 1, "math").otherwise("text").alias("kind"), (s if delimiters else F.when(i % 2 == 1, F.regexp_replace(s, inner, "")).otherwise(s)).alias("value")))
    return F.filter(pieces, lambda p: F.trim(p["value"]) != "")


def marked_math(text: Column) -> Column:
    """The text with each math piece in [imath] marks."""
    return F.array_join(F.transform(text_and_math(text, delimiters=False), lambda p: F.when(p["kind"] == "math", F.concat(F.lit("[imath]"), p["value"], F.lit("[/imath]"))).otherwise(p["value"])), "")


def spaced_label(name: Column, short: dict[str, str] | None = None) -> Column:
    """CamelCase to words; names on the list to their abbreviations."""
    words = F.trim(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\s]+", " "))
    if not short:
        return words
    known = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), words)


def tag_components(tag: Column, root: str) -> Column:
    """The components of a path without the leading root."""
    parts = path_parts(tag)
    return F.when(F.get(parts, F.lit(0)) == root, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)


def topic(tag: Column, root: str, generic: list[str]) -> Column:
    """The first component after the domain that says something; null if there is none."""
    parts = tag_components(tag, root)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    telling = F.filter(rest, lambda c: ~F.regexp_replace(F.lower(c), "[^a-z0-9]+", "").isin(*generic) & ~F.startswith(F.lower(c), F.lit("general")))
    return F.get(telling, F.lit(0))


def messages(system: Column, user: Column) -> Column:
    """Chat messages; a null system text gives none."""
    own = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.when(system.isNull(), own).otherwise(F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), own))


def with_response(chat: Column, response: Column) -> Column:
    """The chat with the answer, or an error role if there is none."""
    return F.concat(chat, F.array(F.struct(F.when(response.isNull(), "error").otherwise("assistant").alias("role"), F.coalesce(response, F.lit("")).alias("content"))))
