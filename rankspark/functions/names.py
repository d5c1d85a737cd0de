"""Names, lists and templates: model keys, stems, domains and topics, ordered sets, prompt filling, seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, path_parts


def model_key(model_id: Column, exceptions: dict[str, str] | None = None) -> Column:
    """The exception's key, else the last path segment in lower case."""
    last = F.lower(F.element_at(F.split(model_id, "/"), -1))
    if not exceptions:
        return last
    table = F.create_map(*[F.lit(x) for pair in exceptions.items() for x in pair])
    return F.coalesce(F.try_element_at(table, model_id), last)


def file_stem(model_id: Column) -> Column:
    return F.replace(model_id, F.lit("/"), F.lit("_"))


def frontier_class(category: Column) -> Column:
    return F.when(category == "RERANK", "cross").otherwise("bi")


def first_domain(domains: Column) -> Column:
    """The first of a list; an empty or missing list raises."""
    empty = domains.isNull() | (F.size(domains) == 0)
    return F.when(empty, F.raise_error(F.lit("no domain")).cast("string")).otherwise(F.element_at(domains, 1))


def as_list(value: Column, is_array: bool) -> Column:
    """Null becomes an empty list, a scalar a list of one."""
    return F.coalesce(value, F.array().cast("array<string>")) if is_array else F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


def ordered_distinct(values: Column) -> Column:
    """Distinct values in the order of their first places."""
    return F.array_distinct(values)


def domains_of(domains: Column, tags: Column, known: list[str]) -> Column:
    """The listed domains, told by letters and digits alone, else those of the tags' first components; in order, once each."""
    names = F.create_map(*[x for d in known for x in (compact(F.lit(d)), F.lit(d))])

    def named(values: Column) -> Column:
        return ordered_distinct(F.filter(F.transform(values, lambda d: F.try_element_at(names, compact(d))), lambda d: d.isNotNull()))

    listed = named(F.coalesce(domains, F.array().cast("array<string>")))
    from_tags = named(F.filter(F.transform(tags, lambda t: F.get(path_parts(t), 0)), lambda d: d.isNotNull()))
    return F.when(F.size(listed) > 0, listed).otherwise(from_tags)


def topics_by_domain(domains: Column, tags: Column) -> Column:
    """(domain, topic) of each domain: the sorted second components of its tags, or Other."""
    def of(domain: Column) -> Column:
        own = F.filter(F.transform(tags, path_parts), lambda p: (F.get(p, 0) == domain) & (F.size(p) > 1))
        topics = F.array_sort(F.array_distinct(F.transform(own, lambda p: F.get(p, 1))))
        return F.transform(F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit("Other"))), lambda t: F.struct(domain.alias("domain"), t.alias("topic")))

    return F.flatten(F.transform(domains, of))


def filled(template: str, **fields: Column) -> Column:
    """The template with the {name} of each field that it has; other fields and other braces stay as they are."""
    out = F.lit(template)
    for name, value in fields.items():
        if f"{{{name}}}" in template:
            out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, broken at spaces; a longer word has its own line."""
    def step(acc: Column, word: Column) -> Column:
        last = F.substring_index(acc, "\n", -1)
        return F.when(acc == "", word).when(F.length(last) + 1 + F.length(word) <= width, F.concat(acc, F.lit(" "), word)).otherwise(F.concat(acc, F.lit("\n"), word))

    return F.aggregate(F.split(text, " "), F.lit(""), step)


def seed_of(*parts: Column) -> Column:
    """The first 32 bits of the SHA-256 of the parts joined by '|', as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def four_parts(text: Column, pattern: str) -> tuple[Column, Column]:
    """The trimmed math expressions joined by ', ', and the trimmed text without them."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.trim), ", "), F.trim(F.regexp_replace(text, pattern, ""))


def inner_math(text: Column) -> Column:
    """What the dollar pairs of a pre-split string hold."""
    return F.regexp_extract_all(text, F.lit(r"\${1,2}(.*?)\${1,2}"), F.lit(1))


def cell(value: Column, digits: int = 3, missing: str = "-") -> Column:
    return F.when(value.isNull() | F.isnan(value), missing).otherwise(F.format_string(f"%.{digits}f", F.bround(value, digits)))


def delta_cell(value: Column, base: Column, digits: int = 3) -> Column:
    """A signed difference; '-' where either is missing."""
    return F.when(value.isNull() | base.isNull(), "-").otherwise(F.format_string(f"%+.{digits}f", F.bround(value - base, digits)))


def short_count(n: Column) -> Column:
    """1234 as 1.2k, 2500000 as 2.5M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fk", n / 1000)).otherwise(n.cast("string"))
