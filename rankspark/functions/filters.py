"""Row predicates and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import path_parts


def in_branch(domains: Column, branch: str) -> Column:
    return F.array_contains(domains, branch)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def usable(tags: Column, idea: Column) -> Column:
    """Tags and a non-blank idea."""
    return (F.size(tags) > 0) & (F.length(F.trim(F.coalesce(idea, F.lit("")))) > 0)


def valid_relevance(values: Column, n: int) -> Column:
    """At least n values, the first n neither null nor NaN."""
    return values.isNotNull() & (F.size(values) >= n) & F.forall(F.slice(values, 1, n), lambda v: v.isNotNull() & ~F.isnan(v))


def not_blocked(text: Column, digests: list[str]) -> Column:
    """The text's MD5 is not on the list."""
    return ~F.md5(text).isin(*digests) if digests else F.lit(True)


def basic(no_feedback: Column, too_long: Column, text: Column, patterns: list[str]) -> Column:
    kept = ~F.coalesce(no_feedback, F.lit(False)) & ~F.coalesce(too_long, F.lit(False))
    for p in patterns:
        kept = kept & ~text.rlike(p)
    return kept


def family(name: Column, families: list[str]) -> Column:
    """Whether a name holds one of the families as a token of its own."""
    return name.rlike("(?i)" + "|".join(rf"(?:^|[-_/ ]){f}(?:$|[-_/ ])" for f in families))


def above(scores: Column, parent: Column, threshold: float) -> Column:
    """The tags of a score map at or above the threshold, without the parent."""
    return F.map_filter(scores, lambda k, v: (v >= threshold) & (k != parent))


def generic(component: Column, words: list[str], domain: Column) -> Column:
    """Whether a path component says nothing: a listed word, the domain itself, or general.."""
    low = F.regexp_replace(F.lower(component), "[^a-z0-9]+", "")
    return low.isin(*words) | (low == F.regexp_replace(F.lower(domain), "[^a-z0-9]+", "")) | low.startswith("general")


def domains(tags: Column, names: dict[str, str]) -> Column:
    """Distinct domains of '/root/top/..' tags by their second component, in order of first appearance; others are left out."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.try_element_at(known, F.get(path_parts(t), F.lit(1)))), lambda d: d.isNotNull()))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df; a row that fails the condition raises when it is read."""
    return df.where(F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def require_all_found(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Referential integrity: rows whose key is unknown raise, with the key."""
    known = keys.select(F.col(key).alias("_k")).distinct()
    joined = rows.join(known, F.col(key) == F.col("_k"), "left")
    return joined.where(F.when(F.col("_k").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("unknown key: "), F.col(key).cast("string"))).cast("boolean"))).drop("_k")


def require_equal(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(compared, largest difference) of two results; a difference beyond the tolerance raises."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    found = both.agg(F.count("*").alias("compared"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest"))
    return require(found, F.coalesce(F.col("largest"), F.lit(0.0)) <= tolerance, "results differ")
