"""Hashes and small expressions that give the same values in Spark and in standard SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_hash(*parts: Column | str) -> Column:
    """The first 32 bits of the MD5 of the parts joined by '|', as a long. Strings are literals."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sql_hash(text: str) -> str:
    """The same hash of a SQL string expression, for DuckDB."""
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"
