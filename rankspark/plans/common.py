"""Registration of queries with their SQL twins, and the stand-in judgments over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL twin if there is one."""

    def take(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return take


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    """A query is a part, its candidates are its lineitems in order of key, score is the price, relevance the discount in
    steps of two hundredths (0 to 5), domains the flag and the status."""
    items = load(spark, sf, "lineitem", ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"])
    return items.select(F.col("l_partkey").alias("query"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey")).alias("pos"), F.col("l_extendedprice").alias("score"), F.floor(F.col("l_discount") * 50 + 0.5).cast("double").alias("relevance"), "l_returnflag", "l_linestatus")


#: The same judgments in SQL, as a common table expression j.
JUDGMENTS = """j as (select l_partkey as query, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey as pos, l_extendedprice as score,
  floor(l_discount * 50 + 0.5)::double as relevance, l_returnflag, l_linestatus from lineitem)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
