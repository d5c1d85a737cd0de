"""Reading and writing checkpoints, match logs and tables for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES = "target_id string, model_a string, model_b string, winner string, winner_id string, round int"


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def read_checkpoint(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """(query, value) of a JSON map with numbers as keys, in a file, or a map a line in a folder; a missing file and broken ones
    give no rows."""
    empty = spark.createDataFrame([], f"query long, value {value}")
    try:
        text = spark.read.text(path) if _is_folder(spark, path) else spark.read.option("wholetext", True).text(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise
    parsed = text.select(F.from_json("value", f"map<string,{value}>").alias("m")).where(F.col("m").isNotNull())
    return parsed.select(F.explode("m").alias("k", "value")).select(F.col("k").try_cast("long").alias("query"), "value").where(F.col("query").isNotNull())


def write_checkpoint(rows: DataFrame, folder: str) -> None:
    """(query, value) rows as JSON lines, one map of one entry each, which read_checkpoint() reads back; the writer's commit
    makes the folder whole or absent. Null and NaN values are null."""
    value = F.when(~F.isnan("value"), F.col("value")) if dict(rows.dtypes)["value"] in ("double", "float") else F.col("value")
    entry = F.to_json(F.create_map(F.col("query").cast("string"), value), {"ignoreNullFields": "false"})
    rows.select(entry.alias("value")).write.mode("overwrite").text(folder)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Match logs by position: the first line is skipped whatever it names, and lines that lack fields have nulls."""
    return spark.read.csv(path, header=True, schema=MATCHES, enforceSchema=True, mode="PERMISSIVE")


def append_matches(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").csv(folder, header=True)


def leaderboard(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV table without a byte-order mark; missing columns raise."""
    found = spark.read.csv(path, header=True)
    found = found.toDF(*[c.lstrip("﻿") for c in found.columns])
    missing = [c for c in required if c not in found.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return found


def write_rounded_csv(rows: DataFrame, folder: str, digits: int = 4) -> None:
    """Numbers rounded; NaN and null are empty."""
    cells = [F.when(~F.isnan(c), F.round(c, digits)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*cells).write.mode("overwrite").csv(folder, header=True, emptyValue="", nullValue="")


def markdown(rows: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A Markdown table of a small result; more than `most` rows raise."""
    return _grid(rows, digits, most, lambda cells: "| " + " | ".join(cells) + " |", lambda n: "|" + "---|" * n)


def latex(rows: DataFrame, digits: int = 3, most: int = 1000) -> str:
    body = _grid(rows, digits, most, lambda cells: " & ".join(c.replace("_", r"\_") for c in cells) + r" \\", lambda n: r"\midrule")
    return f"\\begin{{tabular}}{{{'l' * len(rows.columns)}}}\n{body}\n\\end{{tabular}}"


def _grid(rows: DataFrame, digits: int, most: int, line, rule) -> str:
    def cell(x: object) -> str:
        return "-" if x is None or x != x else f"{x:.{digits}f}" if isinstance(x, float) else str(x)

    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write them as CSV")
    return "\n".join([line(rows.columns), rule(len(rows.columns)), *(line([cell(x) for x in r]) for r in found)])
