"""Sets of row numbers as bitmaps, a bucket of rows a piece, and answers put back in the order of their requests.

A set is a table (domain, bucket, bits): Spark's bitmap aggregates build a bucket of 32,768 rows in at most 4 KB. Sets meet bucket by
bucket, so and, or and not of sets of any size are joins of small pieces, and a domain of all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a bucket, and bytes of its bitmap, of Spark's bitmap functions.
BUCKET_ROWS, BUCKET_BYTES = 32_768, 4096


def row_sets(rows: DataFrame, row: str, domain: str) -> DataFrame:
    """(domain, bucket, bits) of rows numbered from 0."""
    number = F.col(row) + 1  # bitmap functions count from 1
    placed = rows.where(F.col(domain).isNotNull()).select(F.col(domain).alias("domain"), F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    return placed.groupBy("domain", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def write_index(rows: DataFrame, path: str, row: str, domain: str) -> None:
    """The sets of all domains, sorted by domain so that one is a short range."""
    sets = row_sets(rows, row, domain)
    sets.repartitionByRange("domain", "bucket").sortWithinPartitions("domain", "bucket").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("domain string, bucket long, bits binary").parquet(path)


def rows_of(index: DataFrame, domain: str) -> DataFrame:
    """One domain's set, without its name: (bucket, bits)."""
    return index.where(F.col("domain") == domain).select("bucket", "bits")


def _words(bits: Column) -> Column:
    """A bitmap as 512 numbers of 64 bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKET_BYTES // 8 - 1)), lambda i: F.conv(F.hex(F.substring(bits, i * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def _joined(words: Column) -> Column:
    return F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def meet(sets: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """sets ((domain,) bucket, bits) with the set `other` (bucket, bits): "and", "or" or "not" (sets without other). "or" adds to sets without a
    domain; of named sets each would grow by the whole other one, so name them first."""
    right = other.select("bucket", F.col("bits").alias("_bits"))
    both = sets.join(right, "bucket", {"and": "inner", "or": "full", "not": "left"}[how])
    signs = {"and": lambda a, b: a.bitwiseAND(b), "or": lambda a, b: a.bitwiseOR(b), "not": lambda a, b: a.bitwiseAND(F.bitwise_not(b))}
    met = _joined(F.zip_with(_words(F.col("bits")), _words(F.col("_bits")), signs[how]))
    bits = F.when(F.col("_bits").isNull(), F.col("bits")).when(F.col("bits").isNull(), F.col("_bits")).otherwise(met)
    return both.withColumn("bits", bits).drop("_bits")


def size(sets: DataFrame, name: str) -> DataFrame:
    """The number of rows in each domain's set."""
    return sets.groupBy("domain").agg(F.sum(F.bitmap_count("bits")).alias(name))


def members(sets: DataFrame) -> DataFrame:
    """(.., row) of every member of the sets, in buckets' order."""
    others = [c for c in sets.columns if c not in ("bucket", "bits")]
    octets = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BUCKET_BYTES - 1)), lambda i: F.conv(F.hex(F.substring("bits", i + 1, F.lit(1))), 16, 10).cast("int")))
    each = sets.select(*others, "bucket", octets.alias("octet", "value")).where("value > 0")
    bit = each.select(*others, "bucket", "octet", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).where("(value >> bit) & 1 = 1")
    return bit.select(*others, ((F.col("bucket") - 1) * BUCKET_ROWS + F.col("octet") * 8 + F.col("bit")).alias("row"))


def first_row(sets: DataFrame, name: str) -> DataFrame:
    """The smallest member of each domain's set: only its first bucket is opened."""
    lowest = sets.where(F.bitmap_count("bits") > 0).groupBy("domain").agg(F.min_by(F.struct("bucket", "bits"), "bucket").alias("s")).select("domain", "s.*")
    return members(lowest).groupBy("domain").agg(F.min("row").alias(name))


def reassembled(asked: DataFrame, answers: DataFrame, batch: str, key: str, answer: str, place: str) -> DataFrame:
    """Per batch: asked, answered, missing, repeated and surplus, and answers in the order of the requests' keys, empty where none
    came. Of several answers to a request the first by place counts; answers to nothing asked are surplus. answers may
    come in any order."""
    first = answers.groupBy(batch, key).agg(F.min_by(answer, place).alias("_answer"), (F.count("*") - 1).alias("_more"))
    wanted = asked.select(batch, key).withColumn("_asked", F.lit(True))
    both = wanted.join(first, [batch, key], "full")
    known, came = F.col("_asked").isNotNull(), F.col("_more").isNotNull()
    listed = F.transform(F.array_sort(F.collect_list(F.when(known, F.struct(key, F.coalesce("_answer", F.lit("")).alias("a"))))), lambda x: x["a"])
    return both.groupBy(batch).agg(
        F.count(F.when(known, 1)).alias("asked"),
        F.count(F.when(known & came, 1)).alias("answered"),
        F.count(F.when(known & ~came, 1)).alias("missing"),
        F.coalesce(F.sum(F.when(known, F.col("_more"))), F.lit(0)).alias("repeated"),
        F.count(F.when(~known, 1)).alias("surplus"),
        F.array_join(listed, ",").alias("answers"),
    )
