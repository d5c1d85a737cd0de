"""Target-distribution importance resampling in DataFrame functions alone: hashed n-gram bags of raw and target texts give each
bucket a gain, a document weighs the mean gain of its n-grams, and Gumbel noise drawn from its id makes the highest scores a
sample without replacement.

Plan: words are found once and each document's bucket numbers are written to the shared folder, with a row number, so that
neither lost executors nor repeated ids can mix rows up. Then the arrays are exploded twice: into counts by bucket (combined
before the shuffle, so a frequent n-gram costs a row a task) and, joined to the broadcast gains (one row a bucket: `buckets` is
their bound), into one sum a row. Scores are sorted over all partitions by range, ties by id and row, and written with their
places; a rank is the place in a partition plus the rows of the partitions before it, of which the plan holds one row each.

Words are runs of 0-9, a-z (after lower-casing A-Z) and characters above ASCII. Gains are whole thousandths, so sums and the
floored mean are exact in any order.

Defined results: null and empty texts and texts without a word have no features, weight 0 and are not drawn; a null id draws
its noise from the empty string and comes last among equal scores; repeated rows count, are scored and are drawn each on
its own; without target texts the gains hold the target to be uniform; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: monotonically_increasing_id() counts a partition's rows in its lower bits and partitions above them.
_PLACE_BITS = 33


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def ngrams(found: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by a space."""

    def of_length(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(found) - (n - 1), F.lit(1)))
        some = F.transform(at, lambda i: F.array_join(F.slice(found, i, n), " "))
        return F.when(F.size(found) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.concat(found, *(of_length(n) for n in range(2, longest + 1))) if longest > 1 else found


def bucketed(texts: DataFrame, buckets: int, longest: int, text_col: str, *kept: Column) -> DataFrame:
    """The kept columns, n_words and the bucket numbers of a text's n-grams, repeats and all."""
    found = texts.select(*kept, words(F.col(text_col)).alias("_words"))
    numbers = F.transform(ngrams(F.col("_words"), longest), lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))
    others = [c for c in found.columns if c != "_words"]
    return found.select(*others, F.size("_words").cast("long").alias("n_words"), numbers.alias("buckets"))


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """Of each bucket that occurs in raw: floor(1000 ln of its target probability over its raw one), both smoothed by one."""
    counted = staged(_counts(raw, "s").join(_counts(target, "t"), "bucket", "full").na.fill(0, ["s", "t"]), "bucket-counts")
    total = counted.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1.0) * F.lit(float(total["s"] + buckets)) / ((s + 1.0) * F.lit(float(total["t"] + buckets)))
    return counted.where("s > 0").select("bucket", F.floor(F.log(ratio) * 1000.0).cast("long").alias("gain"))


def noise(id_text: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of a hash of the id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))).cast("binary"), 256), 1, 8)
    even = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.log(-F.log(even)) * -1000.0).cast("long")


def weighed(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per row: row, doc_id, n_words, n_features, weight and score."""
    raw = staged(bucketed(documents, buckets, longest, text_col, F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id")), "buckets")
    held = F.broadcast(gains(raw, bucketed(target, buckets, longest, target_col), buckets))
    each = raw.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    sums = each.join(held, "bucket", "left").groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    return sums.withColumn("weight", mean).withColumn("score", F.col("weight") + noise(F.col("doc_id").cast("string"), seed)).drop("total")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (as from weighed()) with rank: 1, 2, 3.. for the drawn share of the rows with enough words, null for the rest."""
    fit = F.col("n_words") >= least_words
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    places = staged(scored.withColumn("fit", fit).sort(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    placed = places.withColumn("part", F.shiftright("at", _PLACE_BITS)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    # one row a partition of the sort: the window and the broadcast grow with partitions, not with rows
    before, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("fit").cast("long")).alias("n_fit"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n_fit").over(whole).alias("fits"))
    rank = F.col("base") + F.col("at") + 1
    taken = F.col("fit") & (rank <= F.expr(f"({percent} * fits) div 100"))
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.when(taken, rank)).drop("part", "at", "base", "fits", "fit")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every document's row, doc_id, n_words, n_features, weight, score and rank."""
    return drawn(weighed(documents, target, buckets, longest, seed, id_col, text_col, target_col), percent, least_words)


def digest(ranked: DataFrame) -> DataFrame:
    """The contract's columns from resample()."""
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")
