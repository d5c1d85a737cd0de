"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pair, decontamination, fill_in_middle, importance_resampling, language_id, media, mixing, near_duplicates, personal_data, quality, sharding, token_output, toxicity
from .common import remainder, table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language_id.predict(documents, language_id.learnt(documents))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.score(documents, toxicity.learnt(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link_documents(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find(table(spark, sf_dir, "documents")))


def op4_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_output.read_tokens(token_output.write_tokens(table(spark, sf_dir, "documents"), tokenizer), with_ids=False).drop("ids")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    if ranks is None or pattern is None:
        import public_tokenizers

        ranks, pattern = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return byte_pair.digest(byte_pair.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transform(table(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.digest(importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_personal_data": op3_personal_data,
    "op4_token_output": op4_token_output,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_mixing": op9_mixing,
    "op10_media": op10_media,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_importance_resampling": op13_importance_resampling,
}
