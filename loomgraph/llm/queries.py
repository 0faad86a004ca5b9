"""The training-data operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontam, idcodec, importance, licenses, lloyd, mixing, ordinal, ppm, secret_scan, simhash, substrings, toxicity
from .common import read


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.groups(read(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The file that op4's contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcodec.round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.summary(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(read(spark, sf_dir, "documents"))


def op11_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_shared(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_cover_tree, op2_simhash, op3_toxicity, op4_token_ids, op5_language, op6_quality, op7_decontamination, op8_secrets, op9_mixing, op10_licenses,
        op11_suffix_automata, op12_importance, op13_dual_tree_lloyd,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree": covertree.ORACLE_SQL, "op9_mixing": mixing.sql(), "op10_licenses": licenses.sql(), "op11_suffix_automata": substrings.ORACLE_SQL, "op12_importance": importance.sql(), "op13_dual_tree_lloyd": lloyd.sql()}
