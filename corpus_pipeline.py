"""A training corpus from `documents`: five stages, each written as Parquet and read again for the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, idcodec, mixing, simhash, toxicity
from loomgraph.llm.common import drop_folder, ensure_checkpoint_dir, read
from loomgraph.llm.queries import tokenizer_path


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half, by a tagger fitted on `labels`."""
    return toxicity.remove(docs, read(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that SimHash fingerprints of five-word shingles join.

    Null and word-less texts are one group; rows with equal ids stay or go together; rows without an id stay.
    """
    return simhash.deduplicate(docs, words=5)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of `benchmark`; an empty benchmark removes none."""
    return decontam.remove(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to 1.5 times on average, towards 0.95 of the greatest entropy.

    A null source is one of its own; sources without a word are kept once.
    """
    return mixing.realise(docs, target=0.95, max_repeats=1.5, budget=None)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary blocks; one row per row of docs, read back from the blocks. Null texts have the end id alone."""
    return idcodec.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_ids),
]

#: Taggers, fingerprints and the range coder have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, in a fresh folder under the shared checkpoint folder.

    All but the last keep the columns of documents, whatever their names. Null and empty texts count as texts without
    words; texts of any length are read whole; ties go to the smaller id; repeated rows are documents with one id. Empty
    tables give no rows. A stage's table is deleted once the next one has been written.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
