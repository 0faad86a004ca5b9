"""Readers. All give DataFrames with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file whole, as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_raw_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Tab-separated values without quoting; quotes, backslashes and words like `null` or `nan` are ordinary text."""
    df = spark.read.csv(path, sep="\t", schema=schema, header=header, quote="", escape="", nullValue="\u0000", enforceSchema=True)
    return df.na.fill("")  # the parser takes empty fields for null


def read_tsv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated values with double quotes; only `columns` are parsed if given."""
    df = spark.read.csv(path, sep="\t", schema=schema, header=True, quote='"', escape='"', enforceSchema=True)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str, int_lists: tuple[str, ...] = (), name_lists: tuple[str, ...] = ()) -> DataFrame:
    """Comma-separated values with double quotes doubled inside; the columns named are parsed from list literals."""
    from ..functions.text import int_list, name_list

    df = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True)
    return df.withColumns({c: int_list(c) for c in int_lists} | {c: name_list(c) for c in name_lists})


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    """One row per character of nested JSON documents, with pos, its place in the document's list."""
    df = spark.read.schema(schemas.CHARACTERS).json(path, multiLine=True)
    return df.select(F.input_file_name().alias("path"), F.posexplode("characters").alias("pos", "c")).select("path", "pos", "c.*")
