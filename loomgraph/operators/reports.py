"""Counts and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def distinct_over(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n): distinct values of several columns taken together."""
    return df.select(F.explode(F.array(*columns)).alias("v")).agg(F.countDistinct("v").alias("n"))


def statistics(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: n, and for each condition how many rows meet it and their share."""
    out = [F.count("*").alias("n")]
    for name, condition in conditions.items():
        out += [F.count_if(condition).alias(name), F.avg(F.coalesce(condition, F.lit(False)).cast("int")).alias(f"{name}_share")]
    return df.agg(*out)
