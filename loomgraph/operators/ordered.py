"""Places in an order over whole tables, whatever holds most of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint

#: A key with more rows than this is dealt to several tasks in chunks().
HEAVY = 100_000


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows with their number in the order, from 0, among those of the same keys.

    Rows are sorted in ranges of keys and order, so a key with very many rows is spread over tasks. A row's number is its
    place in its range less that of its key's first row there, and the key's rows in the ranges before; these
    are counted from one row for each key and range.
    """
    by = [*keys, *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    placed = shared_checkpoint(placed.withColumn("_range", F.shiftright("_id", 33)))
    runs = placed.groupBy(*keys, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_size"))
    # As many rows of a key as there are ranges.
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_size").over(window), F.lit(0))).drop("_size")
    if keys:
        named = {k: f"_key{i}" for i, k in enumerate(keys)}
        same = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
        joined = placed.join(runs.withColumnsRenamed({**named, "_range": "_own"}), [F.col("_range") == F.col("_own"), *same]).drop("_own", *named.values())
    else:
        joined = placed.join(F.broadcast(runs), "_range")  # a row for each range
    return joined.withColumn(name, F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_range", "_first", "_before")


def chunks(rows: DataFrame, keys: list[str], value: str, size: int, heavy: int = HEAVY) -> DataFrame:
    """(keys, chunk, values): each key's values in order, in lists of `size` that are numbered from 0; the last may be shorter.

    Values of keys with up to `heavy` rows are sorted and cut in place, after one shuffle; those of others are numbered by ranges.
    """
    own = rows.select(*keys, value)
    large = shared_checkpoint(own.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy).select(*keys))
    if large.isEmpty():
        return _cut(own, keys, value, size)
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()]
    marks = large.withColumnsRenamed(named)
    placed = numbered(own.join(marks, same, "left_semi"), keys, [value], "_n")
    spread = placed.groupBy(*keys, F.expr(f"_n div {size}").alias("chunk")).agg(F.sort_array(F.collect_list(value)).alias("values"))
    return _cut(own.join(marks, same, "left_anti"), keys, value, size).unionByName(spread)


def _cut(rows: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_all"))
    starts = F.sequence(F.lit(0), F.expr(f"(size(_all) - 1) div {size}"))
    return lists.select(*keys, "_all", F.explode(starts).alias("chunk")).select(*keys, F.col("chunk").cast("long").alias("chunk"), F.slice("_all", (F.col("chunk") * size + 1).cast("int"), size).alias("values"))
