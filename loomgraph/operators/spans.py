"""Token spans, lookups through them, intervals and runs."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ROWS, shared_checkpoint, shuffled, tasks_for

#: Spans of a stretch that is swept in one task.
BOUND = 100_000


def span_runs(spans: DataFrame, order: str = "pos", value: str = "coref", start: str = "start_token", end: str = "end_token", by: list[str] = [], bound: int = BOUND) -> DataFrame:
    """(by, lo, hi, value): maximal runs of tokens with the same value, by spans with both ends included; of overlapping
    spans the last in the order counts.

    Rows follow the spans, not their tokens. Positions are cut into stretches of about `bound` spans; in each the begins
    and ends are swept in order, with a heap of the spans that are open. Runs that meet at the stretches' borders are joined.
    """
    live = spans.where(F.col(start) <= F.col(end))
    # Of spans over the same tokens the last counts.
    own = live.groupBy(*by, F.col(start).cast("long").alias("lo"), F.col(end).cast("long").alias("hi")).agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("value"))).alias("_s"))
    own = shared_checkpoint(own.select(*by, "lo", "hi", F.col("_s.o").alias("o"), F.col("_s.value").alias("value")))
    stretches = max(1, -(-own.count() // bound))
    # One number for each stretch.
    cuts = sorted({int(x) for x in own.approxQuantile("lo", [k / stretches for k in range(1, stretches)], 0.1 / stretches)}) if stretches > 1 else []
    kinds = dict(own.dtypes)
    held = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    at = lambda c: F.size(F.filter(held, lambda x: x <= F.col(c)))
    dealt = own.withColumn("_stretch", F.explode(F.sequence(at("lo"), at("hi")))) if cuts else own.withColumn("_stretch", F.lit(0))
    edges = [None, *cuts, None]
    names = [*by, "lo", "hi", "value", "_first", "_last"]

    def sweep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = edges[key[-1]], edges[key[-1] + 1]
        found = swept(rows["lo"].tolist(), rows["hi"].tolist(), rows["o"].tolist(), rows["value"].tolist(), low, high)
        return pd.DataFrame({**{k: [v] * len(found) for k, v in zip(by, key)}, "lo": [r[0] for r in found], "hi": [r[1] for r in found], "value": pd.Series([r[2] for r in found], dtype=rows["value"].dtype if len(found) else None), "_first": [low is not None and r[0] == low for r in found], "_last": [high is not None and r[1] == high - 1 for r in found]})[names]

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "lo long, hi long", f"value {kinds['value']}", "_first boolean, _last boolean"])
    runs = dealt.groupBy(*by, "_stretch").applyInPandas(sweep, schema)
    if not cuts:
        return runs.select(*by, "lo", "hi", F.col("value").alias(value))
    runs = shared_checkpoint(runs)
    # A few runs for each stretch: those that touch a border.
    border = runs.where("_first or _last")
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy("lo")
    joins = (F.lag("hi").over(window) == F.col("lo") - 1) & F.lag("value").over(window).eqNullSafe(F.col("value"))
    marked = border.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(window))
    merged = marked.groupBy(*by, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("value").alias("value")).drop("_g")
    return runs.where("not _first and not _last").drop("_first", "_last").unionByName(merged).select(*by, "lo", "hi", F.col("value").alias(value))


def swept(lo: list, hi: list, order: list, value: list, low: int | None = None, high: int | None = None) -> list[tuple]:
    """(lo, hi, value) of maximal runs, in order, between low and below high if they are given."""
    begins = sorted(range(len(lo)), key=lo.__getitem__)
    # The last in the order is on top; spans that have ended leave when they come up.
    ranks = {i: -k for k, i in enumerate(sorted(range(len(lo)), key=lambda i: (order[i], lo[i], hi[i])))}
    heap: list[tuple[int, int]] = []
    out: list[list] = []
    at, k = None, 0
    while k < len(begins) or heap:
        if not heap:
            at = lo[begins[k]]
        while k < len(begins) and lo[begins[k]] <= at:
            heapq.heappush(heap, (ranks[begins[k]], begins[k]))
            k += 1
        while heap and hi[heap[0][1]] < at:
            heapq.heappop(heap)
        if not heap:
            continue
        top = heap[0][1]
        until = min(hi[top], lo[begins[k]] - 1) if k < len(begins) else hi[top]
        if out and out[-1][1] == at - 1 and out[-1][2] == value[top]:
            out[-1][1] = until
        else:
            out.append([at, until, value[top]])
        at = until + 1
    clipped = ((a if low is None else max(a, low), b if high is None else min(b, high - 1), v) for a, b, v in out)
    return [r for r in clipped if r[0] <= r[1]]


def span_token_map(spans: DataFrame, order: str = "pos", value: str = "coref", start: str = "start_token", end: str = "end_token", by: list[str] = []) -> DataFrame:
    """(by, token_id, value) for every token of every span, both ends included; of overlapping spans the last counts.

    A row for each token: tokens that are at hand are looked up in span_runs() by values_at() instead.
    """
    return span_runs(spans, order, value, start, end, by).select(*by, F.explode(F.sequence("lo", "hi")).alias("token_id"), value)


def values_at(tokens: DataFrame, runs: DataFrame, at: str = "token_id") -> DataFrame:
    """tokens with the value of the run (lo, hi, ...) that each is in; those in none are left out."""
    return interval_join(tokens, shuffled(runs), at, "lo", "hi").drop("lo", "hi")


def mentions_in_sentences(spans: DataFrame, tokens: DataFrame, order: str | None = None) -> DataFrame:
    """(coref, sentence_id) of spans by the sentence of their first token.

    Of rows with equal token ids the last counts: the one with the greatest `order`, a column of tokens. Without one token ids
    must be unique; of equal ones the greatest sentence is taken then.
    """
    last = F.max("sentence_id") if order is None else F.max_by("sentence_id", order)
    sentence = tokens.groupBy(F.col("token_id").alias("start_token")).agg(last.alias("sentence_id"))
    return spans.join(shuffled(sentence), "start_token").select("coref", "sentence_id")


def coref_to_canonical(summary: DataFrame, order: str = "canonical_id") -> DataFrame:
    """(coref, canonical_id, fullname) from exploded original_ids of entities with a score; of equal ids the last row counts."""
    rows = summary.where("avg_score <> 0").select("canonical_id", "fullname", F.col(order).alias("_o"), F.explode("original_ids").alias("coref"))
    return rows.groupBy("coref").agg(F.max_by("canonical_id", "_o").alias("canonical_id"), F.max_by("fullname", "_o").alias("fullname"))


def ids_to_corefs(triples: DataFrame, token_map: DataFrame, ids: str, key: str) -> DataFrame:
    """(key, corefs): distinct values of each row's token ids, in the order of the lowest token id that has them; [] if none.

    token_map has a row for each token (token_id, coref) or for each run of tokens (lo, hi, coref).
    """
    rows = triples.select(key, F.explode(ids).alias("token_id"))
    rows = values_at(rows, token_map) if "lo" in token_map.columns else rows.join(shuffled(token_map), "token_id")
    first = rows.groupBy(key, "coref").agg(F.min("token_id").alias("t"))
    listed = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "coref"))), lambda r: r["coref"]).alias("corefs"))
    return triples.select(key).distinct().join(shuffled(listed), key, "left").withColumn("corefs", F.coalesce("corefs", F.array().cast(listed.schema["corefs"].dataType)))


def first_canonical(rows: DataFrame, lookup: DataFrame, ids: str, key: str) -> DataFrame:
    """(key, canonical_id, fullname) of the first id in each list that the lookup (coref, canonical_id, fullname) has."""
    listed = rows.select(key, F.posexplode(ids).alias("p", "coref")).join(lookup, "coref")
    return listed.groupBy(key).agg(F.min_by("canonical_id", "p").alias("canonical_id"), F.min_by("fullname", "p").alias("fullname"))


def lookup_gender(rows: DataFrame, names: DataFrame, column: str = "fullname") -> DataFrame:
    """rows with gender by full name, null if unknown; of equal names the last row (by `row`) counts."""
    known = names.groupBy(F.col("fullname").alias("_f")).agg(F.max_by("gender", "row").alias("gender"))
    return rows.join(known, F.col(column) == F.col("_f"), "left").drop("_f")


def islands(rows: DataFrame, ids: str, keys: list[str]) -> DataFrame:
    """Runs of consecutive numbers of each row's sorted distinct ids: (keys, run, ids, start, stop), offsets with stop exclusive.

    An empty or null list gives one empty run.
    """
    listed = rows.select(*keys, F.posexplode_outer(F.array_sort(F.array_distinct(ids))).alias("p", "id"))
    runs = listed.withColumn("_g", F.col("id") - F.col("p")).groupBy(*keys, "_g").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.coalesce(F.min("p"), F.lit(0)).alias("start"), F.coalesce(F.max("p") + 1, F.lit(0)).alias("stop"))
    return runs.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("start")) - 1).drop("_g")


def runs_of_rows(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, first, last, n): runs of consecutive distinct positions among rows."""
    own = df.select(*keys, position).distinct()
    marked = own.withColumn("_g", F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position)))
    return marked.groupBy(*keys, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_g")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, lo: str, hi: str) -> DataFrame:
    """Points joined with the intervals that hold them, both ends included; intervals may overlap and leave gaps.

    A hierarchy of stretches: those of level k are 4^k wide. Each interval is listed under the few stretches that it meets at
    the level of its own length, so a long one costs no more than a short one; a point looks up its stretch at
    every level that intervals have. The join is on equal stretches and shuffles like any other.
    """
    live = intervals.where(F.col(lo) <= F.col(hi))
    level = F.floor(F.log(4.0, (F.col(hi) - F.col(lo) + 1).cast("double")) + 1e-9).cast("int")
    live = live.withColumn("_level", F.greatest(level, F.lit(0)))
    # At most 32 numbers.
    levels = sorted(r[0] for r in live.select("_level").distinct().collect())
    width = F.pow(F.lit(4.0), F.col("_level"))
    stretch = lambda c: F.floor(F.col(c) / width).cast("long")
    listed = live.withColumn("_stretch", F.explode(F.sequence(stretch(lo), stretch(hi))))
    placed = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_stretch", stretch(at))
    return placed.join(listed, ["_level", "_stretch"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_level", "_stretch")


def heads_in_sentence(tokens: DataFrame, each: int = ROWS) -> DataFrame:
    """tokens with place (from 0, within the sentence) and head_place; heads outside the sentence drop their row. Tasks have about
    `each` tokens."""
    tasks, keys = tasks_for(tokens.sparkSession, tokens.count(), each), ["sentence_id", "head_id"]
    placed = tokens.repartition(tasks, "sentence_id").withColumn("place", F.row_number().over(Window.partitionBy("sentence_id").orderBy("token_id")) - 1)
    head = placed.select(F.col("sentence_id"), F.col("token_id").alias("head_id"), F.col("place").alias("head_place"))
    return placed.repartition(tasks, *keys).join(shuffled(head.repartition(tasks, *keys)), keys)


