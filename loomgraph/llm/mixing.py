"""Mixing sources by temperature.

A source's share of all tokens, to the power of an exponent between 0 and 1, gives its weight. The exponent is found
by bisection: the largest whose weights have the asked entropy, raised where a source would be repeated more often
than allowed. A token budget times the weights gives each source's quota: whole passes over its documents, and for
the rest a part of a permutation. Documents are dealt to blocks by a hash of their ids and blocks are put in an order
by hash; blocks are taken until the quota is met, and within the last one documents in the order of their hashes.

The mixture is in an order, too: every pass over a block is an entry of its own, with a place by hash among the entries
of all sources, and documents follow each other in the order of their hashes within an entry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by

#: Token counts of up to so many sources are collected; those of more are summed where they are.
MAX_SOURCES = 100_000
#: Tokens of a block, or more in sources that would have over MAX_BLOCKS.
BLOCK_TOKENS, MAX_BLOCKS = 200_000, 1 << 16
STEPS = 60
_WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def n_tokens(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raw) for r in raw]


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def repeats(tokens: list[int], shares: list[float], budget: float | None) -> list[float]:
    """Passes over each source. A budget of None is the least one that passes every source once."""
    rate = [s / t if t else 0.0 for s, t in zip(shares, tokens)]
    budget = 1 / min(r for r in rate if r) if budget is None else budget
    return [budget * r for r in rate]


class _Sizes:
    """Token counts of sources: what exponents are found from."""

    def __init__(self, tokens: list[int]):
        self.tokens = [t for t in tokens if t]
        self.live, self.total = len(self.tokens), sum(self.tokens)
        self.least, self.most = min(self.tokens, default=0), max(self.tokens, default=0)

    def sums(self, e: float) -> tuple[float, float]:
        """Of shares to the power of e: their sum, and that of them times the logarithms of the shares."""
        shares = [t / self.total for t in self.tokens]
        return math.fsum(s**e for s in shares), math.fsum(s**e * math.log(s) for s in shares)


class _TableSizes(_Sizes):
    """The same from a table (source, n) of any length: two sums for each exponent that is tried."""

    def __init__(self, sizes: DataFrame):
        self.sizes = sizes.where("n > 0")
        row = self.sizes.agg(F.count("*"), F.sum("n"), F.min("n"), F.max("n")).first()
        self.live, self.total, self.least, self.most = row[0], row[1] or 0, row[2] or 0, row[3] or 0

    def sums(self, e: float) -> tuple[float, float]:
        share = F.col("n") / float(self.total)
        return tuple(self.sizes.agg(F.sum(F.pow(share, F.lit(e))), F.sum(F.pow(share, F.lit(e)) * F.log(share))).first())


def _entropy(sizes: _Sizes, e: float) -> float:
    z, logs = sizes.sums(e)
    return math.log(z) - e * logs / z


def _most_repeats(sizes: _Sizes, e: float, budget: float | None) -> float:
    """Passes over the smallest source, which is passed most often."""
    z, _ = sizes.sums(e)
    rate = lambda t: (t / sizes.total) ** e / z / t
    return (1 / rate(sizes.most) if budget is None else budget) * rate(sizes.least)


def exponent(tokens: list[int], target: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The largest exponent in [0, 1] with weights of `target` times the greatest possible entropy, or as much larger as
    `max_repeats` asks. 1 keeps the sources' own shares, 0 makes them alike."""
    return _exponent(_Sizes(tokens), target, max_repeats, budget)


def _exponent(sizes: _Sizes, target: float | None, max_repeats: float | None, budget: float | None) -> float:
    if sizes.live < 2:
        return 1.0

    def bisect(good) -> float:
        """The largest value in [0, 1] at which `good` holds, given that it holds from 0 up to there."""
        low, high = 0.0, 1.0
        if good(high):
            return high
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    found = 0.0 if target is None else bisect(lambda e: _entropy(sizes, e) >= target * math.log(sizes.live))
    if max_repeats is not None:
        fits = lambda e: _most_repeats(sizes, e, budget) <= max_repeats
        if not fits(found):
            # Repeats fall as the exponent grows; at 1 all are alike.
            found = max(found, 1 - bisect(lambda d: fits(1 - d)))
    return found


def _counted(docs: DataFrame, seed: str, id_col: str, source_col: str, *more: Column) -> DataFrame:
    """key, source and what else is asked for, of each row: rows without an id go by their texts."""
    own = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    return docs.select(F.md5(F.concat(F.lit(seed + ":"), own).cast("binary")).alias("key"), source.alias("source"), *more)


def _place(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


class _Quotas:
    """What is asked of every source: (source, n, weight, whole, rest, blocks)."""

    def __init__(self, counted: DataFrame, target: float | None, max_repeats: float | None, budget: float | None | str, block_tokens: int):
        sizes = cut(counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")))
        some = sizes.select("n").limit(MAX_SOURCES + 1).collect()
        own = _Sizes([r.n for r in some]) if len(some) <= MAX_SOURCES else _TableSizes(sizes)
        asked = float(own.total) if budget == "total" else budget
        if own.total:
            e = _exponent(own, target, max_repeats, asked)
            z, _ = own.sums(e)
            # A budget of None passes the largest source once.
            asked = 1 / ((own.most / own.total) ** e / z / own.most) if asked is None else asked
            if max_repeats is not None and (most := _most_repeats(own, e, asked)) > max_repeats * (1 + 1e-9):
                raise ValueError(f"whatever the exponent, some source is passed {most:g} times, not {max_repeats:g} at most: the budget is too large")
            weight = F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(float(own.total)), F.lit(e)) / z).otherwise(0.0)
        else:
            weight = F.lit(0.0)
        passes = F.when(F.col("n") > 0, F.lit(float(asked or 0)) * (F.col("weight") / F.col("n"))).otherwise(1.0)
        rows = sizes.withColumn("weight", weight).withColumn("p", passes).withColumn("whole", F.floor(F.col("p") + 1e-9).cast("long"))
        rest = F.when(F.col("n") > 0, F.greatest(F.bround((F.col("p") - F.col("whole")) * F.col("n")).cast("long"), F.lit(0))).otherwise(0).cast("long")
        blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n") / block_tokens))).cast("long")
        self.table = cut(rows.select("source", "rows", "weight", "whole", rest.alias("rest"), blocks.alias("blocks")))
        self.few = len(some) <= MAX_SOURCES

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows(key, source, ...) with the weight, whole, rest and block of each."""
        # At most MAX_SOURCES rows are broadcast; of more, those of sources with very many rows.
        found = rows.join(F.broadcast(self.table), "source") if self.few else join_by(rows, self.table, ["source"], "rows")
        return found.withColumn("block", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("blocks")).drop("blocks", "rows")

    def marks(self, counted: DataFrame, seed: str) -> DataFrame:
        """(source, block, before, size, last): tokens of the blocks before it in the permutation, its own, and the key up to
        which its documents are within the rest of the quota, if the quota ends in it."""
        dealt = self.dealt(counted)
        blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.any_value("rest").alias("rest"))
        # At most MAX_BLOCKS rows for each source.
        order = Window.partitionBy("source").orderBy(_place(seed, F.col("source"), F.col("block").cast("string")), "block")
        blocks = cut(blocks.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
        # The quota of a source ends in one block: only there documents are put in order, those of one id together.
        border = blocks.where("before < rest and before + size >= rest").select("source", "block", "before")
        ends = dealt.join(border, ["source", "block"]).groupBy("source", "block", "key").agg(F.sum("n_tokens").alias("n"), F.any_value("before").alias("before"), F.any_value("rest").alias("rest"))
        inside = F.coalesce(F.sum("n").over(Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = ends.withColumn("inside", inside).where("before + inside < rest").groupBy("source", "block").agg(F.max("key").alias("last"))
        return cut(blocks.drop("rest").join(last, ["source", "block"], "left"))


#: Passes of a row, given its key and what its block has.
_COPIES = "whole + case when before + size < rest then 1 when before >= rest then 0 when key <= last then 1 else 0 end"


def plan(docs: DataFrame, target: float | None = 0.95, max_repeats: float | None = 4.0, budget: float | None | str = "total", seed: str = "mix", block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, n_tokens, weight, block, copies (how often the mixture has it) and place.

    `place` orders the blocks' first passes in the mixture. A null source is a source named by the empty text. Sources
    without tokens have weight 0 and their documents one copy. Rows with equal ids fall in one block and have as many
    copies; rows without an id go by their texts. Null and empty texts have no tokens; texts of any length are counted
    whole; an empty table gives no rows; columns besides the id, text and source are not looked at. `budget` is in
    tokens: "total" is what docs have, None the least that passes every source once. ValueError if the budget asks for
    more passes than `max_repeats`, whatever the exponent.
    """
    # Texts are read once; all else works on ids and counts.
    counted = cut(_counted(docs, seed, id_col, source_col, F.col(f"`{id_col}`").alias("doc_id"), n_tokens(F.col("text")).alias("n_tokens")))
    quotas = _Quotas(counted, target, max_repeats, budget, block_tokens)
    found = quotas.dealt(counted).join(quotas.marks(counted, seed), ["source", "block"])
    place = F.conv(F.substring(_place(seed, F.col("source"), F.col("block").cast("string"), F.lit("1")), 1, 15), 16, 10).cast("long")
    return found.select("doc_id", "source", "n_tokens", "weight", "block", F.expr(_COPIES).alias("copies"), place.alias("place"))


def realise(docs: DataFrame, id_col: str = "doc_id", target: float | None = 0.95, max_repeats: float | None = 4.0, budget: float | None | str = "total", seed: str = "mix", block_tokens: int = BLOCK_TOKENS, source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as plan() says, with their columns, in the order of the mixture.

    Entries (passes over blocks) are dealt to partitions by hash, and are in the order of their places within each. Columns
    may have any names. What holds of odd rows in plan() holds here; an empty table gives no rows.
    """
    counted = cut(_counted(docs, seed, id_col, source_col, n_tokens(F.col("text")).alias("n_tokens")))
    quotas = _Quotas(counted, target, max_repeats, budget, block_tokens)
    rows = quotas.dealt(_counted(docs, seed, id_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    times = rows.join(quotas.marks(counted, seed), ["source", "block"]).withColumn("copies", F.expr(_COPIES)).where("copies > 0")
    entries = times.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    placed = entries.select("key", "row", _place(seed, F.col("source"), F.col("block").cast("string"), F.col("pass").cast("string")).alias("place"))
    return placed.repartition("place").sortWithinPartitions("place", "key").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def sql(target: float = 0.95, max_repeats: float = 4.0, seed: str = "mix", block_tokens: int = BLOCK_TOKENS, table: str = "documents") -> str:
    """plan() with a budget of all tokens, in DuckDB's SQL; weights are rounded to six places."""
    shares = "list_transform(ts, lambda t: pow(t / total, {0}))"
    own = "list_transform({0}, lambda v: v / list_sum({0}))"
    spread = "-list_sum(list_transform({0}, lambda s: s * ln(s)))"
    mixed = own.format("(" + shares + ")")
    good = f"({spread.format(mixed)}) >= {target}::DOUBLE * ln(len(ts))"
    fits = f"list_max(list_transform(list_zip({mixed}, ts), lambda z: z[1] * total / z[2])) <= {max_repeats}::DOUBLE"
    step = "SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, {0} AS ok FROM {1}, live WHERE i < " + str(STEPS) + ")"
    return f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key FROM {table}
), totals AS (SELECT source, sum(n_tokens)::BIGINT AS t FROM counted GROUP BY source),
live AS (SELECT list(t::DOUBLE ORDER BY source) AS ts, sum(t)::DOUBLE AS total FROM totals WHERE t > 0),
first(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL {step.format(good.format("(lo + hi) / 2"), "first")}),
found AS (SELECT CASE WHEN len(ts) < 2 OR {good.format("1.0::DOUBLE")} THEN 1.0 ELSE lo END AS e FROM first, live WHERE i = {STEPS}),
second(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL {step.format(fits.format("1 - (lo + hi) / 2"), "second")}),
chosen AS (SELECT CASE WHEN {fits.format("e")} THEN e ELSE greatest(e, CASE WHEN {fits.format("0.0::DOUBLE")} THEN 0.0 ELSE 1 - lo END) END AS e FROM found, second, live WHERE i = {STEPS}),
weights AS (SELECT list_sum({shares.format("e")}) AS z, e, total FROM live, chosen),
quotas AS (SELECT source, t, CASE WHEN t > 0 THEN pow(t / total, e) / z ELSE 0.0 END AS weight, CASE WHEN t > 0 THEN total * (pow(t / total, e) / z / t) ELSE 0.0 END AS p FROM totals, weights),
shared AS (SELECT source, weight, CASE WHEN t > 0 THEN floor(p + 1e-9)::BIGINT ELSE 1 END AS whole, CASE WHEN t > 0 THEN greatest(0, round_even((p - floor(p + 1e-9)) * t, 0))::BIGINT ELSE 0 END AS rest, least({MAX_BLOCKS}, ceil(t / {block_tokens})::BIGINT) AS b FROM quotas),
dealt AS (SELECT c.*, weight, whole, rest, ('0x' || substr(key, 1, 8))::BIGINT % greatest(b, 1) AS block FROM counted c JOIN shared USING (source)),
sizes AS (SELECT source, block, sum(n_tokens) AS size FROM dealt GROUP BY ALL),
starts AS (SELECT source, block, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('{seed}:' || source || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes),
keyed AS (SELECT source, block, key, sum(n_tokens) AS n FROM dealt GROUP BY ALL),
placed AS (SELECT source, block, key, coalesce(sum(n) OVER (PARTITION BY source, block ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM keyed)
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, block, whole + (before + inside < rest)::BIGINT AS copies,
  ('0x' || substr(md5('{seed}:' || source || ':' || block || ':1'), 1, 15))::BIGINT AS place
FROM dealt JOIN starts USING (source, block) JOIN placed USING (source, block, key)"""
