"""Joins of texts that are alike by the token-sort ratio, through an inverted index.

The ratio of texts of n and m characters with a longest common subsequence of L is 2 L / (n + m). Characters of the subsequence
that follow each other are at most n + m - 2 L places apart in both texts together, ends of the texts included, so at
least L + 1 - (n + m - 2 L) / (g + 1) such pairs have gaps of g or less: both texts hold them as gapped pairs, which are
what is indexed. A text's pairs are put in order of how rare they are; of those that two texts must share, some two are
within the first of either (a prefix filter on two tokens), so keys are twos of a text's first pairs. Lengths, and how
often texts have characters, exclude more candidates; the others are aligned.

The index pays where alike texts are rare: at a ratio of 0.9 a text shares keys with few others, at 0.6 short names share
keys with most. How many rows the keys would join is counted first; where that is more than comparing the texts costs,
blocks of either side are compared instead, each pair of blocks a task that aligns a text with all of the other block in
step, a bit for each character, and gives its matches only. Either way gives the same rows. A query that asks for its k
best looks for near texts first, where the index pays, and only those that haven't got k yet go on. Nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint

#: Ratios that are looked for first, in turn, by queries without enough matches.
LADDER = (0.9, 0.8)
#: Up to so many pairs of texts are compared in blocks without asking what the index would cost.
FEW = 50_000_000
#: A row of the index's join costs as much as comparing so many pairs.
ROW_COST = 10
#: Texts of a block, and the longest ones that are laid out side by side there.
BLOCK, LONG = 2000, 256
#: Texts of up to so many characters are aligned many at once.
WIDE = 64
_BEGIN, _END = "\u0002", "\u0003"


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & whole
    return len(a) - v.bit_count()


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def ratio(a: str, b: str) -> float:
    """The token-sort ratio of two texts whose words are sorted already."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(a, b) / total


def characters(texts: list[str]) -> np.ndarray:
    """How often each text has characters of 64 kinds: what two texts share of them bounds their common subsequence."""
    out = np.zeros((len(texts), 64), np.int32)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 63
    np.add.at(out.reshape(-1), np.repeat(np.arange(len(texts)), [len(t) for t in texts]) * 64 + codes, 1)
    return out


def _codes(texts: list[str], fill: int) -> np.ndarray:
    """Characters of texts of up to WIDE, one text a row."""
    out = np.full((len(texts), WIDE), fill, np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    out[np.arange(WIDE) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """lcs() of pairs of texts, those of up to WIDE characters in step with each other."""
    out = np.zeros(len(a), np.int64)
    short = np.array([len(x) <= WIDE and len(y) <= WIDE for x, y in zip(a, b)], bool)
    for i in np.flatnonzero(~short).tolist():
        out[i] = lcs(a[i], b[i])
    some = np.flatnonzero(short)
    if len(some):
        left, right = _codes([a[i] for i in some.tolist()], 0xFFFFFFFF), _codes([b[i] for i in some.tolist()], 0xFFFFFFFE)
        v = np.full(len(some), 0xFFFFFFFFFFFFFFFF, np.uint64)
        with np.errstate(over="ignore"):
            for t in range(max(len(b[i]) for i in some.tolist())):
                met = np.packbits(left == right[:, t : t + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
                u = v & met
                v = (v + u) | (v - u)
        sizes = np.array([len(a[i]) for i in some.tolist()], np.uint64)
        mask = np.where(sizes >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(sizes, np.uint64(63))) - np.uint64(1))
        out[some] = sizes.astype(np.int64) - np.bitwise_count(v & mask).astype(np.int64)
    return out


def gap_of(least: float) -> int:
    """The widest gap that pairs may have so that texts with this ratio share two at least."""
    gap = 0
    while (gap + 1) * least <= 2 * (1 - least) + 1e-9:
        gap += 1
    return gap


def shared_pairs(length: int, least: float) -> int:
    """Gapped pairs that a text of this length shares with any other of the ratio `least` or more: two or more."""
    share = least / 2 - (1 - least) / (gap_of(least) + 1)
    return math.ceil(1 + 2 * length / (2 - least) * share - 1e-9)


def gapped_pairs(text: str, gap: int) -> list[str]:
    """Pairs of characters up to `gap` apart, the text's ends among them, each numbered among its equals."""
    whole = _BEGIN + text + _END
    times: dict[str, int] = {}
    out = []
    for d in range(1, gap + 2):
        for x, y in zip(whole, whole[d:]):
            times[x + y] = n = times.get(x + y, 0) + 1
            out.append(f"{x}{y}{n}")
    return out


def _prepared(names: DataFrame) -> DataFrame:
    """(id, name, text) of names(name), each once, with its words in order; names without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted_words(n) for n in own], pa.string())], names=["name", "text"])

    rows = names.where("name is not null").distinct().mapInArrow(run, "name string, text string").where("text <> ''")
    return shared_checkpoint(rows.withColumn("id", F.monotonically_increasing_id()))


def _pairs_of(texts: DataFrame, least: float) -> DataFrame:
    """(id, n, kept, pair): gapped pairs of every text, and how many of the rarest make its keys."""
    gap = gap_of(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text in zip(*[c.to_pylist() for c in batch.columns]):
                pairs = gapped_pairs(text, gap)
                kept = min(len(pairs), len(pairs) - shared_pairs(len(text), least) + 2)
                yield pa.RecordBatch.from_arrays([pa.array([id_] * len(pairs)), pa.array([len(text)] * len(pairs), pa.int32()), pa.array([kept] * len(pairs), pa.int32()), pa.array(pairs)], names=["id", "n", "kept", "pair"])

    return texts.select("id", "text").mapInArrow(run, "id long, n int, kept int, pair string")


def _keys(pairs: DataFrame, times: DataFrame) -> DataFrame:
    """(key, id, n): twos of each text's rarest pairs."""
    counted = pairs.join(times, "pair", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "pair")))
    first = counted.groupBy("id", "n", "kept").agg(order.alias("all")).select("id", "n", F.slice(F.col("all.pair"), F.lit(1), F.col("kept")).alias("first"))
    one = first.select("id", "n", "first", F.posexplode("first").alias("p", "x"))
    two = one.select("id", "n", "x", F.explode(F.slice("first", F.col("p") + 2, F.greatest(F.size("first") - F.col("p") - 1, F.lit(0)))).alias("y"))
    return two.select(F.xxhash64("x", "y").alias("key"), "id", "n")


def _scored(pairs: DataFrame, least: float) -> DataFrame:
    """(query, variant, score) of pairs(query, a, variant, b) with the ratio `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, a, variant, b = (c.to_pylist() for c in batch.columns)
            total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
            shared = np.minimum(characters(a), characters(b)).sum(axis=1) if len(a) else total
            some = np.flatnonzero(2 * shared >= least * total - 1e-6).tolist()
            score = 200.0 * lcs_many([a[i] for i in some], [b[i] for i in some]) / np.maximum(total[some], 1)
            kept = [(i, s) for i, s in zip(some, score.tolist()) if s >= 100 * least]
            yield pa.RecordBatch.from_arrays([pa.array([query[i] for i, _ in kept], pa.string()), pa.array([variant[i] for i, _ in kept], pa.string()), pa.array([s for _, s in kept], pa.float64())], names=["query", "variant", "score"])

    return pairs.select("query", "a", "variant", "b").mapInArrow(run, "query string, variant string, score double")


class _Met:
    """left and right, both (id, name, text), and what the index would join at a ratio."""

    def __init__(self, left: DataFrame, right: DataFrame, least: float):
        self.left, self.right, self.least = left, right, least
        other = shared_checkpoint(_pairs_of(right, least))
        times = other.groupBy("pair").agg(F.count("*").alias("times"))
        self.a, self.b = _keys(_pairs_of(left, least), times), _keys(other, times)

    def rows(self) -> int:
        count = lambda keys, name: keys.groupBy("key").agg(F.count("*").alias(name))
        return count(self.a, "m").join(count(self.b, "n"), "key").agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0

    def scored(self) -> DataFrame:
        a, b, least = self.a.select("key", F.col("id").alias("a"), F.col("n").alias("n_a")), self.b.select("key", F.col("id").alias("b"), F.col("n").alias("n_b")), self.least
        met = a.join(b, "key")
        # The subsequence is no longer than the shorter text.
        met = met.where(2 * F.least("n_a", "n_b") >= least * (F.col("n_a") + F.col("n_b")) - 1e-6).select("a", "b").distinct()
        with_a = met.join(self.left.select(F.col("id").alias("a"), F.col("name").alias("query"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(self.right.select(F.col("id").alias("b"), F.col("name").alias("variant"), F.col("text").alias("text_b")), "b")
        return _scored(with_b.select("query", F.col("text_a").alias("a"), "variant", F.col("text_b").alias("b")), least)


def by_index(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """alike() by the index, whatever it costs."""
    return _Met(left, right, least).scored()


def lcs_with_all(text: str, codes: np.ndarray, number: dict[str, int]) -> np.ndarray:
    """lcs() of a text of up to WIDE characters with each row of codes; characters that no row has are not numbered."""
    masks = np.zeros(len(number) + 1, np.uint64)
    for i, c in enumerate(text):
        if c in number:
            masks[number[c]] |= np.uint64(1 << i)
    v = np.full(len(codes), 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for met in masks[codes].T:
            u = v & met
            v = (v + u) | (v - u)
    return len(text) - np.bitwise_count(v & np.uint64((1 << len(text)) - 1)).astype(np.int64)


def _compared(a: list[str], b: list[str], least: float) -> tuple[list[int], list[int], list[float]]:
    """(i, j, score) of all pairs with the ratio `least` or more."""
    number = {c: k for k, c in enumerate(sorted(set("".join(b))), 1)}
    short = np.array([k for k, x in enumerate(b) if len(x) <= LONG], np.int64)
    codes = np.zeros((len(short), max((len(b[k]) for k in short.tolist()), default=0)), np.int64)
    for row, k in enumerate(short.tolist()):
        codes[row, : len(b[k])] = [number[c] for c in b[k]]
    sizes, rest = np.array([len(b[k]) for k in short.tolist()], np.int64), [k for k, x in enumerate(b) if len(x) > LONG]
    i, j, score = [], [], []
    for k, text in enumerate(a):
        if len(text) <= WIDE and len(short):
            found = 200.0 * lcs_with_all(text, codes, number) / (len(text) + sizes)
            good = np.flatnonzero(found >= 100 * least)
            i += [k] * len(good)
            j += short[good].tolist()
            score += found[good].tolist()
        for other in rest if len(text) <= WIDE else range(len(b)):
            if 2 * min(len(text), len(b[other])) >= least * (len(text) + len(b[other])) - 1e-6 and (s := ratio(text, b[other])) >= 100 * least:
                i.append(k)
                j.append(other)
                score.append(s)
    return i, j, score


def by_blocks(left: DataFrame, right: DataFrame, least: float, sizes: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """alike() by comparing blocks; sizes are the rows of left and right."""
    counts = [max(1, -(-n // block)) for n in sizes]
    own = [F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") for n in counts]
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in counts]
    rows = left.select(own[0].alias("_l"), every[1].alias("_r"), F.lit(True).alias("asks"), "name", "text").unionByName(right.select(every[0].alias("_l"), own[1].alias("_r"), F.lit(False).alias("asks"), "name", "text"))

    def task(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy(bool)
        (names, a), (others, b) = ((part["name"][side].tolist(), part["text"][side].tolist()) for side in (asks, ~asks))
        i, j, score = _compared(a, b, least)
        return pd.DataFrame({"query": pd.Series([names[k] for k in i], dtype=object), "variant": pd.Series([others[k] for k in j], dtype=object), "score": pd.Series(score, dtype=float)})

    return rows.groupBy("_l", "_r").applyInPandas(task, "query string, variant string, score double")


def alike(left: DataFrame, right: DataFrame, least: float, few: int = FEW) -> DataFrame:
    """(query, variant, score) of all texts of left and right, both (id, name, text), with the ratio `least` (over 0, up to 1) or
    more, by the index or by blocks, whichever costs less."""
    sizes = (left.count(), right.count())
    if sizes[0] * sizes[1] > few:
        met = _Met(left, right, least)
        if met.rows() * ROW_COST < sizes[0] * sizes[1]:
            return met.scored()
    return by_blocks(left, right, least, sizes)


def top(queries: DataFrame, variants: DataFrame, k: int, threshold: float, few: int = FEW) -> DataFrame:
    """(query, variant, score, place) of the k best variants(variant, id_order) of each query at or above the threshold.

    Ties go to the least id_order, then by text. Threshold: over 0, up to 100. Names without a word match nothing.
    """
    if not 0 < threshold <= 100:
        raise ValueError(f"no ratio to look for: {threshold}")
    least = threshold / 100
    right = _prepared(variants.select(F.col("variant").alias("name")))
    left = _prepared(queries.select(F.col("query").alias("name")))
    size = right.count()
    window = Window.partitionBy("query").orderBy(F.desc("score"), "id_order", "variant")
    best = lambda found: found.join(variants, "variant").withColumn("place", F.row_number().over(window)).where(F.col("place") <= k).select("query", "variant", "score", "place")
    out = None
    for step in (x for x in LADDER if x > least):
        pairs = left.count() * size
        met = _Met(left, right, step) if pairs > few else None
        if met is None or met.rows() * ROW_COST >= pairs:
            break
        found = shared_checkpoint(best(met.scored()))
        full = found.where(F.col("place") == k).select(F.col("query").alias("name"))
        done = found.join(full.withColumnRenamed("name", "query"), "query", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = shared_checkpoint(left.join(full, "name", "left_anti"))
    last = best(alike(left, right, least, few))
    return last if out is None else out.unionByName(last)
