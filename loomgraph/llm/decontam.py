"""Benchmark passages in documents, by the q-gram lemma.

Texts are normalised: lower case, runs of anything but letters and digits as one space. A passage of L characters that
occurs with at most e edits shares at least L - q + 1 - q * e of its q-grams with the place where it occurs, on
diagonals (place in the text less place in the passage) that span at most e + 1. Diagonals are therefore counted in
overlapping bands of 2 (e + 1), one begun every e + 1, for each text by itself; bands with enough q-grams are verified
by banded alignment of the whole passage against that text there, with free ends in the text. Passages are matched
whole; those too short for the lemma are looked for as they are, as whole words.

The lemma holds for any choice of a passage's q-grams, less those left out. Of the q-grams that many passages share, a
passage leaves out as many as it can spare, so that common sentences don't call up every passage that has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_texts, slices

Q = 8
#: Edits allowed, as a share of a passage's normalised length.
EDITS = 0.1
#: Passages are sent to executors in groups of at most about so many characters; each group is a pass over the texts.
GROUP_CHARS = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
_SPACE, _BREAK = 32, 1
#: Q-grams that a passage asks for at least, whatever it leaves out.
LEAST = 4
#: Q-grams in more passages than this are left out where they can be spared.
COMMON = 16
#: Places of q-grams that are looked at in one go.
HITS = 4_000_000
#: Codes of the regions that are aligned in one go.
CELLS = 2_000_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What each character of the basic plane becomes; others stay as they are."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if not c.isalnum():
            out[code] = _SPACE
        elif len(c.lower()) == 1:
            out[code] = ord(c.lower())
    return out


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts, each between breaks; where each text begins; place of each code in its own text).

    Runs of other characters are one space between letters and digits; a text's codes neither begin nor end with one.
    """
    raw = np.frombuffer("\x01".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t or "") for t in texts], np.int64)
    breaks = np.r_[0, np.cumsum(lengths + 1)]
    codes = np.where(raw < 1 << 16, _classes()[np.minimum(raw, (1 << 16) - 1)], raw)
    codes[breaks] = _BREAK
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _SPACE) | ((codes[:-1] != _SPACE) & (codes[:-1] != _BREAK))
    # A run of spaces before a break is dropped with it: its first space goes too.
    last = np.flatnonzero(keep & (codes == _SPACE))
    after = np.r_[np.flatnonzero(keep), len(codes)]
    following = after[np.searchsorted(after, last, side="right")]
    keep[last[(following < len(codes)) & (codes[np.minimum(following, len(codes) - 1)] == _BREAK)]] = False
    kept = np.flatnonzero(keep)
    codes = codes[kept]
    starts = np.flatnonzero(codes == _BREAK)
    owner = np.cumsum(codes == _BREAK) - 1
    return codes, starts, kept - breaks[np.minimum(owner, len(breaks) - 1)] - 1


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q codes that begin at each place."""
    h, width, base = codes.astype(np.uint64), 1, _BASE
    with np.errstate(over="ignore"):
        while width < Q:
            h = h[:-width] * base + h[width:]
            base, width = base * base, 2 * width
    return h


def budget(length: int, edits: float = EDITS) -> int:
    """Edits allowed in a passage of so many normalised characters: the asked share, or fewer where the lemma would leave
    under LEAST q-grams; none if it is too short for that."""
    return max(0, min(int(edits * length), (length - Q + 1 - LEAST) // Q))


@dataclass
class Index:
    """Passages, the q-grams each asks for, and the places of those q-grams; short passages by their length and codes."""

    items: list[int | None]
    codes: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    offsets: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    item_in_gram: np.ndarray
    short: dict[int, dict[bytes, list[int | None]]]


def _slots(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _FILTER_BITS)


def build(items: list[int | None], texts: list[str | None], edits: float = EDITS) -> Index:
    """Passages without a letter or digit, and null ones, are nowhere found."""
    codes, starts, _ = normalise(texts)
    parts = [codes[a + 1 : b] for a, b in zip(starts[:-1], starts[1:])]
    bare = [(c != _SPACE).sum() for c in parts]
    short: dict[int, dict[bytes, list[int | None]]] = {}
    for i, c in enumerate(parts):
        if bare[i] and len(c) < Q + LEAST - 1:
            whole = np.r_[_SPACE, c, _SPACE] if c[0] != _SPACE else c
            short.setdefault(len(whole), {}).setdefault(whole.astype(np.uint32).tobytes(), []).append(items[i])
    live = [i for i, c in enumerate(parts) if bare[i] and len(c) >= Q + LEAST - 1]
    parts = [parts[i] for i in live]
    allowed = np.array([budget(len(c), edits) for c in parts], np.int64)
    hashes = [gram_hashes(c) for c in parts]
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(parts)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
    need = np.array([len(h) for h in hashes], np.int64) - Q * allowed
    # The most common q-grams first, as many as each passage can spare.
    _, which = np.unique(every, return_inverse=True)
    held = np.unique(which * np.int64(len(parts)) + item) // len(parts) if len(every) else which
    holders = np.bincount(held, minlength=1)[which] if len(every) else which
    order = np.lexsort((place, -holders, item))
    rank = np.arange(len(order)) - np.searchsorted(item[order], np.arange(len(parts)))[item[order]] if len(order) else order
    out = order[(holders[order] > COMMON) & (rank < (need - LEAST)[item[order]])] if len(order) else order
    need -= np.bincount(item[out], minlength=len(parts)) if len(parts) else 0
    kept = np.setdiff1d(np.arange(len(every)), out, assume_unique=True)
    every, item, place = every[kept], item[kept], place[kept]
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    table = np.zeros(1 << _FILTER_BITS, bool)
    table[_slots(grams)] = True
    offsets = np.r_[first, len(every)]
    numbered = np.repeat(np.arange(len(grams)), np.diff(offsets)) * np.int64(len(parts)) + item[order]
    return Index([items[i] for i in live], parts, allowed, need, grams, offsets, item[order], place[order], table, numbered, short)


def align(passages: np.ndarray, lengths: np.ndarray, regions: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least edits, end column) of each row's passage in its region, on `width` diagonals from the region's first.

    Row i of a passage is compared with columns i .. i + width - 1; starting and ending anywhere is free. Passages are
    in order of their lengths, the longest first; those that have ended stand still.
    """
    now = np.zeros((len(regions), width), np.int32)
    steps = np.arange(width, dtype=np.int32)
    live = len(regions)
    for i in range(int(lengths.max(initial=0))):
        while live and lengths[live - 1] <= i:
            live -= 1
        moved = now[:live] + (regions[:live, i : i + width] != passages[:live, i, None])
        moved[:, :-1] = np.minimum(moved[:, :-1], now[:live, 1:] + 1)
        now[:live] = np.minimum.accumulate(moved - steps, axis=1) + steps
    end = now.argmin(axis=1)
    return now[np.arange(len(now)), end], end + lengths


def _hits(index: Index, at: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in the codes, item, place in the item) of all occurrences, in parts of about HITS that no (text, item) is
    cut by: `at` and `known` are those of one text."""
    times = index.offsets[known + 1] - index.offsets[known]
    rounds = max(1, -(-int(times.sum()) // HITS))
    edges = np.linspace(0, len(index.items), rounds + 1).astype(np.int64)
    for low, high in zip(edges, edges[1:]):
        if rounds == 1:
            first, size = index.offsets[known], times
        else:
            # A gram's places are in order of their items; number both together to cut them.
            first = np.searchsorted(index.item_in_gram, known * np.int64(len(index.items)) + low)
            size = np.searchsorted(index.item_in_gram, known * np.int64(len(index.items)) + high) - first
        total = int(size.sum())
        if total:
            posting = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)
            yield np.repeat(at, size), index.item[posting], index.place[posting]


def _exact(index: Index, codes: np.ndarray, starts: np.ndarray, places: np.ndarray) -> list[tuple]:
    """Short passages, between spaces or ends of a text."""
    found = []
    for length, known in index.short.items():
        if len(codes) < length:
            continue
        flat = np.where(codes == _BREAK, _SPACE, codes).astype(np.uint32)
        spaces = np.flatnonzero(flat == _SPACE)
        spaces = spaces[(spaces + length <= len(flat))]
        spaces = spaces[flat[spaces + length - 1] == _SPACE]
        view = np.lib.stride_tricks.sliding_window_view(flat, length)
        for p in spaces.tolist():
            if items := known.get(view[p].tobytes()):
                text = int(np.searchsorted(starts, p + 1, side="right")) - 1
                # Both ends may be breaks of the same text, and nothing in between.
                if not (codes[p + 1 : p + length - 1] == _BREAK).any():
                    found += [(text, item, 0, int(places[p + 1]), int(places[p + length - 2]) + 1) for item in items]
    return found


def search(texts: list[str | None], index: Index) -> list[tuple[int, int | None, int, int, int]]:
    """(text, item, edits, start, end) of every passage found, at most one for each band; places are code points of the
    text, exact to within the edits. No passage is found across texts."""
    if not index.items and not index.short:
        return []
    codes, starts, places = normalise(texts)
    found = _exact(index, codes, starts, places)
    if not index.items:
        return found
    hashes = gram_hashes(codes)
    at = np.flatnonzero(index.filter[_slots(hashes)])
    known = np.minimum(np.searchsorted(index.grams, hashes[at]), len(index.grams) - 1)
    true = index.grams[known] == hashes[at]
    at, known = at[true], known[true]
    if not len(at):
        return found
    owner = np.searchsorted(starts, at, side="right") - 1
    times = index.offsets[known + 1] - index.offsets[known]
    # Texts together as long as they have up to HITS places.
    upto = np.cumsum(times)
    begin = 0
    while begin < len(at):
        stop = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, side="right"))
        text = owner[min(stop, len(at) - 1)]
        if stop < len(at):
            # Whole texts: back to where this one begins, or on to its end if it is the first.
            stop = int(np.searchsorted(owner, text))
            stop = stop if stop > begin else int(np.searchsorted(owner, text, side="right"))
        for part in _hits(index, at[begin:stop], known[begin:stop]):
            found += _verified(index, codes, starts, places, *part)
        begin = stop
    return found


def _verified(index: Index, codes: np.ndarray, starts: np.ndarray, places: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> list[tuple]:
    """Matches among occurrences (place in the codes, item, place in the item), which are all of those texts and items."""
    text = np.searchsorted(starts, at, side="right") - 1
    step = (index.edits + 1)[item]
    shift = int(max(len(c) for c in index.codes)) + 1
    band = (at - starts[text] - place + shift) // step
    # One number for text, item and band; the longest text bounds the bands.
    bands = int(np.diff(np.r_[starts, len(codes)]).max()) + 2 * shift + 2
    key, count = np.unique((text * np.int64(len(index.items)) + item) * np.int64(bands) + band, return_counts=True)
    both = count.copy()
    both[:-1] += np.where(key[1:] == key[:-1] + 1, count[1:], 0)
    some = np.flatnonzero(both >= index.need[key // bands % len(index.items)])
    owner, which, band = key[some] // bands // len(index.items), key[some] // bands % len(index.items), key[some] % bands
    edges = np.r_[starts, len(codes)]
    found = []
    sizes = np.array([len(c) for c in index.codes], np.int64)
    # Candidates whose passages allow as many edits are aligned together, as many at once as have about CELLS codes.
    order = np.lexsort((-sizes[which], index.edits[which]))
    allowed = index.edits[which[order]]
    for e in np.unique(allowed).tolist():
        rows = order[np.searchsorted(allowed, e) : np.searchsorted(allowed, e, side="right")]
        width, at_once = 2 * (e + 1), max(1, CELLS // int(sizes[which[rows[0]]] + 2 * (e + 1)))
        for r in range(0, len(rows), at_once):
            some = rows[r : r + at_once]
            own, text = which[some], owner[some]
            begin = band[some] * (e + 1) - shift + starts[text]
            longest = int(sizes[own[0]])
            passages = np.stack([np.pad(index.codes[b], (0, longest - len(index.codes[b]))) for b in own.tolist()])
            column = begin[:, None] + np.arange(longest + width)
            # What lies outside of the text equals nothing.
            inside = (column > starts[text][:, None]) & (column < edges[text + 1][:, None])
            regions = np.where(inside, codes[np.clip(column, 0, len(codes) - 1)], _BREAK)
            edits, end = align(passages, sizes[own], regions, width)
            for k in np.flatnonzero(edits <= e).tolist():
                t, b = int(text[k]), int(own[k])
                stop = min(int(begin[k] + end[k]), int(edges[t + 1]))
                last = max(stop - 1, int(starts[t]) + 1)
                first = max(int(starts[t]) + 1, stop - int(sizes[b]))
                found.append((t, index.items[b], int(edits[k]), max(int(places[first]), 0), int(places[last]) + 1))
    return found


def _passes(benchmark: DataFrame, edits: float, group_chars: int) -> Iterator[tuple[Index, int]]:
    """(index, number of indexes) for all passages. Those without an id are passages of item null, unless an item has the
    same text."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_chars))
    named = benchmark.where("item_id is not null").select("item_id", "text")
    unnamed = benchmark.where("item_id is null").select("item_id", "text").join(named.select("text").distinct(), "text", "left_anti")
    every = named.unionByName(unnamed)
    # Passages of one item may fall in several groups.
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    for g in range(groups):
        # Bounded: a group has about group_chars characters of passages, however they share items.
        rows = every.where(group == g).distinct().orderBy("item_id", "text").collect()
        yield build([r.item_id for r in rows], [r.text for r in rows], edits), groups


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, id_col: str = "doc_id", group_chars: int = GROUP_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the best place of each item in each row of docs that has it; one for each group
    of passages that has some of the item's.

    Passages without an id are found as item null, or under the id of an item that has the same text.
    """
    spark = docs.sparkSession
    out = None
    fields = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
    for index, passes in _passes(benchmark, edits, group_chars):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, limit=1_000_000):
                    ids = part.column(0).to_pylist()
                    best: dict[tuple[int, int], tuple] = {}
                    for text, item, n, a, b in search(part.column(1).to_pylist(), sent.value):
                        best[text, item] = min(best.get((text, item), (n, a, b)), (n, a, b))
                    rows = [(ids[text], item, *x) for (text, item), x in sorted(best.items(), key=lambda r: (r[0][0], r[0][1] is not None, r[0][1] or 0))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, edits long, start long, end long")
        if passes > 1:
            # One index is on the executors at a time, however many there are.
            found = cut(found)
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def summary(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_items, item_ids (ascending, comma-joined), least_edits (-1 if none), contaminated.

    Null and empty texts have none; an empty benchmark finds nothing, empty docs give no rows. Rows with equal ids share
    what any of them has. Texts of any length are searched whole. Columns besides the id and text are not looked at.
    Passages without an id count as one item, null, the last in item_ids.
    """
    found = matches(docs, benchmark, edits, id_col).groupBy("doc_id").agg(F.concat(F.sort_array(F.collect_set("item_id")), F.when(F.bool_or(F.col("item_id").isNull()), F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("items"), F.min("edits").alias("least"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    joined = ids.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ",", "null"), F.lit("")).alias("item_ids"),
        F.coalesce("least", F.lit(-1)).cast("long").alias("least_edits"),
        F.col("items").isNotNull().alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The rows of docs without a benchmark passage, with their columns; none is shuffled. Null and empty texts stay.

    Passages need no item id here. Repeated rows are each judged by their own text; empty docs or an empty benchmark
    change nothing.
    """
    for index, passes in _passes(benchmark, edits, group_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(texts: list, sent=sent) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[row[0] for row in search(texts, sent.value)]] = False
            return out

        docs = keep_texts(docs, keep, limit=1_000_000)
        if passes > 1:
            docs = cut(docs)
            sent.destroy()
    return docs
