"""Passages that documents share with earlier ones, found by suffix automata of reference shards.

Every run of `window` words that also starts in a document with a smaller id is removed. Which documents can share a run is
told by anchors: of the short word grams within a window the one with the least hash, which depends on the window's words
alone. The first document (smallest id) that has an anchor holds the reference for it: its stretches of windows with that
anchor go to a shard, and other documents' stretches go to the shards of their anchors' first documents. A shard's
stretches become a suffix automaton of words, whose states know the smallest document they occur in; it is sent to every
task that has documents for the shard, as many as their size asks for, and the documents are streamed through it for
matching statistics. Spans that match `window` words or more of an earlier document are removed. Windows that the first
document of their anchor lacks are grouped by their words: the smallest document of a group keeps them.

No shard is sent to documents without an anchor of it, so the work follows the input, where all shards before all
documents would follow its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_folder, release, slices, stored

WINDOW, GRAM = 13, 5
#: Words of a shard's reference, and of the stretches that one task streams through it.
SHARD_WORDS, STREAM_WORDS = 100_000, 2_000_000
#: A first document with more anchors than this is dealt to several shards by the anchors' hashes.
LONG = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes that are hashed in one go.
_GO = 4_000_000


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)]) if n else np.empty(0, np.uint64)


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first, last, row): every word is bytes [first, last) of the row's text; null texts have none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    solid = ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = np.r_[False, solid[:-1]] & ~edge[:-1], np.r_[solid[1:], False] & ~edge[1:]
    first, last = np.flatnonzero(solid & ~before[: len(data)]), np.flatnonzero(solid & ~after[: len(data)]) + 1
    return data, first, last, np.searchsorted(bounds, first, side="right") - 1


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of every word's bytes."""
    out = np.empty(len(first), np.uint64)
    powers = _powers(int((last - first).max(initial=0)))
    a = 0
    with np.errstate(over="ignore"):
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(last, first[a] + _GO, side="right")))
            size = last[a:b] - first[a:b]
            start = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(start, size)
            values = _byte_values()[data[np.repeat(first[a:b], size) + place]] * powers[place]
            out[a:b] = np.add.reduceat(values, start)
            a = b
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(hashes: np.ndarray, row: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor) of every window within a row: the least hash among its grams of words."""
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        grams = _mixed(hashes)[: len(hashes) - gram + 1].copy()
        for k in range(1, gram):
            grams = grams * _BASE + _mixed(hashes)[k : k + len(grams)]
        least, width, wide = _mixed(grams), 1, window - gram + 1
    while 2 * width <= wide:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if wide > width:
        least = np.minimum(least[: width - wide], least[wide - width :])
    start = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    return start, least[start]


class Automaton:
    """A suffix automaton over words of many texts; every state knows the least number of the texts it occurs in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(1 << 63)
        return len(self.next) - 1

    def _step(self, p: int, q: int, word: bytes) -> int:
        """The state for `word` after p, given that p leads to q by it: q itself, or a copy that is no longer than asked."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], number: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._step(last, q, word)
            else:
                own, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = own
                    p = self.link[p]
                if p >= 0:
                    self.link[own] = self._step(p, self.next[p][word], word)
                last = own
            self.least[last] = min(self.least[last], number)

    def finish(self) -> None:
        """Hand the least numbers on to shorter suffixes."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            to = self.link[v]
            if self.least[v] < self.least[to]:
                self.least[to] = self.least[v]

    def covered(self, words: list[bytes], number: int, window: int) -> np.ndarray:
        """Which windows of the text also occur in a text with a smaller number, by matching statistics."""
        next_, link, length, least = self.next, self.link, self.length, self.least
        out = np.zeros(max(0, len(words) - window + 1), bool)
        v = matched = 0
        for i, word in enumerate(words):
            q = next_[v].get(word)
            while q is None and v:
                v = link[v]
                matched = length[v]
                q = next_[v].get(word)
            if q is None:
                continue
            v, matched = q, matched + 1
            # The shortest state that still has a whole window: it occurs wherever the window does.
            while length[link[v]] >= window:
                v = link[v]
                matched = length[v]
            if matched >= window and least[v] < number:
                out[i - window + 1] = True
        return out


def _anchored(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, doc, x) of each run of windows with the same anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, first, last, row = word_spans(part.column(2))
                start, anchor = anchors(word_hashes(data, first, last), row, window, gram)
                own = row[start]
                fresh = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])]) if len(start) else start
                at = pa.array(own[fresh])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[fresh].view(np.int64)), part.column(0).take(at), part.column(1).take(at)], names=["anchor", "doc", "x"])

    return docs.select("doc", "x", "text").mapInArrow(run, "anchor long, doc long, x int")


def _stretches(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """Stretches of windows whose anchors have the same first document, with all their words.

    marked: doc, x, text and marks, an array of (anchor, first, part). own is true for stretches of the first document
    itself; start counts words.
    """
    names = ["own", "first", "part", "doc", "x", "start", "n_words", "words"]
    kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, first, last, row = word_spans(part.column(2))
                start, anchor = anchors(word_hashes(data, first, last), row, window, gram)
                marks = part.column(3)
                flat = marks.flatten()
                key, holder, piece = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                counts = pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False)
                # Anchors of each row in order; windows are looked up among their own row's.
                owner = np.repeat(np.arange(len(marks)), counts)
                key = key.view(np.uint64)
                order = np.lexsort((key, owner))
                key, holder, piece = key[order], holder[order], piece[order]
                edges = np.r_[0, np.cumsum(counts)]
                own = row[start]
                bounds = np.searchsorted(own, np.arange(len(marks) + 1))
                at = np.full(len(start), -1, np.int64)
                for r in range(len(marks)):
                    lo, hi, a, b = bounds[r], bounds[r + 1], edges[r], edges[r + 1]
                    if lo < hi and a < b:
                        found = np.minimum(np.searchsorted(key[a:b], anchor[lo:hi]), b - a - 1) + a
                        at[lo:hi] = np.where(key[found] == anchor[lo:hi], found, -1)
                some = np.flatnonzero(at >= 0)
                if not len(some):
                    continue
                label, split = holder[at[some]], piece[at[some]]
                fresh = np.r_[True, (np.diff(start[some]) != 1) | (np.diff(own[some]) != 0) | (np.diff(label) != 0) | (np.diff(split) != 0)]
                begin = np.flatnonzero(fresh)
                end = np.r_[begin[1:], len(some)] - 1
                a, b = start[some[begin]], start[some[end]] + window
                rows = own[some[begin]]
                ids, xs = (part.column(k).take(pa.array(rows)) for k in range(2))
                raw = data.tobytes()
                words = [raw[p:q] for p, q in zip(first[a].tolist(), last[b - 1].tolist())]
                before = np.searchsorted(row, rows)
                columns = [pa.array(ids.to_numpy(zero_copy_only=False) == label[begin]), label[begin], split[begin], ids, xs, a - before, b - a, words]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return marked.select("doc", "x", "text", "marks").mapInArrow(run, "own boolean, first long, part int, doc long, x int, start long, n_words long, words binary")


def _streamed(rows: DataFrame, window: int) -> DataFrame:
    """(doc, x, start, stop, h1, h2): covered spans of words, and windows without an earlier document, with their hashes.

    rows: shard, lane, own, doc, x, start, words; all rows of a (shard, lane) follow each other, reference stretches first.
    """
    names = ["doc", "x", "start", "stop", "h1", "h2"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        now, machine, open_ = None, Automaton(), False
        for batch in batches:
            out: list[tuple] = []
            for shard, lane, own, doc, x, start, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (shard, lane) != now:
                    now, machine, open_ = (shard, lane), Automaton(), True
                words = text.split()
                if own:
                    machine.add(words, doc)
                    continue
                if open_:
                    machine.finish()
                    open_ = False
                covered = machine.covered(words, doc, window)
                change = np.flatnonzero(np.diff(np.r_[False, covered, False]))
                out += [(doc, x, start + a, start + b - 1 + window, None, None) for a, b in zip(change[::2].tolist(), change[1::2].tolist())]
                for i in np.flatnonzero(~covered).tolist():
                    h = xxh3_128_intdigest(b" ".join(words[i : i + window]))
                    out.append((doc, x, start + i, start + i + window, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.select("shard", "lane", "own", "doc", "x", "start", "words").mapInArrow(run, "doc long, x int, start long, stop long, h1 long, h2 long")


def covered_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS, long: int = LONG) -> DataFrame:
    """(doc, x, spans) of those docs(doc, x, text) that have words which occur in documents with a smaller doc: spans of
    words, (start, stop), that may overlap.

    Rows are told apart by doc and x, a hash of their text. Every step is a table in the shared folder, and what the step
    before it needed is dropped.
    """
    spark = docs.sparkSession
    gram = min(gram, window)
    live = docs.where("doc is not null")
    first = _anchored(live, window, gram).groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("_last")).where("first < _last").select("anchor", "first", F.lit(0).alias("part"))
    first, first_at = stored(first, "anchors")
    release(spark)
    # Anchors of very long documents are dealt to several parts.
    many = cut(first.groupBy("first").agg(F.ceil(F.count("*") / long).cast("int").alias("parts")).where("parts > 1"))
    if not many.isEmpty():
        first = first.join(many, "first", "left").select("anchor", "first", F.pmod(F.xxhash64("anchor"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    marks = _anchored(live, window, gram).join(first, "anchor").groupBy("doc", "x").agg(F.collect_list(F.struct("anchor", "first", "part")).alias("marks"))
    marks, marks_at = stored(marks, "marks")
    drop_folder(spark, first_at)
    release(spark)
    pieces, pieces_at = stored(_stretches(live.join(marks.hint("shuffle_hash"), ["doc", "x"]), window, gram), "stretches")
    drop_folder(spark, marks_at)
    release(spark)
    shards = max(1, -(-(pieces.where("own").agg(F.sum("n_words")).first()[0] or 0) // shard_words))
    dealt = pieces.withColumns({"shard": F.pmod(F.xxhash64("first", "part"), F.lit(shards)), "lanes": F.lit(1)})
    wide = cut(dealt.where("not own").groupBy("shard").agg(F.ceil(F.sum("n_words") / stream_words).cast("int").alias("lanes")).where("lanes > 1"))
    if not wide.isEmpty():
        dealt = dealt.drop("lanes").join(wide, "shard", "left").withColumn("lanes", F.coalesce("lanes", F.lit(1)))
    # Stretches of the reference go to every lane of their shard, others to one.
    lanes = F.when(F.col("own"), F.sequence(F.lit(0), F.col("lanes") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc", "x", "start"), F.col("lanes")).cast("int")))
    rows = dealt.withColumn("lane", F.explode(lanes)).repartition("shard", "lane").sortWithinPartitions("shard", "lane", F.desc("own"), "doc", "start")
    found, found_at = stored(_streamed(rows, window), "spans")
    drop_folder(spark, pieces_at)
    release(spark)
    left = found.where("h1 is not null")
    least = left.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("_last")).where("least < _last").select("h1", "h2", "least")
    late = left.join(least, ["h1", "h2"]).where("doc > least")
    every = found.where("h1 is null").select("doc", "x", "start", "stop").unionByName(late.select("doc", "x", "start", "stop"))
    # As many spans as a document has windows.
    gathered, _ = stored(every.groupBy("doc", "x").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "covered")
    drop_folder(spark, found_at)
    release(spark)
    return gathered


def remove_shared(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", **sizes: int) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed and text, the words kept, joined by one space.

    Words are runs of anything but ASCII white space, unchanged. A word is removed if a window of `window` words over it
    also starts in a document with a smaller id; windows are judged on docs as they are. Rows of one id take nothing from
    each other; rows without an id are left whole and take nothing from others, as null is neither smaller nor greater.
    Null and empty texts have no words; texts shorter than a window stay whole; texts of any length are read whole; an
    empty table gives no rows; columns besides the id and text are not looked at.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.hash("text").alias("x"), "text")
    joined = own.join(covered_spans(own, window, gram, **sizes).hint("shuffle_hash"), ["doc", "x"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                total, gone, texts = [], [], []
                for text, spans in zip(part.column(1).cast(pa.large_binary()).to_pylist(), part.column(2).to_pylist()):
                    words = (text or b"").split()
                    total.append(len(words))
                    if spans:
                        edges = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edges, [s["start"] for s in spans], 1)
                        np.add.at(edges, [s["stop"] for s in spans], -1)
                        words = list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
                    gone.append(total[-1] - len(words))
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return joined.select("doc", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = f"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ws FROM documents),
windows AS MATERIALIZED (SELECT r, doc_id, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: {{'i': i, 'w': array_to_string(ws[i:i + {WINDOW - 1}], ' ')}}), recursive := true) FROM rows WHERE doc_id IS NOT NULL AND len(ws) >= {WINDOW}),
least AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
gone AS MATERIALIZED (SELECT DISTINCT r, i + p AS i FROM windows JOIN least USING (w), range({WINDOW}) t(p) WHERE doc_id > least),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n FROM (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM rows) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM rows LEFT JOIN kept USING (r)"""
