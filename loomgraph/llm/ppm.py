"""Language by prediction by partial matching.

Every language has a tree of byte contexts of up to four bytes, counted on a bounded sample of labelled documents
and then frozen. A text is read as the bytes of its lower case, from first to last, white space and marks included; four
zero bytes stand before it, which no text is made of and which cost nothing. A byte seen after its longest context
costs -log2(n / (N + D)), where the context was followed by N bytes of D kinds; otherwise an escape,
-log2(D / (N + D)), is paid and the next shorter context asked, down to 1 in 256. Contexts that a language never met
cost nothing. The language of the least total code length wins.

A byte's cost follows from the four bytes before it, so the costs of five bytes are kept in a table while they are
asked for; those the table lacks are worked out from the trees.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, labelled_texts, map_texts

ORDER = 4
#: At most so many documents of each language, and of about so many characters together, are learnt from.
FIT_LIMIT, FIT_CHARS = 250, 1_000_000
#: Characters of all languages together, however many there are; each has one document at least.
FIT_TOTAL = 20_000_000
#: log2 of the places in the table of costs.
TABLE_BITS = 20
#: Bytes of texts that are worked on in one go.
AT_ONCE = 1_000_000
UNKNOWN = "und"

_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(c.isalpha() for c in text))


def raw(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each byte of all texts: itself in the lowest eight bits, the four before it above; length of each text)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    gap = b"\0" * ORDER
    data = np.frombuffer(gap + gap.join(texts), np.uint8).astype(np.int64)
    codes = data[ORDER:].copy()
    for k in range(1, ORDER + 1):
        codes |= data[ORDER - k : len(data) - k] << (8 * k)
    own = np.ones(len(codes), bool)
    for start in (np.cumsum(lengths + ORDER) - ORDER)[:-1].tolist():
        own[start : start + ORDER] = False
    return codes[own], lengths


@dataclass
class Trees:
    """Frozen statistics of all languages, by order; row 0 of each table stands for what was never met."""

    languages: list[str]
    codes: list[np.ndarray]
    hit: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths in bits of the last byte of each five: a row for each, a column for each language."""
        now = np.full((len(codes), len(self.languages)), 8.0, np.float32)
        for k in range(ORDER + 1):
            hit = self.hit[k][_rows(self.codes[k], codes & ((1 << 8 * (k + 1)) - 1))]
            escape = self.escape[k][_rows(self.contexts[k], codes >> 8 & ((1 << 8 * k) - 1))]
            now = np.where(np.isfinite(hit), hit, escape + now)
        return now


def _rows(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each number among the known ones, from 1; 0 for others."""
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at + 1, 0)


class CostTable:
    """costs() of a tree, kept in a table of fixed size: each five bytes have one place in it, which the last ones asked for hold."""

    def __init__(self, trees: Trees, bits: int = TABLE_BITS):
        self.trees, self.bits = trees, bits
        self.codes = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros((1 << bits, len(trees.languages)), np.float32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            slots = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        slots = slots.astype(np.int64)
        lacking = np.flatnonzero(self.codes[slots] != codes)
        if not len(lacking):
            return self.values[slots]
        fresh = np.unique(codes[lacking])
        costs = self.trees.costs(fresh)
        out = self.values[slots]
        out[lacking] = costs[np.searchsorted(fresh, codes[lacking])]
        self.codes[slots[lacking]] = codes[lacking]
        # Of several that want one place, the one whose number stands there now.
        held = np.unique(slots[lacking])
        self.values[held] = costs[np.searchsorted(fresh, self.codes[held])]
        return out


def grow(texts: list[str], languages: list[str]) -> Trees:
    """Trees from texts with their languages; the order of texts doesn't matter."""
    names = sorted(set(languages))
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for name in names:
        whole = grams([raw(t) for t, language in zip(texts, languages) if language == name])[0]
        for k in range(ORDER + 1):
            kinds, n = np.unique(whole & ((1 << 8 * (k + 1)) - 1), return_counts=True)
            found[k].append((kinds, n.astype(float)))
    codes, hit, contexts, escape = [], [], [], []
    for k in range(ORDER + 1):
        known = np.unique(np.concatenate([c for c, _ in found[k]])) if names else np.empty(0, np.int64)
        n = np.zeros((len(known), len(names)))
        for i, (c, v) in enumerate(found[k]):
            n[np.searchsorted(known, c), i] = v
        # Contexts of order k, which are not all grams of order k - 1: the first ones of a text have zero bytes.
        held = np.unique(known >> 8) if k else np.zeros(1, np.int64)
        context, size = np.searchsorted(held, known >> 8 if k else known * 0) + 1, len(held) + 1
        total, kinds = np.zeros((size, len(names))), np.zeros((size, len(names)))
        np.add.at(total, context, n)
        np.add.at(kinds, context, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = -np.log2(n / (total + kinds)[context])
            out = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        codes.append(known if len(known) else np.array([-1], np.int64))
        hit.append(np.vstack([np.full((1, len(names)), np.inf), own if len(known) else np.full((1, len(names)), np.inf)]).astype(np.float32))
        contexts.append(held if len(held) else np.array([-1], np.int64))
        escape.append(np.vstack([out, out])[: max(2, len(out))].astype(np.float32))
    return Trees(names, codes, hit, contexts, escape)


def code_lengths(texts: list[str | None], table: CostTable) -> np.ndarray:
    """Bits of each text under each language; a text's sum doesn't depend on the texts beside it."""
    out = np.zeros((len(texts), len(table.trees.languages)))
    some = [raw(t) for t in texts]
    at = 0
    while at < len(some):
        stop, size = at, 0
        while stop < len(some) and (stop == at or size + len(some[stop]) <= AT_ONCE):
            size += len(some[stop])
            stop += 1
        if stop == at + 1 and size > AT_ONCE:
            out[at] = _long(some[at], table)
        elif size:
            codes, lengths = grams(some[at:stop])
            full = np.flatnonzero(lengths)
            out[at + full] = np.add.reduceat(table(codes), (np.cumsum(lengths) - lengths)[full], axis=0, dtype=np.float64)
        at = stop
    return out


def _long(text: bytes, table: CostTable) -> np.ndarray:
    """Bits of one long text, part by part, each with the four bytes before it."""
    total = np.zeros(len(table.trees.languages))
    for k in range(0, len(text), AT_ONCE):
        before = min(k, ORDER)
        total += table(grams([text[k - before : k + AT_ONCE]])[0][before:]).sum(axis=0, dtype=np.float64)
    return total


def predict(texts: list[str | None], table: CostTable) -> tuple[list[str], np.ndarray]:
    """(language, its share of 2 ** -code length among all languages) of each text."""
    languages = table.trees.languages
    out, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not languages:
        return out, scores
    bits = code_lengths(texts, table)
    for i, text in enumerate(texts):
        if has_letter(text):
            best = int(np.argmin(bits[i]))
            out[i], scores[i] = languages[best], 1 / np.exp2(np.maximum(bits[i][best] - bits[i], -1000)).sum()
    return out, scores


def learn(docs: DataFrame, where=None, limit: int = FIT_LIMIT, max_chars: int = FIT_CHARS) -> Trees:
    """Trees from at most `limit` documents of each language, of about `max_chars` characters together.

    Null languages and texts don't count. Of documents with equal ids one counts, with the least of its languages and texts.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("label"))
    known = known if where is None else known.where(where)
    languages = known.select(F.approx_count_distinct("label")).first()[0]
    rows = labelled_texts(docs, known, limit, min(max_chars, FIT_TOTAL // max(1, languages)))
    return grow([text for text, _ in rows], [str(label) for _, label in rows])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from text and non-null lang where crc32(doc_id as text) mod 3 is not 1; held_out marks the others. Null
    texts and texts without a letter are `und` with score 0, as is everything if there is nothing to learn from.
    Ties go to the language that sorts first. Texts of any length are read whole; equal texts get equal scores.
    Repeated rows each get a row, an empty table gives none; other columns are not looked at.
    """
    trees = docs.sparkSession.sparkContext.broadcast(learn(docs, where=crc_mod("doc_id", 3) != 1))
    cache: list[CostTable] = []

    def work(x):
        if not cache:
            cache.append(CostTable(trees.value))
        languages, scores = predict(x["text"], cache[0])
        return {"doc_id": x["doc_id"], "lang_pred": languages, "score": scores}

    found = map_texts(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", work)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
