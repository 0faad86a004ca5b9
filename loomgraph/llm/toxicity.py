"""Toxic spans by a linear-chain conditional random field over words.

Every word of a text is a position with label 0 or 1; runs of over LONGEST characters without white space are cut into
several, so that every character reaches a feature. Emissions are sums of hashed character features of the
word, transitions are a 2 x 2 table. Forward-backward gives each word's marginal; a document's score is a logistic
function of the marginals' maximum and sum, and its toxic spans are runs of words with a marginal of a half or more.

Labels exist for documents only, so labels of words are induced first: in a document marked toxic, the words that
have a character feature common in such documents and all but absent from the others are labelled 1.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, crc_mod, keep_texts, labelled_texts, map_texts

#: Hashed feature space (a power of two).
SPACE = 1 << 18
#: Words of a chain that run in step; transfer matrices join the chunks of longer texts.
CHUNK = 128
#: At most so many labelled documents marked toxic, and twice as many others, are used to fit.
FIT_LIMIT = 600
#: Characters of those marked toxic; others have twice as many.
FIT_CHARS = 1_500_000

#: Marginals up to this don't add up: a long text has many small ones.
NOISE = 0.1

#: Longer runs without white space are cut at their marks, and what is still longer into pieces of so many characters.
LONGEST = 64
#: So many characters are in a piece and in the next one of the same word.
OVERLAP = 16

_EDGES = re.compile(r"^\W+|\W+$")


@lru_cache(maxsize=1)
def _parts() -> re.Pattern:
    """Letters and digits with their combining marks and the other characters after them, or other characters alone."""
    combining = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
    return re.compile(rf"(?:[^\W_]|[{combining}])+(?:(?![{combining}])[\W_])*|[\W_]+")


def positions(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the positions of a run without white space."""
    if len(run) <= LONGEST:
        yield 0, len(run)
        return
    for m in _parts().finditer(run):
        at = m.start()
        while m.end() - at > LONGEST:
            yield at, at + LONGEST
            at += LONGEST - OVERLAP
        yield at, m.end()


def words_of(text: str | None) -> list[str]:
    """The positions of a text, in order."""
    runs = (text or "").split()
    if max(map(len, runs), default=0) <= LONGEST:
        return runs
    return [run[a:b] for run in runs for a, b in positions(run)]


def features(word: str) -> list[int]:
    """Hashed features: the bare word, its beginnings and ends, its character 4-grams, and its outer form."""
    bare = _EDGES.sub("", word.lower())
    names = ["w:" + bare, "o:" + ("!" in word) * "!" + word.isupper() * "A" + any(c.isdigit() for c in word) * "9"]
    names += ["p:" + bare[:k] for k in (3, 4, 5, 6) if len(bare) > k]
    names += ["s:" + bare[-k:] for k in (3, 4, 5) if len(bare) > k]
    names += ["m:" + bare[i : i + 4] for i in range(1, len(bare) - 4)]
    return sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) & (SPACE - 1) for n in names})


def feature_lists(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features end to end, offsets of the words)."""
    lists = [features(w) for w in words]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return np.fromiter((f for x in lists for f in x), np.int64, int(offsets[-1])), offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each word's values, in their order: a word's sum doesn't depend on the words beside it. Every word has a value."""
    return np.add.reduceat(values, offsets[:-1]) if len(values) else np.empty(0)


def marginals(emissions: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(label 1) of each position of chains that stand end to end; transition[i, j] is a log weight from i to j.

    `emissions` are log weights of label 1 against label 0. Chains are cut into chunks that run in step; a first
    pass carries each chunk's 2 x 2 transfer matrix, which are joined along the chains, and a second one fills in.
    """
    if not len(emissions):
        return np.empty(0)
    trans, e = np.exp(transition), np.exp(np.clip(emissions, -30, 30))
    chains = np.flatnonzero(lengths)
    per = -(-lengths[chains] // CHUNK)
    first = np.r_[0, np.cumsum(per)]
    within = np.arange(first[-1]) - np.repeat(first[:-1], per)
    begins = np.repeat((np.cumsum(lengths) - lengths)[chains], per) + within * CHUNK
    sizes = np.minimum(CHUNK, np.repeat(lengths[chains], per) - within * CHUNK)
    steps, n = int(sizes.max()), len(begins)
    at = begins[:, None] + np.arange(steps)
    live = np.arange(steps) < sizes[:, None]
    ratio = np.where(live, e[np.minimum(at, len(e) - 1)], 1.0).T.copy()
    live = live.T.copy()

    def through(vectors: np.ndarray, t: int, forward: bool) -> np.ndarray:
        if forward:
            out = np.stack([vectors[..., 0] * trans[0, 0] + vectors[..., 1] * trans[1, 0], (vectors[..., 0] * trans[0, 1] + vectors[..., 1] * trans[1, 1]) * ratio[t][:, None]], axis=-1)
        else:
            one = vectors[..., 1] * ratio[t][:, None]
            out = np.stack([trans[0, 0] * vectors[..., 0] + trans[0, 1] * one, trans[1, 0] * vectors[..., 0] + trans[1, 1] * one], axis=-1)
        out /= out.sum(axis=-1, keepdims=True).max(axis=-2, keepdims=True)
        return np.where(live[t][:, None, None], out, vectors)

    # Row k of a chunk's matrix: what label k before it (or after it, backward) becomes.
    ahead = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
    behind = ahead.copy()
    if int(per.max()) > 1:
        for t in range(steps):
            ahead = through(ahead, t, True)
            behind = through(behind, steps - 1 - t, False)
    # The state before the first word is spread over what transitions then weigh evenly; after the last, all ones.
    enter, leave = np.ones((n, 2)), np.ones((n, 2))
    for k in range(1, int(per.max())):
        now = first[:-1][per > k] + k
        v = np.einsum("ni,nij->nj", enter[now - 1], ahead[now - 1])
        enter[now] = v / v.sum(axis=1, keepdims=True)
        now = (first[1:] - 1)[per > k] - k
        v = np.einsum("ni,nij->nj", leave[now + 1], behind[now + 1])
        leave[now] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((steps, n, 2))
    now = enter[:, None, :]
    for t in range(steps):
        now = through(now, t, True)
        alpha[t] = now[:, 0, :]
    out = np.empty((steps, n))
    now = leave[:, None, :]
    for t in reversed(range(steps)):
        both = alpha[t] * now[:, 0, :]
        out[t] = both[:, 1] / both.sum(axis=1)
        now = through(now, t, False)
    result = np.empty(len(e))
    result[at.T[live]] = out[live]
    return result


@dataclass
class Tagger:
    weights: np.ndarray
    transition: np.ndarray
    calibration: np.ndarray

    def table(self) -> WordTable:
        """Emissions by word."""
        def compute(words: list[str]) -> np.ndarray:
            flat, offsets = feature_lists(words)
            return sums(self.weights[flat], offsets)

        return WordTable(compute)

    def tag(self, texts: list[str | None], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
        """(marginals end to end, number of words of each text)."""
        split = [words_of(t) for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        words = [w for s in split for w in s]
        return (marginals(table(words), lengths, self.transition) if words else np.empty(0)), lengths

    def scores(self, tagged: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        x = aggregates(tagged, lengths)
        return 1 / (1 + np.exp(-(x[:, 0] * self.calibration[0] + x[:, 1] * self.calibration[1] + x[:, 2] * self.calibration[2])))


def aggregates(tagged: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: 1, the log odds of the largest marginal (clipped), and the log of 1 + the sum of what they have above NOISE."""
    ends = np.cumsum(lengths)
    top, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    if some := np.flatnonzero(lengths).tolist():
        starts = (ends - lengths)[some]
        top[some] = np.maximum.reduceat(tagged, starts)
        total[some] = np.add.reduceat(np.maximum(tagged - NOISE, 0), starts)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(lengths)), np.log(top / (1 - top)) / 9, np.log1p(total)], axis=1)


def induce_labels(flat: np.ndarray, offsets: np.ndarray, words: np.ndarray, lengths: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A 0/1 label for each position, from labels of documents (module docstring)."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    pairs = np.unique(doc * np.int64(offsets.size) + words)
    d, w = pairs // offsets.size, pairs % offsets.size
    counts = np.zeros((2, SPACE))
    for label in (0, 1):
        chosen = toxic[d] == label
        size = (offsets[1:] - offsets[:-1])[w[chosen]]
        spot = np.repeat(offsets[w[chosen]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        feature = np.unique(np.repeat(d[chosen], size) * np.int64(SPACE) + flat[spot]) % SPACE
        counts[label] = np.bincount(feature, minlength=SPACE)
    share = [(counts[k] + 0.5) / ((toxic == k).sum() + 1) for k in (0, 1)]
    least = max(3.0, 0.01 * (toxic == 1).sum())
    telling = (np.log(share[1] / share[0]) > math.log(20)) & (counts[1] >= least)
    # Features are taken one by one, each for the documents that those before it explain least.
    in_toxic = toxic[d] == 1
    size = (offsets[1:] - offsets[:-1])[w[in_toxic]]
    spot = np.repeat(offsets[w[in_toxic]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    rows = np.stack([np.repeat(d[in_toxic], size), np.repeat(w[in_toxic], size), flat[spot]])
    rows = rows[:, telling[rows[2]]]
    need, chosen = np.ones(len(lengths)), np.zeros(offsets.size, bool)
    while rows.shape[1]:
        seen = np.unique(rows[0] * np.int64(SPACE) + rows[2])
        gain = np.bincount(seen % SPACE, weights=need[seen // SPACE], minlength=SPACE)
        best = int(np.argmax(gain / (1 + 8 * counts[0])))
        if gain[best] < least:
            break
        found = np.unique(rows[1][rows[2] == best])
        chosen[found] = True
        gone = chosen[rows[1]]
        need[np.unique(rows[0][gone])] *= 0.6
        rows = rows[:, ~gone]
    return (chosen[words] & (toxic[doc] == 1)).astype(float)


def fit(texts: list[str], toxic: list[int], rounds: int = 30, ridge: float = 1e-6) -> Tagger:
    """Emission weights of greatest likelihood, by adaptive gradient steps over all documents given, under transitions that
    are counted from the induced labels; deterministic.

    Without documents of both classes the tagger gives every document the (smoothed) share of toxic ones.
    """
    split = [words_of(t) for t in texts]
    y = np.array(toxic, np.int64)
    names = sorted({w for s in split for w in s})
    if not names or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Tagger(np.zeros(SPACE), np.zeros((2, 2)), np.array([math.log(p / (1 - p)), 0, 0]))
    index = {w: i for i, w in enumerate(names)}
    words = np.array([index[w] for s in split for w in s], np.int64)
    lengths = np.array([len(s) for s in split], np.int64)
    flat, offsets = feature_lists(names)
    target = induce_labels(flat, offsets, words, lengths, y)
    owner = np.repeat(np.arange(len(names)), np.diff(offsets))
    begins = np.zeros(len(words), bool)
    begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    weights, seen = np.zeros(SPACE), np.full(SPACE, 1e-8)
    # Transitions have a closed form given the labels; emissions are then fitted under them.
    a, b = target[:-1][~begins[1:]], target[1:][~begins[1:]]
    pairs = np.array([[((a == i) & (b == j)).sum() + 1.0 for j in (0, 1)] for i in (0, 1)])
    transition = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    weights[zlib.crc32(b"o:") & (SPACE - 1)] = 0.0
    for _ in range(rounds):
        emission = sums(weights[flat], offsets)
        error = np.bincount(words, target - marginals(emission[words], lengths, transition), minlength=len(names))
        gradient = np.bincount(flat, error[owner], minlength=SPACE) - ridge * len(words) * weights
        seen += gradient**2
        weights += 0.5 * gradient / np.sqrt(seen)
    tagger = Tagger(weights, transition, np.zeros(3))
    x = aggregates(marginals(sums(weights[flat], offsets)[words], lengths, transition), lengths)
    for _ in range(100):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-(x @ tagger.calibration)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * tagger.calibration)
        tagger.calibration += step
        if abs(step).max() < 1e-9:
            break
    return tagger


def learn(docs: DataFrame, labels: DataFrame, where=None, limit: int = FIT_LIMIT, max_chars: int = FIT_CHARS) -> Tagger:
    """A tagger fitted on at most `limit` documents marked toxic, of about `max_chars` characters together, and on twice as
    many others.

    Rows whose label is null, or other than 0 and 1, are not used; neither are null texts. A document with several
    labels counts as toxic if one of them says so; of documents with equal ids one text is used, the least.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = known if where is None else known.where(where)
    rows: dict[int, list[str]] = {0: [], 1: []}
    for text, label in labelled_texts(docs, known, 2 * limit, 2 * max_chars):
        rows[int(label)].append(text)
    toxic, used = [], 0
    for text in rows[1][:limit]:
        if used >= max_chars:
            break
        used += len(text)
        toxic.append(text)
    return fit(rows[0] + toxic, [0] * len(rows[0]) + [1] * len(toxic))


def spans(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id") -> DataFrame:
    """doc_id, score, toxic_words (words with a marginal of a half or more) and spans of each document: (start, end,
    marginal) of runs of such words, in code points, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    cache: list[WordTable] = []

    def work(x):
        if not cache:
            cache.append(sent.value.table())
        tagged, lengths = sent.value.tag(x["text"], cache[0])
        high = np.r_[0, np.cumsum(tagged >= 0.5)]
        ends = np.cumsum(lengths)
        words = high[ends] - high[ends - lengths]
        found: list[list[dict]] = [[] for _ in lengths]
        for k in np.flatnonzero(words).tolist():
            own = tagged[ends[k] - lengths[k] : ends[k]]
            before, runs = -2, found[k]
            places = ((m.start() + a, m.start() + b) for m in re.finditer(r"\S+", x["text"][k]) for a, b in positions(m[0]))
            for i, (start, end) in enumerate(places):
                if own[i] >= 0.5:
                    if before == i - 1:
                        runs[-1] |= {"end": end, "marginal": max(runs[-1]["marginal"], float(own[i]))}
                    else:
                        runs.append({"start": start, "end": end, "marginal": float(own[i])})
                    before = i
        return {"doc_id": x[id_col], "score": sent.value.scores(tagged, lengths), "toxic_words": words, "spans": found}

    return map_texts(docs, [id_col, "text"], "doc_id long, score double, toxic_words long, spans array<struct<start:int,end:int,marginal:double>>", work)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_words and spans (start:end of toxic runs, comma-joined) of every document.

    Null and empty texts count as no words; texts of any length are scored whole. Learns from labels whose
    crc32(doc_id as text) mod 5 is not 0; held_out marks the others. Repeated rows of docs each get a row; an empty
    table gives none; without labels of both kinds all documents score alike. Equal texts score alike. Columns besides
    doc_id and text are not looked at.
    """
    tagger = learn(docs, labels, where=crc_mod("doc_id", 5) != 0)
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return spans(docs, tagger).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_words", places.alias("spans"))


def remove(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, with their columns; every row is scored, and none is shuffled.

    Null and empty texts score like texts without toxic words. Repeated rows stay or go together.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    cache: list[WordTable] = []

    def keep(texts):
        if not cache:
            cache.append(sent.value.table())
        return sent.value.scores(*sent.value.tag(texts, cache[0])) < threshold

    return keep_texts(docs, keep)
