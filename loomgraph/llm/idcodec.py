"""Token ids in binary blocks, packed by an adaptive context-mixing range coder.

A block holds the ids of whole documents. Its ids are cut into lanes of equal length that are coded in step, so each
step is a few array operations. All lanes share one model, which starts empty in every block and is updated after
each step from the ids just coded, alike in encoder and decoder:

* order 2 and order 1 each remember the id last seen after their context, and how often in a row it came true;
* order 0 counts ids: how likely it holds the id that order 2 or order 1 foretells is a prediction of its own;
* each order's confidence has an adaptive hit rate; the predictions of the three orders are mixed in the logistic
  domain with weights learnt by gradient, and give the odds of "order 2's id", "order 1's id" and "neither";
* ids that neither foretold are coded by order 0's counts alone.

Everything is in integers, so any machine decodes what another encoded. A range coder without carries (64-bit
state, 16-bit words) turns the odds into bits; every lane has a stream of its own. A checksum covers each block.
"""

from __future__ import annotations

import math
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, slices

MAGIC, VERSION = b"LGID", 2
#: A block is closed once it has so many ids.
BLOCK_IDS = 1 << 21
LANES, LANE_IDS = 8192, 192
#: log2 of the totals that the odds of the orders, and order 0's frequencies, add up to; 30 at most together.
ODDS_BITS, ZERO_BITS = 12, 18
CONTEXT_BITS = 18
#: What order 0 says of an id is one of four levels, each LEVEL_BITS more likely than the one before it.
LEVEL_BITS = 3
#: Confidence of order 2 and of order 1 (four bits each), whether they agree, and order 0's levels of both ids.
STATES = 1 << 13
_U = np.uint64
_TOP, _BOTTOM, _WORD = _U(1 << 48), _U(1 << 32), _U(16)


@lru_cache(maxsize=1)
def _squash_tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: -2047..2047 (8 fractional bits) to odds of 16 bits; stretch: odds of 12 bits to that range."""
    squash = np.array([min(65535 - 16, max(16, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)
    stretch = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int64)
    return squash, stretch


class Model:
    """What encoder and decoder share; lanes call predict(), then update()."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary, self.lanes, self.step = vocabulary, lanes, 0
        if vocabulary > 1 << (ZERO_BITS - 1):
            raise ValueError("the vocabulary is too large for order 0's frequencies")
        self.two = np.zeros(1 << CONTEXT_BITS, np.int64)
        self.one = np.zeros(vocabulary, np.int64)
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.counts, self.recent = np.zeros(vocabulary, np.int64), []
        # Hits and trials by confidence, for order 2, and for order 1 where order 2 failed; then for each state.
        self.rates = np.tile(np.array([[1.0, 4.0]]).astype(np.int64), (2, 16, 1)) * 8
        self.weights = np.full((2, 2, 4), 1 << 15, np.int64)
        self.weights[:, :, 2] = 0
        states = np.arange(STATES)
        self.agree = (states >> 4) & 1
        self.confidence = (states >> 9, (states >> 5) & 15)
        self.levels = ((states >> 2) & 3, states & 3)
        self._order_zero()
        self._mix()

    def predict(self) -> None:
        # Indices are of 64 bits and are taken by take(): array operations on others cost twice as much.
        self.slot = (self.before * 0x2F0B5 ^ self.last * 0x9E37) & ((1 << CONTEXT_BITS) - 1)
        self.entry2, self.entry1 = self.two.take(self.slot), self.one.take(self.last)
        self.id2, self.id1 = self.entry2 >> 4, self.entry1 >> 4
        self.sure2, self.sure1 = self.entry2 & 15, self.entry1 & 15
        state = self.sure2 << 4
        state |= self.sure1
        state <<= 1
        state |= self.id2 == self.id1
        state <<= 2
        state |= self.level.take(self.id2)
        state <<= 2
        state |= self.level.take(self.id1)
        state <<= 2
        self.state = state

    def update(self, own: np.ndarray, hit2: np.ndarray, outcome: np.ndarray) -> None:
        fresh = own << 4
        for table, slot, entry, sure, hit in ((self.two, self.slot, self.entry2, self.sure2, hit2), (self.one, self.last, self.entry1, self.sure1, self.id1 == own)):
            # A hit makes it surer by one, up to 15.
            kept = entry + (sure < 15)
            kept -= fresh
            kept *= hit
            kept += fresh
            table[slot] = kept
        self.recent.append((own, outcome))
        self.before, self.last = self.last, own
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 128 == 0:
            self._learn()

    def _learn(self) -> None:
        ids, outcome = (np.concatenate(x) for x in zip(*self.recent))
        self.recent = []
        self.counts += np.bincount(ids, minlength=self.vocabulary)
        hits2, hits1, missed, _ = np.bincount(outcome, minlength=4 * STATES).reshape(STATES, 4).T
        tries = missed + hits1 + hits2
        tries1 = np.where(self.agree, 0, tries - hits2)
        for which, (n, h, conf) in enumerate(((tries, hits2, self.confidence[0]), (tries1, hits1, self.confidence[1]))):
            if total := int(n.sum()):
                error = (h << 16) - n * self.odds[which]
                for agree in (0, 1):
                    own = self.agree == agree
                    for i in range(4):
                        self.weights[which, agree, i] += (int((error * self.inputs[which][i])[own].sum()) // total) >> 9
            rate = self.rates[which]
            for column, x in ((0, h), (1, n)):
                summed = np.zeros(16, np.int64)
                np.add.at(summed, conf, x)
                rate[:, column] += summed * 8
            large = rate[:, 1] > 1 << 16
            rate[large] >>= 1
            rate[:, 1] = np.maximum(rate[:, 1], rate[:, 0] + 1)
        self._mix()
        self._order_zero()

    def _mix(self) -> None:
        squash, stretch = _squash_tables()
        agree = self.agree
        own = [stretch[np.clip((r[:, 0] << 12) // r[:, 1], 0, 4095)] for r in self.rates]
        whole = stretch[np.clip((self.rates[:, :, 0].sum(axis=1) << 12) // self.rates[:, :, 1].sum(axis=1), 0, 4095)]
        # The odds that stand for a level, in the middle of it.
        zero = stretch[np.array([1 << max(0, 12 - LEVEL_BITS * (4 - k) + LEVEL_BITS // 2) for k in range(4)])]
        self.inputs, self.odds = [], []
        for which in (0, 1):
            first = own[0][self.confidence[0]]
            second = own[1][self.confidence[1]]
            inputs = [first, second if which else np.where(agree == 1, second, -second), zero[self.levels[which]], np.full(STATES, whole[which])]
            dot = sum(self.weights[which][agree, i] * x for i, x in enumerate(inputs)) >> 16
            self.inputs.append(inputs)
            self.odds.append(squash[np.clip(dot, -2047, 2047) + 2047])
        total = 1 << ODDS_BITS
        two = np.clip(self.odds[0] >> (16 - ODDS_BITS), 1, total - 3)
        one = np.where(agree == 1, 0, np.clip(((total - two) * self.odds[1]) >> 16, 1, total - two - 2))
        # By four times the state and the outcome (order 2's id, order 1's, neither): where its odds begin, and how wide they are.
        self.begins = np.stack([two * 0, two, two + one, two * 0 + total], axis=1).astype(_U).ravel()
        self.widths = np.stack([two, one, total - two - one, two * 0], axis=1).astype(_U).ravel()

    def _order_zero(self) -> None:
        total = 1 << ZERO_BITS
        seen = int(self.counts.sum())
        share = self.counts * (total - self.vocabulary) // seen if seen else np.full(self.vocabulary, (total - self.vocabulary) // self.vocabulary)
        frequency = share + 1
        frequency[int(np.argmax(frequency))] += total - int(frequency.sum())
        self.starts = np.r_[0, np.cumsum(frequency)].astype(_U)
        self.frequency = frequency.astype(_U)
        self.level = sum((frequency >> (ZERO_BITS - LEVEL_BITS * k) > 0).astype(np.int64) for k in (1, 2, 3))
        self.lookup = None

    def find(self, values: np.ndarray) -> np.ndarray:
        if self.lookup is None:
            self.lookup = np.repeat(np.arange(self.vocabulary), self.frequency.astype(np.int64))
        return self.lookup.take(values)


def _narrow(low: np.ndarray, width: np.ndarray, emit) -> None:
    """Shift out settled words until every lane's range has 32 bits."""
    at = np.flatnonzero(((low ^ (low + width)) < _TOP) | (width < _BOTTOM))
    while len(at):
        lo, wide = low.take(at), width.take(at)
        unsettled = (lo ^ (lo + wide)) >= _TOP
        wide = np.where(unsettled, (~lo + _U(1)) & (_BOTTOM - _U(1)), wide)
        emit(at, lo >> _U(48))
        lo, wide = lo << _WORD, wide << _WORD
        low[at], width[at] = lo, wide
        at = at[((lo ^ (lo + wide)) < _TOP) | (wide < _BOTTOM)]


def _outcome(hit2: np.ndarray, hit1: np.ndarray) -> np.ndarray:
    """0 where order 2's id came true, else 1 where order 1's did, else 2."""
    out = 2 - hit1.view(np.int8)
    out *= ~hit2
    return out


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def pack(ids: np.ndarray, vocabulary: int) -> bytes:
    """The ids' streams: words in each lane as uint32, then all words, lane by lane, as uint16."""
    n = len(ids)
    if not n:
        return b""
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.uint16 if vocabulary <= 1 << 16 else np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocabulary, lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    emit = lambda at, words: out.append((at.astype(np.uint16), words.astype(np.uint16)))
    for row in grid:
        row = row.astype(np.int64)
        model.predict()
        hit2, hit1 = row == model.id2, row == model.id1
        outcome = model.state + _outcome(hit2, hit1)
        width >>= _U(ODDS_BITS)
        low += model.begins.take(outcome) * width
        width *= model.widths.take(outcome)
        rest = np.flatnonzero(~(hit2 | hit1))
        chosen = row.take(rest)
        wide = width.take(rest) >> _U(ZERO_BITS)
        low[rest] += model.starts.take(chosen) * wide
        width[rest] = wide * model.frequency.take(chosen)
        _narrow(low, width, emit)
        model.update(row, hit2, outcome)
    everywhere = np.arange(lanes)
    for shift in (48, 32, 16, 0):
        emit(everywhere, (low >> _U(shift)) & _U(0xFFFF))
    at, words = (np.concatenate(x) for x in zip(*out))
    return np.bincount(at, minlength=lanes).astype("<u4").tobytes() + words[np.argsort(at, kind="stable")].astype("<u2").tobytes()


def unpack(data: bytes, n: int, vocabulary: int, lanes: int | None = None) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    lanes = lanes or _shape(n)[0]
    steps = -(-n // lanes)
    sizes = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.frombuffer(data, "<u2", offset=4 * lanes).astype(_U)
    next_ = np.r_[0, np.cumsum(sizes)[:-1]]
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = code << _WORD | words[next_]
        next_ = next_ + 1
    words = np.r_[words, np.zeros(4, _U)]
    model = Model(vocabulary, lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    grid = np.empty((steps, lanes), np.uint16 if vocabulary <= 1 << 16 else np.int32)
    most = _U((1 << ZERO_BITS) - 1)

    def emit(at: np.ndarray, _words: np.ndarray) -> None:
        place = next_.take(at)
        code[at] = code.take(at) << _WORD | words.take(place)
        next_[at] = place + 1

    for step in range(steps):
        model.predict()
        width >>= _U(ODDS_BITS)
        off = code - low
        hit2 = off < model.begins.take(model.state + 1) * width
        hit1 = off < model.begins.take(model.state + 2) * width
        outcome = model.state + _outcome(hit2, hit1)
        row = np.where(hit2, model.id2, model.id1)
        low += model.begins.take(outcome) * width
        width *= model.widths.take(outcome)
        rest = np.flatnonzero(~hit1)
        wide, base = width.take(rest) >> _U(ZERO_BITS), low.take(rest)
        chosen = model.find(np.minimum((code.take(rest) - base) // wide, most).view(np.int64))
        row[rest] = chosen
        low[rest] = base + model.starts.take(chosen) * wide
        width[rest] = wide * model.frequency.take(chosen)
        _narrow(low, width, emit)
        grid[step] = row
        model.update(row, hit2, outcome)
    return grid.T.reshape(-1)[:n]


_HEADER = struct.Struct("<4sHHIQII")


def write_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """magic, version, lanes, vocabulary, number of ids, number of documents, crc32 of all that follows; then the
    documents (a flag of null ids, ids as int64, counts as uint32; deflated, with their length), then the streams."""
    table = np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + counts.astype("<u4").tobytes()
    table = zlib.compress(table, 6)
    body = struct.pack("<I", len(table)) + table + pack(ids, vocabulary)
    return _HEADER.pack(MAGIC, VERSION, _shape(len(ids))[0], vocabulary, len(ids), len(doc_ids), zlib.crc32(body)) + body


def read_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each document, all ids); ValueError if the block is damaged."""
    if len(data) < _HEADER.size:
        raise ValueError("the block is cut short")
    magic, version, lanes, vocabulary, n, docs, crc = _HEADER.unpack_from(data)
    body = memoryview(data)[_HEADER.size :]
    if magic != MAGIC or version != VERSION or zlib.crc32(body) != crc:
        raise ValueError("the block is damaged: its checksum or header is wrong")
    (size,) = struct.unpack_from("<I", body)
    table = zlib.decompress(body[4 : 4 + size])
    null = np.frombuffer(table, np.uint8, docs)
    doc_ids = np.frombuffer(table, "<i8", docs, offset=docs)
    counts = np.frombuffer(table, "<u4", docs, offset=9 * docs).astype(np.int64)
    return [None if z else int(d) for z, d in zip(null, doc_ids)], counts, unpack(bytes(body[4 + size :]), n, vocabulary, lanes)


#: Texts are encoded in slices of about so many bytes: the longer, the fewer distinct pieces for each.
ENCODE_CHARS = 3_000_000
#: Longer words are encoded each time.
LONGEST = 64
#: ASCII marks but the apostrophe, which contractions use.
ENDINGS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Letters or numbers, then such marks.
_ENDED = re.compile(rf"([^\W_]+)([{re.escape(ENDINGS)}]+)")


def _safe(parts: list[str]) -> bool:
    """Whether a text may be cut before every space of it: not where white space stands on both sides of the space.

    White space after other characters is cut off whole either way, and so is a run's last space with what follows.
    """
    for k, part in enumerate(parts[1:], 1):
        if not part or part[0].isspace():
            before = parts[k - 1]
            if (before[-1].isspace() if before else k > 1):
                return False
    return True


class TextEncoder:
    """Ids of texts by a tokenizer file; distinct words are encoded once while they stay in a bounded table.

    A byte-level pre-tokenizer never joins a word with the space after it, so a text may be cut before any space
    that has no white space on both sides. Words that begin with white space are never kept, so that texts with
    runs of it are seen. Other tokenizers, and texts that spell a special token, are encoded whole.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = str(self.tokenizer.pre_tokenizer)
        self.by_word = self.tokenizer.normalizer is None and pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre
        # The published byte alphabet: printable bytes stand for themselves, the others for code points from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.spelling = _Spelling(self.alphabet)
        probe = "Straße été naïve"
        self.by_model = self.by_word and sum(([t.id for t in self.tokenizer.model.tokenize(self._spelt(" " + w))] for w in probe.split()), []) == self.tokenizer.encode(" " + probe, add_special_tokens=False).ids
        # Two generations: words of the older one that recur move to the newer, the others go with it.
        self.limit, self.words, self.older, self.bare = limit, _Words(self), {}, {}

    def _spelt(self, text: str) -> str:
        return text.translate(self.spelling)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, before: str = " ") -> bytes:
        """The ids of a word, after a space or not. Letters are one piece, which goes to the tokenizer's model as it is."""
        if self.by_model and word.isalpha() and max(word) < "\u2000":
            return np.array([t.id for t in self.tokenizer.model.tokenize(self._spelt(before + word))], self.kind).tobytes()
        return self._encode([before + word])[0]

    def _bare(self, text: str) -> bytes:
        """The ids of what stands at the beginning of a text or line, or of marks: from a table that is emptied at a limit."""
        ids = self.bare.get(text)
        if ids is None:
            if ended := _ENDED.fullmatch(text):
                return self._bare(ended[1]) + self._bare(ended[2])
            if len(self.bare) >= self.limit // 4:
                self.bare.clear()
            ids = self._word(text, "")
            if len(text) <= LONGEST:
                self.bare[text] = ids
        return ids

    def miss(self, word: str) -> bytes:
        """The ids of a word that the table asked lacks. Letters and the marks after them are always cut apart, so both
        are looked up on their own; only short ones are kept together."""
        if not word or word[0].isspace():
            return self._word(word)
        if "\n" in word and self.by_model:
            # A line end between other characters is a piece of its own.
            lines = word.split("\n")
            if all(line and not line[0].isspace() and not line[-1].isspace() for line in lines):
                return self.words[lines[0]] + b"".join(self._bare("\n") + self._bare(line) for line in lines[1:])
        ids = self.words.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                if ended := _ENDED.fullmatch(word):
                    ids = self.words[ended[1]] + self._bare(ended[2])
                    if len(word) > 6:
                        return ids
                else:
                    ids = self._word(word)
                    if len(word) > LONGEST:
                        return ids
            if len(self.words) >= self.limit:
                self.older, self.words = self.words, _Words(self)
            self.words[word] = ids
        return ids

    def _join(self, parts: list[str]) -> bytes:
        return self._bare(parts[0]) + b"".join(map(self.words.__getitem__, parts[1:]))

    def _text(self, text: str) -> bytes:
        """The ids of one text, with whatever white space and specials it has."""
        if not text or not self.by_word or any(s in text for s in self.specials):
            return self._encode([text])[0]
        parts = text.split(" ")
        return self._join(parts if _safe(parts) else re.split(r"(?<=\S) (?=\S)", text))

    def _learn(self, words: list[str]) -> None:
        """Put distinct words that the table lacks into it: those of letters only, which the tokenizer's model takes as they are."""
        if not self.by_model:
            return
        tokenize, spelling, space, kind, older = self.tokenizer.model.tokenize, self.spelling, self.alphabet[32], self.kind.char, self.older
        fresh = {}
        for w in words:
            if w.isalpha() and len(w) <= LONGEST:
                if (known := older.get(w)) is not None:
                    fresh[w] = known
                elif w.isascii():
                    fresh[w] = array(kind, [t.id for t in tokenize(space + w)]).tobytes()
                elif max(w) < "\u2000":
                    fresh[w] = array(kind, [t.id for t in tokenize(space + w.translate(spelling))]).tobytes()
        if len(self.words) + len(fresh) > self.limit:
            self.older, self.words = self.words, _Words(self)
        if len(fresh) <= self.limit:
            self.words.update(fresh)

    def __call__(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), without end ids; null is as empty.

        The texts are cut before their spaces and each distinct piece is looked up once, less the marks at its end if
        the rest is letters or numbers. Texts whose white space doesn't allow this are encoded one by one.
        """
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not self.by_word:
            return self._put_together(self._encode(texts.to_pylist()))
        # A line end between other characters is a piece of its own: cut before it too.
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = cut.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        known = coded.dictionary
        lines = pc.starts_with(known, "\n")
        body = pc.if_else(lines, pc.utf8_slice_codeunits(known, 1), known)
        odd = pc.or_(pc.equal(body, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(body, 0, 1)))
        stems = pc.utf8_rtrim(body, ENDINGS)
        stems = pc.if_else(pc.utf8_is_alnum(stems), stems, body)
        stem = pc.if_else(lines, "", stems).dictionary_encode()
        own = _strings(stem.dictionary)
        found = list(map(self.words.get, own))
        if missing := [k for k, ids in enumerate(found) if ids is None]:
            self._learn([own[k] for k in missing])
            for k in missing:
                found[k] = self.words[own[k]]
        # What a piece has: its stem, the marks after it, and in other places than after a space a word of its own.
        marked = np.flatnonzero(pc.and_not(pc.not_equal(stems, body), lines).to_numpy(zero_copy_only=False))
        broken = np.flatnonzero(lines.to_numpy(zero_copy_only=False))
        after = np.full(len(known), b"", object)
        bare = self._bare
        after[marked] = [bare(word[len(short) :]) for word, short in zip(_strings(body.take(pa.array(marked))), _strings(stems.take(pa.array(marked))))]
        pieces = [pc.binary_join_element_wise(pa.array(found, pa.binary()).take(stem.indices), pa.array(after, pa.binary()), pa.scalar(b"", pa.binary()))]
        pieces.append(pa.array([bare("\n") + bare(word) for word in _strings(body.take(pa.array(broken)))], pa.binary()))
        pieces.append(pa.array([bare(word) for word in _strings(known.take(pa.array(codes[ends[:-1]])))], pa.binary()))
        odd = odd.to_numpy(zero_copy_only=False)[codes]
        odd[ends[:-1]] = False
        alone = np.zeros(len(texts), bool)
        alone[np.searchsorted(ends, np.flatnonzero(odd), side="right") - 1] = True
        for special in self.specials:
            alone |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        place = np.arange(len(known))
        place[broken] = len(known) + np.arange(len(broken))
        codes = place[codes]
        codes[ends[:-1]] = len(known) + len(broken) + np.arange(len(texts))
        told = pa.concat_arrays(pieces).take(pa.array(codes))
        at = np.frombuffer(told.buffers()[1], np.int32, len(codes) + 1, offset=4 * told.offset).astype(np.int64) // self.kind.itemsize
        ids = np.frombuffer(told.buffers()[2] or b"", self.kind)[at[0] : at[-1]]
        counts = at[ends[1:]] - at[ends[:-1]]
        if not alone.any():
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(alone).tolist():
            parts[k] = np.frombuffer(self._text(texts[k].as_py()), self.kind)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _put_together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), self.kind), np.array([len(x) // self.kind.itemsize for x in parts], np.int64)


class _Spelling(dict):
    """A character's UTF-8 bytes in the tokenizer's alphabet, by code point."""

    def __init__(self, alphabet: dict[int, str]):
        self.alphabet = alphabet

    def __missing__(self, code: int) -> str:
        self[code] = spelt = chr(code).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        return spelt


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class _Words(dict):
    """Ids by word; what it lacks is asked of the encoder, which decides whether to keep it."""

    def __init__(self, encoder: TextEncoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        return self.encoder.miss(word)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", block_ids: int = BLOCK_IDS) -> None:
    """Encode the texts of docs and write blocks to `path`, in ascending order of ids (null first, ties by text).

    The table at `path` has a row for each block: part and number (which order the blocks), start (ids of the part
    before it), n_ids and payload, the block itself. An empty table writes no blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, start = TaskContext.get().partitionId(), 0, 0
        own = encoder(tokenizer)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal made, start, size, names, held, lengths
            ids = np.concatenate(held)
            payload = write_block(names, np.array(lengths, np.int64), ids, own.vocabulary)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.int64()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["part", "number", "start", "n_ids", "payload"])
            made, start, size, names, held, lengths = made + 1, start + len(ids), 0, [], [], []
            return row

        for batch in batches:
            for some in slices(batch, limit=ENCODE_CHARS):
                ids, counts = own(some.column(1))
                ends = np.cumsum(counts)
                # An end id after each document.
                ids, counts, ends = np.insert(ids, ends, own.kind.type(end_id)), counts + 1, ends + np.arange(1, len(ends) + 1)
                at, doc_ids = 0, some.column(0).to_pylist()
                while at < len(doc_ids):
                    # As many documents as bring the block to block_ids, the one that passes it included.
                    before = int(ends[at] - counts[at])
                    stop = min(len(doc_ids), int(np.searchsorted(ends, before + block_ids - size)) + 1)
                    names += doc_ids[at:stop]
                    lengths += counts[at:stop].tolist()
                    held.append(ids[before : ends[stop - 1]])
                    size += len(held[-1])
                    at = stop
                    if size >= block_ids:
                        yield block()
        if names:
            yield block()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, number long, start long, n_ids long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the blocks at `path`."""
    blocks = spark.read.parquet(path)
    # One number for each written part: bounded by the number of tasks that wrote, not by rows.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for row in totals:
        before[row.part], at = at, at + row.n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "payload"))):
                names, counts, ids = read_block(payload)
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                raw = memoryview(ids).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                columns = [pa.array(names, pa.int64()), pa.array(before[part] + start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.select("part", "start", "payload").mapInArrow(run, schema)


def default_path(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Write docs to `path` (by default a fresh shared folder) and read the documents back from the files.

    One row per row of docs: doc_id, start, n_tokens (with the end id) and ids_crc32. A null or empty text has the
    end id only; rows with equal ids follow each other in order of their texts, null ids come first.
    """
    path = path or default_path(docs.sparkSession)
    write(docs, path, tokenizer, end_id, id_col)
    return read(docs.sparkSession, path)
