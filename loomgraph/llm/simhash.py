"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. If two fingerprints differ in at most four
bits, two of their three segments differ in at most floor(4 * 2 / 3) = 2 bits taken together, so a point z lies
within one bit of either pair of segments. The binary Golay code of length 23 is perfect: every word decodes to
one codeword. The keys of a pair of segments are the decoded indices of all words within one bit, so both
fingerprints have z's codewords as a key. A pair of segments has 11 keys at most; candidates that share a key are
verified by counting differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, join_by, map_texts

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code (fixed value).
GOLAY_GENERATOR = 0b110001110101
#: (first bit, bits) of the segments, from the lowest bit.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints that share a key are compared in blocks of at most so many.
BLOCK = 2048


def shingle_digests(text: str | None, words: int, seed: int = 42) -> bytes:
    """The 64-bit hashes of a text's shingles, end to end; texts without words have none."""
    from xxhash import xxh64_digest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return b""
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_digest(joined, seed)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: len(parts) - words].tolist()]
    return b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a whole text: null and texts without words give 0."""
    digests = shingle_digests(text, words, seed)
    if not digests:
        return 0
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp has the fingerprint's bits as a signed long."""

    def work(x):
        return {"doc_id": x[id_col], "fp": np.array([fingerprint(t, words) for t in x["text"]], np.uint64).view(np.int64)}

    return map_texts(docs, [id_col, "text"], "doc_id long, fp long", work)


@lru_cache(maxsize=1)
def decoder() -> np.ndarray:
    """For every 23-bit word the index (0 to 4095) of the one codeword within three bits."""
    data = np.arange(4096, dtype=np.int64)
    code = np.zeros(4096, np.int64)
    for i in range(12):
        code ^= ((data >> i) & 1) * (GOLAY_GENERATOR << i)
    table = np.empty(1 << 23, np.int16)
    for n in range(4):
        for at in combinations(range(23), n):
            table[code ^ sum(1 << i for i in at)] = data
    return table


def near_codewords(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The decoded index of each word, and those of its neighbours at one bit; -1 fills rows after the distinct ones."""
    table = decoder()
    own = table[words].astype(np.int64)
    around = np.sort(np.stack([table[words ^ (1 << i)] for i in range(bits)], axis=1).astype(np.int64), axis=1)
    fresh = np.ones(around.shape, bool)
    fresh[:, 1:] = around[:, 1:] != around[:, :-1]
    fresh &= around != own[:, None]
    around[~fresh] = -1
    return own, around


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint; two within four bits share one at least."""
    fps = fps.view(np.uint64)
    near = [near_codewords(((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64), n) for at, n in SEGMENTS]
    rows, out = [], []
    for which, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, more_a), (b, more_b) = near[i], near[j]
        base = which << 24
        rows.append(np.arange(len(fps)))
        out.append(base | a << 12 | b)
        r, c = np.nonzero(more_a >= 0)
        rows.append(r)
        out.append(base | more_a[r, c] << 12 | b[r])
        r, c = np.nonzero(more_b >= 0)
        rows.append(r)
        out.append(base | a[r] << 12 | more_b[r, c])
    return np.concatenate(rows), np.concatenate(out)


def spanning_links(fps: np.ndarray, nodes: np.ndarray, bits: int) -> tuple[list, list]:
    """Links that join whatever verified links join, at most one fewer than there are fingerprints."""
    a, b = [], []
    left = np.argsort(nodes, kind="stable")
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), nodes[at]))
                b.append(nodes[found])
                queue.extend(found.tolist())
                left = left[~near]
    return a, b


def links_in_runs(group: np.ndarray, fps: np.ndarray, nodes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal `group`: short runs by shifted comparison, longer ones by spanning_links."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    run = np.repeat(np.arange(len(starts)), sizes)
    small = sizes[run] <= 16
    a, b = [], []
    for shift in range(1, 16):
        i = np.flatnonzero((run[:-shift] == run[shift:]) & small[shift:]) if shift < len(run) else np.empty(0, int)
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= bits]
        a.append(nodes[i])
        b.append(nodes[i + shift])
    for k in np.flatnonzero(sizes > 16):
        x, y = spanning_links(fps[starts[k] : starts[k] + sizes[k]], nodes[starts[k] : starts[k] + sizes[k]], bits)
        a += x
        b += y
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _verify(bits: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 4
        for batch in batches:
            now = [np.concatenate([k, batch.column(n).to_numpy(zero_copy_only=False)]) for k, n in zip(kept, ("key", "part", "fp", "node"))]
            if not len(now[0]):
                continue
            last = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1]) + 1 if (now[0][0], now[1][0]) != (now[0][-1], now[1][-1]) else 0
            done, kept = [x[:last] for x in now], [x[last:] for x in now]
            if last:
                yield _linked(done, bits, schema)
        if len(kept[0]):
            yield _linked(kept, bits, schema)

    return run


def _linked(rows: list[np.ndarray], bits: int, schema: pa.Schema) -> pa.RecordBatch:
    key, part, fp, node = rows
    change = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
    a, b = links_in_runs(np.cumsum(change), fp.view(np.uint64), node, bits)
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], schema=schema)


def links(reps: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) among reps(fp, node) that join what all links within `bits` bits join.

    A key held by more than `block` fingerprints is cut into chunks by their hash and every pair of chunks is
    compared in a task of its own, so no task gathers an unbounded group and no candidate is left out.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the keys are complete for at most four differing bits")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("fp", "node"))
            for at in range(0, len(fps), 20_000):
                rows, out = keys(fps[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (out, fps[at:][rows], nodes[at:][rows])], names=["key", "fp", "node"])

    keyed = reps.select("fp", "node").mapInArrow(expand, "key long, fp long, node long")
    large = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("long").alias("chunks"))
    marked = keyed.join(large, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    wide = F.col("chunks") + 1
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: F.least(c, own) * wide + F.greatest(c, own))))
    parted = marked.select("key", "fp", "node", other.alias("part"))
    sorted_ = parted.repartition("key", "part").sortWithinPartitions("key", "part")
    return sorted_.mapInArrow(_verify(bits), "a long, b long").distinct()


def groups(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, and fp as a long.

    component_id is the smallest doc_id that links (at most `bits` differing bits) reach, the document itself
    included. Null and word-less texts have fingerprint zero and link like any other. Equal fingerprints are
    one node, so groups of copies cost one row. A null doc_id keeps its row, with a null component if alone.
    An empty table gives no rows; columns besides the id and text are not looked at.
    """
    fps = cut(fingerprints(docs, words, id_col))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("times")))
    found = connected_components(links(reps.where("node is not null"), bits))
    member = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "times")
    return join_by(fps, member, ["fp"], "times").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def deduplicate(docs: DataFrame, words: int = 5, bits: int = 4, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is its group's smallest; all columns stay as they are. Rows with a null id stay."""
    keep = groups(docs, words, bits, id_col).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.where(F.col(id_col).isNull()).unionByName(docs.join(keep, docs[id_col] == keep["_kept"], "left_semi"))
