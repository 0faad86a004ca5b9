"""Co-occurrence of entities in sentences."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt, shared_checkpoint, shuffled, tasks_for
from .ordered import chunks, numbered

#: A sentence with more entities than this is dealt to several tasks; sentences of a list that is cut into parts.
HEAVY, CHUNK = 2000, 10_000
#: Pairs that a task makes, about.
PAIRS = 1_000_000
#: Entities of a block in counted(), and sentences that are multiplied at once.
BLOCK, AT_ONCE = 4096, 512
#: Chunks of sentences, and parts of the blocks, every two of which meet in a task, at most.
CHUNKS, SIDES = 1024, 44


def presence(mentions: DataFrame, sentence: str = "sentence_id", entity: str = "canonical_id") -> DataFrame:
    """(sentence, entity), each once."""
    own = mentions.select(sentence, entity).where(F.col(sentence).isNotNull() & F.col(entity).isNotNull())
    return dealt(own, sentence, entity).distinct()


def pairs(present: DataFrame, sentence: str = "sentence_id", entity: str = "canonical_id", heavy: int = HEAVY, each: int = PAIRS) -> DataFrame:
    """(sentence, source_id, target_id) with source_id < target_id, once for each sentence that has both.

    The lists of a sentence's entities are paired in place: one shuffle by sentence, and none for a self-join. Pairs are
    counted first, and a task makes about `each`. Sentences of over `heavy` entities are dealt in chunks, every two of which
    meet in a task of their own.
    """
    sizes = present.groupBy(sentence).agg(F.count("*").alias("_n"))
    tasks, hot = _made(sizes, heavy, each)
    if not hot:
        return _light(present, sentence, entity, tasks)
    large = shared_checkpoint(sizes.where(F.col("_n") > heavy).select(sentence, F.ceil(F.col("_n") / heavy).cast("int").alias("_chunks")))
    own = present.join(large, sentence).withColumn("_own", F.pmod(F.xxhash64(entity), F.col("_chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: F.struct(F.least(c, F.col("_own")).alias("a"), F.greatest(c, F.col("_own")).alias("b")))
    dealt = own.select(sentence, entity, "_own", F.explode(others).alias("_met"))
    sides = dealt.groupBy(sentence, "_met").agg(*[F.collect_set(F.when(F.col("_own") == F.col("_met")[s], F.col(entity))).alias(f"_{s}") for s in "ab"])
    first = sides.select(sentence, F.col("_met.a") == F.col("_met.b"), "_b", F.explode("_a").alias("_x")).toDF(sentence, "_same", "_b", "_x")
    # Within a chunk the greater half is enough.
    both = first.select(sentence, "_x", F.explode(F.filter("_b", lambda y: ~F.col("_same") | (y > F.col("_x")))).alias("_y"))
    crossed = both.select(sentence, F.least("_x", "_y").alias("source_id"), F.greatest("_x", "_y").alias("target_id"))
    return _light(present.join(large, sentence, "left_anti"), sentence, entity, tasks).unionByName(crossed)


def pairs_of(mentions: DataFrame, sentence: str = "sentence_id", entity: str = "canonical_id", heavy: int = HEAVY, each: int = PAIRS) -> DataFrame:
    """pairs(presence(mentions)), without a shuffle for distinct rows where no sentence has over `heavy` mentions: lists of
    entities have each once as it is."""
    own = mentions.select(sentence, entity).where(F.col(sentence).isNotNull() & F.col(entity).isNotNull())
    tasks, hot = _made(own.groupBy(sentence).agg(F.count("*").alias("_n")), heavy, each)
    return pairs(presence(own, sentence, entity), sentence, entity, heavy, each) if hot else _light(own, sentence, entity, tasks)


def _made(sizes: DataFrame, heavy: int, each: int) -> tuple[int, bool]:
    """Tasks for the pairs of sentences of up to `heavy` rows (_n), and whether others have more."""
    pairs_made, most = sizes.agg(F.sum(F.when(F.col("_n") <= heavy, F.col("_n") * (F.col("_n") - 1.0) / 2)), F.max("_n")).first()
    return tasks_for(sizes.sparkSession, pairs_made or 0, each), (most or 0) > heavy


def _light(present: DataFrame, sentence: str, entity: str, tasks: int) -> DataFrame:
    lists = present.repartition(tasks, sentence).groupBy(sentence).agg(F.array_sort(F.collect_set(entity)).alias("_all")).where(F.size("_all") > 1)
    first = lists.select(sentence, "_all", F.posexplode("_all").alias("_p", "source_id"))
    return first.select(sentence, "source_id", F.explode(F.slice("_all", F.col("_p") + 2, F.greatest(F.size("_all") - F.col("_p") - 1, F.lit(0)))).alias("target_id"))


def edges(pair_rows: DataFrame, sentence: str = "sentence_id", lists: bool = False) -> DataFrame:
    """(source_id, target_id, weight), and sorted sentence_ids if asked; an empty input gives an empty frame.

    A list is one value, however long; edge_sentences() has them in parts. Lists are cut from sorted rows.
    """
    if not lists:
        return pair_rows.groupBy("source_id", "target_id").agg(F.count("*").alias("weight"))
    kinds = dict(pair_rows.dtypes)
    placed = pair_rows.select("source_id", "target_id", sentence).repartition("source_id", "target_id").sortWithinPartitions("source_id", "target_id", sentence)
    return placed.mapInArrow(_edge_lists, f"source_id {kinds['source_id']}, target_id {kinds['target_id']}, weight long, sentence_ids array<{kinds[sentence]}>")


def _edge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of equal edges; the last run of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and len(_begins(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))) > 1:
            yield _listed(held)
            held = []
        last = int(_begins(batch)[-1])
        if last:
            yield _listed([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _listed(held)


def _begins(batch: pa.RecordBatch) -> np.ndarray:
    """Where runs of equal edges begin."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for column in batch.columns[:2]:
        now, before = column.slice(1), column.slice(0, len(column) - 1)
        new[1:] |= pc.coalesce(pc.not_equal(now, before), pc.xor(now.is_null(), before.is_null())).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _listed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    batch = pa.concat_batches(batches)
    begins, values = _begins(batch), batch.column(2)
    ends = np.append(begins, batch.num_rows)
    known = np.concatenate([[0], np.cumsum(values.is_valid().to_numpy(zero_copy_only=False))])
    ids = pa.ListArray.from_arrays(pa.array(known[ends], pa.int32()), values.drop_null())
    first = pa.array(begins)
    return pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(1).take(first), pa.array(np.diff(ends)), ids], names=["source_id", "target_id", "weight", "sentence_ids"])


def counted(present: DataFrame, sentence: str = "sentence_id", entity: str = "canonical_id", block: int = BLOCK) -> DataFrame:
    """edges(pairs(present)) where sentences have many entities, without a row for each pair and sentence.

    Entities are numbered in order and cut into blocks, sentences into chunks. Two blocks meet in a task that holds the count
    of every pair between them, whatever the number of sentences, and says each edge once. A block's lists are written once, to
    the shared checkpoint folder, and read by every task that needs them: disk grows with the rows, not with pairs of blocks.
    """
    own = present.select(sentence, entity).where(F.col(sentence).isNotNull() & F.col(entity).isNotNull()).distinct()
    names = shared_checkpoint(numbered(own.select(entity).distinct(), [], [entity], "_i"))
    places = shared_checkpoint(numbered(own.select(sentence).distinct(), [], [sentence], "_j"))
    n, m = names.count(), places.count()
    # Some blocks even of few entities, so that there are tasks for them.
    size = min(block, max(64, -(-n // 16)))
    blocks, each = max(1, -(-n // size)), max(AT_ONCE, -(-m // CHUNKS))
    cores = present.sparkSession.sparkContext.defaultParallelism
    sides = min(blocks, SIDES, max(ceil(sqrt(2 * cores)), blocks // 3))
    kind, spot = dict(present.dtypes)[entity], "int" if each * size < 2**31 else "long"
    placed = own.join(shuffled(names), entity).join(shuffled(places), sentence).select(F.expr(f"int(_i div {size})").alias("_own"), F.expr(f"int(_j div {each})").alias("_chunk"), F.expr(f"cast(_j % {each} * {size} + _i % {size} as {spot})").alias("_spot"))
    lists = placed.groupBy("_own", "_chunk").agg(F.collect_list("_spot").alias("_spots")).withColumn("_ids", F.lit(None).cast(f"array<{kind}>"))
    known = names.groupBy(F.expr(f"int(_i div {size})").alias("_own")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", entity))), lambda r: r[entity]).alias("_ids"))  # a block's entities
    known = known.select("_own", F.lit(-1).alias("_chunk"), F.lit(None).cast(f"array<{spot}>").alias("_spots"), "_ids")
    first = shared_checkpoint(lists.unionByName(known).repartitionById(sides, F.col("_own") % sides).sortWithinPartitions("_own", "_chunk"))
    second = first.toDF("_met", "_same", "_others", "_names").hint("shuffle_replicate_nl")
    met = first.join(second, (F.col("_own") <= F.col("_met")) & (F.col("_chunk") == F.col("_same"))).select("_own", "_met", "_chunk", "_spots", "_others", "_ids", "_names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block's rows come together, for each chunk with all blocks of the other side.
        key, held = None, {}
        for batch in batches:
            a, b, chunk = (batch.column(k).to_pylist() for k in range(3))
            for k in range(len(a)):
                if a[k] != key:
                    yield from _counted(key, held, size, each)
                    key, held = a[k], {}
                lists, ids = held.setdefault(b[k], ([], []))
                if chunk[k] < 0:
                    ids += [batch.column(c)[k].values for c in (5, 6)]
                else:
                    lists.append([batch.column(c)[k].values.to_numpy() for c in (3, 4)])
        yield from _counted(key, held, size, each)

    return met.mapInArrow(run, f"source_id {kind}, target_id {kind}, weight long")


def _counted(key: int | None, held: dict, size: int, each: int) -> Iterator[pa.RecordBatch]:
    """The edges of a block with each of those it has met."""
    for other, (lists, ids) in held.items():
        counts = _Counts(size, key == other, ids)
        for spots in lists:
            for begin in range(0, each * size, AT_ONCE * size):
                counts.add([x[(x >= begin) & (x < begin + AT_ONCE * size)] - begin for x in spots] if each > AT_ONCE else spots)
        yield from counts.edges()


class _Counts:
    """How many sentences each two entities of two blocks share; `same`: of one block, each two once."""

    def __init__(self, size: int, same: bool, ids: list[pa.Array]):
        self.same, self.ids = same, ids
        self.total = np.zeros((size, size), np.int64)
        first = np.zeros((AT_ONCE, size), np.float32)
        self.sides = [first, first if same else np.zeros_like(first)]

    def add(self, spots: list[np.ndarray]) -> None:
        """Count up to AT_ONCE sentences, whose entities are places in both sides."""
        for side, own in zip(self.sides, spots):
            side[:] = 0
            side.reshape(-1)[own] = 1
        # Whole numbers up to AT_ONCE are exact.
        self.total += (self.sides[0].T @ self.sides[1]).astype(np.int64)

    def edges(self) -> Iterator[pa.RecordBatch]:
        first, second = self.ids
        for begin in range(0, len(first), 64):
            part = self.total[begin : begin + 64]
            x, y = np.nonzero(np.triu(part, begin + 1) if self.same else part)
            if len(x):
                yield pa.RecordBatch.from_arrays([first.take(pa.array(x + begin)), second.take(pa.array(y)), pa.array(part[x, y])], names=["source_id", "target_id", "weight"])


def edge_sentences(pair_rows: DataFrame, sentence: str = "sentence_id", size: int = CHUNK) -> DataFrame:
    """(source_id, target_id, chunk, sentence_ids): each edge's sentences in order, in numbered lists of up to `size`."""
    return chunks(pair_rows, ["source_id", "target_id"], sentence, size).withColumnRenamed("values", "sentence_ids")


def name_edges(edge_rows: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with source_name and target_name from names(canonical_id, fullname)."""
    for side in ("source", "target"):
        edge_rows = edge_rows.join(names.select(F.col("canonical_id").alias(f"{side}_id"), F.col("fullname").alias(f"{side}_name")), f"{side}_id", "left")
    return edge_rows


def occurrences(present: DataFrame, sentence: str = "sentence_id", entity: str = "canonical_id", lists: bool = False) -> DataFrame:
    """(entity, count of its sentences), and their sorted list if asked; sentences with one entity count too.

    A list is one value, however long; occurrence_sentences() has them in parts.
    """
    out = [F.count("*").alias("count")] + ([F.sort_array(F.collect_list(sentence)).alias("sentence_ids")] if lists else [])
    return present.groupBy(entity).agg(*out)


def occurrence_sentences(present: DataFrame, sentence: str = "sentence_id", entity: str = "canonical_id", size: int = CHUNK) -> DataFrame:
    """(entity, chunk, sentence_ids): each entity's sentences in order, in numbered lists of up to `size`."""
    return chunks(present, [entity], sentence, size).withColumnRenamed("values", "sentence_ids")


def top_pairs(edge_rows: DataFrame, k: int = 10) -> DataFrame:
    """The k heaviest edges, ties by ids."""
    return edge_rows.orderBy(F.desc("weight"), "source_id", "target_id").limit(k)
