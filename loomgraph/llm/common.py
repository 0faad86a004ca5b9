"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many classes are few.
FEW = 1000
#: Texts are handled in slices of about so many characters, so that memory doesn't follow the batch.
SLICE_CHARS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where the session names none and runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and the table's path, for drop_folder: smaller than a checkpoint where rows hold text."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of plans that nothing refers to any more, so that disk holds one step's."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(column: str, n: int):
    """crc32(column as text) mod n, as a Spark column; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def crc32_text(value) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `limit` bytes; one row at least."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(df: DataFrame, columns: list[str], schema: str, work: Callable[[dict[str, list]], dict[str, Iterable]], names: list[str] | None = None) -> DataFrame:
    """mapInArrow over `columns` of df; `work` gets lists by column name for each slice and returns lists or arrays by output name.

    Only the columns named are sent to Python; columns that df has besides are not looked at.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = work({name: part.column(name).to_pylist() for name in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def keep_texts(df: DataFrame, keep: Callable[[list], np.ndarray], column: str = "text", limit: int = SLICE_CHARS) -> DataFrame:
    """The rows of df that `keep` wants, given the texts of a slice; all columns pass through as they are, without a shuffle."""

    # Columns have plain names on the way, as those with dots can't be sent to Python.
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    text = f"c{df.columns.index(column)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                yield part.filter(pa.array(keep(part.column(text).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


class WordTable:
    """Values of words, worked out once for each distinct word while it stays in the table.

    `compute` maps a list of distinct words to an array with a row for each. The table is emptied when it
    would pass `limit` words, or a hundred characters for each of them, so a worker's memory is bounded whatever it
    reads; a word's value must be a function of the word alone, so that it doesn't depend on that.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = 400_000):
        self.compute, self.limit = compute, limit
        self.index: dict[str, int] = {}
        self.values: np.ndarray | None = None
        self.used = self.chars = 0

    def __call__(self, words: list[str]) -> np.ndarray:
        """The values' rows, in the words' order."""
        return self.values_of(self.rows(words))

    def values_of(self, rows: np.ndarray) -> np.ndarray:
        return self.values[rows]

    def rows(self, words: list[str]) -> np.ndarray:
        distinct = set(words)
        missing = list(distinct.difference(self.index))
        if missing or self.values is None:
            if self.used + len(missing) > self.limit or self.chars > 100 * self.limit:
                self.index, self.used, self.chars, missing = {}, 0, 0, list(distinct)
            self.chars += sum(map(len, missing))
            got = self.compute(missing)
            if self.values is None or self.used + len(got) > len(self.values):
                grown = np.empty((max(1024, 2 * (self.used + len(got))), *got.shape[1:]), got.dtype)
                if self.used:
                    grown[: self.used] = self.values[: self.used]
                self.values = grown
            self.values[self.used : self.used + len(got)] = got
            self.index.update(zip(missing, range(self.used, self.used + len(got))))
            self.used += len(got)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def bounded_sample(df: DataFrame, key: str, limit: int, seed: int = 17, by: str | None = None) -> DataFrame:
    """At most `limit` values of `key` (for each value of `by`, if given) with one row each, the first in the order of a hash.

    The sample is for fitting only; which rows it takes depends on their values alone, not on partitions. Of rows with
    equal keys the least by its other columns stands for all. Rows are first thinned where they are, by the same hash,
    to about twice the limit, so that no task gathers or orders more; a key that is repeated however often is
    aggregated before it is moved. Rows whose `by` is null are left out. Counts of up to FEW values of `by` become part
    of the plan; those of more values are joined.
    """
    from pyspark.sql import Window

    by_ = F.lit(0) if by is None else F.col(by)
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rest = [c for c in df.columns if c not in (key, by)]
    marked = df.withColumn("_place", place).withColumn("_by", by_).where("_by is not null")
    sizes = marked.groupBy("_by").agg(F.approx_count_distinct("_place", 0.02).alias("_n"))
    few = sizes.limit(FEW + 1).collect()
    if 0 < len(few) <= FEW:
        counts = F.create_map(*[F.lit(x) for row in few for x in (row["_by"], row["_n"])])
        marked = marked.withColumn("_n", F.element_at(counts, F.col("_by")))
    else:
        marked = marked.join(sizes, "_by")
    # The count may be off by a few per cent, the margin is twofold.
    thinned = marked.where(F.col("_place") * F.col("_n") < 2 * limit + 100)
    single = thinned.groupBy("_by", key, "_place").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_rest")) if rest else thinned.select("_by", key, "_place").distinct()
    window = Window.partitionBy("_by").orderBy("_place", key)
    chosen = single.withColumn("_k", F.row_number().over(window)).where(F.col("_k") <= limit)
    return chosen.select(*[F.col("_by").alias(c) if c == by else F.col(key) if c == key else F.col("_rest")[c].alias(c) for c in df.columns])


def labelled_texts(docs: DataFrame, known: DataFrame, limit: int, chars: int) -> list[tuple[str, object]]:
    """(text, label) of a bounded sample of known(doc_id, label), for fitting: for each label at most `limit` documents, and
    no more once their texts have `chars` characters together.

    Texts are whole, and every label has one at least, however long. Documents without a text are left out; of rows
    with equal ids the least text counts. A document with several labels counts for the least. The order is that of
    (label, hash of the id), whatever the partitions.
    """
    from pyspark.sql import Window

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = cut(known.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")).join(ids, "doc_id", "left_semi"))
    chosen = bounded_sample(held, "doc_id", limit, by="label")
    # Bounded: `limit` ids for each label.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    single = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), "doc_id")
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = single.withColumn("_k", F.row_number().over(order)).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < chars)
    return [(r.text, r.label) for r in kept.orderBy("label", "_k").select("text", "label").collect()]


#: A key with more rows than this, and than one in HOT_SHARE of all, is hot.
HOT_ROWS, HOT_SHARE = 100_000, 10_000


def join_by(rows: DataFrame, table: DataFrame, keys: list[str], times: str) -> DataFrame:
    """rows joined with table, which has each of the keys once, and in `times` how many rows have it.

    Keys with very many rows are few, HOT_SHARE at most: their part of the table is broadcast, so that the rows stay where
    they are; only the others are shuffled.
    """
    total = table.agg(F.sum(times)).first()[0] or 0
    if total > HOT_ROWS:
        limit = max(HOT_ROWS, total // HOT_SHARE)
        hot = cut(table.where(F.col(times) > limit))
        if not hot.isEmpty():
            # At most HOT_SHARE rows.
            cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(times) <= limit), keys)
            return rows.join(F.broadcast(hot), keys).unionByName(cold)
    return rows.join(table, keys)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a long, b long): the smallest node that links reach.

    Alternating large-star and small-star steps; each round is an aggregate and a join, and the edges are
    written to the shared folder after it. Nothing is collected but two numbers a round. The hub of a large component has
    one row on the joins' other side, so AQE can split its edges among tasks.
    """
    star = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        star = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
