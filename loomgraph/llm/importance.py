"""Resampling towards a target distribution by hashed n-gram importance weights, in DataFrame functions alone.

Every n-gram falls in a bucket by the crc32 of its bytes. A bucket's gain is the logarithm of how much likelier it is among
the target's n-grams than among the documents', each smoothed by one; a document's weight is the sum of its n-grams'
gains. A number drawn from the Gumbel distribution by a hash of the document's id is added, so that the highest scores are a
sample without replacement in proportion to exp(weight). Ranks come from a range-partitioned sort: a row's place in its
partition and the rows of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Everything that is not one of these is part of a word: ASCII but for letters and digits.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, with A to Z in lower case; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))


def ngrams(found: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by a space."""
    run, every = found, [found]
    for n in range(2, longest + 1):
        # The words from the n-th on end the runs: no lambda holds the array, which would be worked out for each element.
        ends = F.slice(found, F.lit(n), F.greatest(F.size(found) - n + 1, F.lit(0)))
        run = F.zip_with(F.slice(run, F.lit(1), F.greatest(F.size(found) - n + 1, F.lit(0))), ends, lambda a, b: F.concat(a, F.lit(" "), b))
        every.append(run)
    return F.concat(*every) if longest > 1 else found


def bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(gram.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall in each bucket that has any."""
    grams = texts.select(F.explode(ngrams(words(F.col("text")), longest)).alias("gram"))
    return grams.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))), in doubles."""
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    own = bucket_counts(docs, longest, buckets).withColumnRenamed("n", "s")
    aim = bucket_counts(target, longest, buckets).withColumnRenamed("n", "t")
    counts = cut(every.join(own, "bucket", "left").join(aim, "bucket", "left").na.fill(0))
    # Two numbers.
    all_own, all_aim = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t").cast("double") + 1) * F.lit(float(all_own + buckets)) / ((F.col("s").cast("double") + 1) * F.lit(float(all_aim + buckets)))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(identity: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) for a number u in (0, 1) from the hash of `seed:id`; null ids count as empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(identity.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank, 1 for the first in the order given: a sort in ranges, and each range's rows counted."""
    # Within a partition ids are consecutive, and the partition's number is in the bits above.
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # A row for each partition.
    sizes = [(r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()]
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(table), "_part")
    return joined.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: float = 10, min_words: int = 20, seed: str = "2024", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (null if it is not drawn).

    target has texts of the distribution to come near to. Of the N rows with at least `min_words` words, floor(percent *
    N / 100) are drawn: the highest scores, ties to the smaller doc_id, then to the smaller weight and fewer features.
    Null and empty texts have no features and weight 0, and so has every document if both tables are empty. A null id
    is hashed as empty text and comes first among equal scores. Repeated rows are counted and drawn each for itself; texts
    of any length are read whole; an empty table gives no rows, an empty target is one without a feature; columns besides
    the id and text are not looked at.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), "text")
    # At most `buckets` rows of two numbers.
    gains = F.broadcast(gain_table(own, target.select("text"), longest, buckets))
    found = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    grams = found.select("row", "doc_id", F.size("words").alias("n_words"), F.explode_outer(ngrams(F.col("words"), longest)).alias("gram"))
    joined = grams.select("row", "doc_id", "n_words", bucket(F.col("gram"), buckets).alias("bucket")).join(gains, "bucket", "left")
    # A document's n-grams are beside each other, so they are summed where they are read.
    summed = joined.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = cut(summed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")))
    eligible = scored.where(F.col("n_words") >= min_words)
    drawn = int(percent * eligible.count() // 100)
    placed = ranked(eligible, F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def _crc_table() -> list[int]:
    """The 256 remainders of crc32."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def sql(buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024") -> str:
    """resample() of single words from `documents` towards `benchmark`, in DuckDB's SQL."""
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}')"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(w)), 2), lambda i: ('0x' || substr(hex(w), i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    return f"""
WITH remainders AS (SELECT [{", ".join(map(str, _crc_table()))}]::BIGINT[] AS t),
rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {split} AS ws FROM documents),
own AS MATERIALIZED (SELECT r, unnest(ws) AS w FROM rows),
aim AS MATERIALIZED (SELECT unnest({split}) AS w FROM benchmark),
hashed AS MATERIALIZED (SELECT w, xor({crc}, 4294967295) % {buckets} AS b FROM (SELECT w FROM own UNION SELECT w FROM aim), remainders),
s AS (SELECT b, count(*)::DOUBLE AS n FROM own JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*)::DOUBLE AS n FROM aim JOIN hashed USING (w) GROUP BY b),
gains AS MATERIALIZED (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM own)::DOUBLE + {buckets}) / ((s.n + 1) * ((SELECT count(*) FROM aim)::DOUBLE + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
summed AS (SELECT r, sum(gain)::BIGINT AS weight FROM own JOIN hashed USING (w) JOIN gains USING (b) GROUP BY r),
scored AS MATERIALIZED (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM rows LEFT JOIN summed USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS k FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= ({percent} * (SELECT count(*) FROM placed)) // 100 THEN k END AS rank FROM scored LEFT JOIN placed USING (r)"""
