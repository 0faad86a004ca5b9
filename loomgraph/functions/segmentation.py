"""Sentences by what a corpus itself says about its abbreviations (Kiss and Strunk's unsupervised method, by aggregates).

A word type is an abbreviation if it stands with a full stop far more often than full stops would make it by chance, is
short, has full stops inside, and hardly ever stands without one. A word is a sentence starter if it follows ends of
sentences that aren't in doubt far more often than by chance. Texts are cut by the plain rule first; a cut after an
abbreviation or an initial is taken back unless a starter follows, and so is one before a small letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint
from .text import sentences

# Fixed values of the published method: the least score of an abbreviation and of a starter, and the share of full stops that
# an abbreviation is held against.
ABBREVIATION, STARTER, CERTAIN = 0.3, 30.0, 0.99


def _likelihood(both: Column, own: Column, chance: Column, held: Column | float) -> Column:
    """Twice the log likelihood ratio of `both` among `own` under a share `held` against one of `chance`."""
    held = F.lit(held) if isinstance(held, float) else held
    under = lambda p: both * F.log(F.greatest(p, F.lit(1e-9))) + (own - both) * F.log(F.greatest(1 - p, F.lit(1e-9)))
    return 2 * (under(held) - under(chance))


def _types(docs: DataFrame) -> DataFrame:
    """(w, stopped, open): how often each word stands with a full stop at its end, and without."""
    # Equal words are counted before they are looked at.
    seen = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("x")).groupBy("x").agg(F.count("*").alias("n")).where(F.col("x").rlike(r"\p{L}"))
    bare = F.regexp_replace("x", r"^[^\p{L}]+|[^\p{L}\p{N}]+$", "")
    stopped = F.col("x").rlike(r"\.[^\p{L}\p{N}]*$")
    return seen.groupBy(bare.alias("w")).agg(F.sum(F.when(stopped, F.col("n")).otherwise(0)).alias("stopped"), F.sum(F.when(stopped, 0).otherwise(F.col("n"))).alias("open"))


def word_types(docs: DataFrame) -> DataFrame:
    """(w, stopped, open) of docs(text), for abbreviations() and starters() of the same texts: counted once."""
    return shared_checkpoint(_types(docs))


def abbreviations(docs: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(w, score) of the abbreviations of docs(text), in small letters and without the last full stop."""
    types = (word_types(docs) if types is None else types).where("w <> ''")
    total = types.agg(F.sum("stopped"), F.sum(F.col("stopped") + F.col("open"))).first()
    chance = (total[0] or 0) / max(total[1] or 0, 1)
    letters = F.length(F.replace("w", F.lit("."), F.lit("")))
    score = _likelihood(F.col("stopped"), F.col("stopped") + F.col("open"), F.lit(chance), CERTAIN) * (F.length("w") - letters + 1) * F.exp(-letters) * F.pow(letters.cast("double"), -F.col("open"))
    return types.where("stopped > 0").select("w", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def _pieces(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, i, piece, ending, first): pieces by the plain rule, the last word of the one before, and the first word."""
    # A piece and the one before it, side by side: rows don't carry their text's other pieces.
    every = sentences(F.col("text"))
    shifted = F.slice(F.concat(F.array(F.lit(None).cast("string")), every), F.lit(1), F.size(every))
    both = F.zip_with(every, shifted, lambda piece, before: F.struct(piece.alias("piece"), before.alias("before")))
    rows = docs.select(id_col, F.posexplode(both).alias("i", "_x")).select(id_col, "i", "_x.piece", "_x.before")
    before = F.col("before")
    # A search for the last word from the front would try every place.
    word = F.element_at(F.split(before, r"\s+"), -1)
    ending = F.when(word.rlike(r"\.[^\p{L}\p{N}]*$"), F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}\p{N}]+$", ""))
    return rows.select(id_col, "i", "piece", ending.alias("ending"), F.regexp_extract("piece", r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1).alias("first"))


def starters(docs: DataFrame, short: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(first, score) of the words that begin sentences of docs(text), given its abbreviations."""
    pieces = _pieces(docs.select(F.monotonically_increasing_id().alias("_row"), "text"), "_row").where("ending is not null and first <> ''")
    sure = pieces.join(short.select(F.col("w").alias("_w")), F.lower("ending") == F.col("_w"), "left_anti").where(F.length("ending") > 1)
    begun = sure.groupBy(F.lower("first").alias("first")).agg(F.count("*").alias("n"))
    types = (word_types(docs) if types is None else types).groupBy(F.col("w").alias("first")).agg(F.sum(F.col("stopped") + F.col("open")).alias("all"))
    joined = shared_checkpoint(begun.join(types, "first").withColumn("n", F.least("n", "all")))
    ends, words = joined.agg(F.sum("n")).first()[0] or 0, types.agg(F.sum("all")).first()[0] or 0
    chance = ends / max(words, 1)
    score = _likelihood(F.col("n"), F.col("all"), F.lit(chance), F.col("n") / F.col("all"))
    return joined.where(F.col("n") / F.col("all") > chance).select("first", score.alias("score")).where(F.col("score") >= STARTER)


def segment_learnt(docs: DataFrame, short: DataFrame, begins: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, sentence_id from 0, sentence) of docs, which have unique ids. Pieces that are put together again are joined by one space.

    Null texts have no sentences; an empty text is one empty sentence.
    """
    pieces = _pieces(docs.where("text is not null"), id_col)
    known = short.select(F.col("w").alias("_w")).distinct().withColumn("_short", F.lit(True))
    start = begins.select(F.col("first").alias("_f")).distinct().withColumn("_start", F.lit(True))
    marked = pieces.join(known, F.lower("ending") == F.col("_w"), "left").join(start, F.lower("first") == F.col("_f"), "left")
    doubt = F.coalesce(F.col("_short"), F.lit(False)) | F.coalesce(F.col("ending").rlike(r"^\p{Lu}$"), F.lit(False))
    small = F.col("ending").isNotNull() & F.col("first").rlike(r"^\p{Ll}")
    goes_on = (F.col("i") > 0) & ((doubt & (F.col("_start").isNull() | ~F.col("first").rlike(r"^\p{Lu}"))) | small)
    # A text's pieces.
    window = Window.partitionBy(id_col).orderBy("i")
    numbered = marked.withColumn("sentence_id", (F.sum(F.when(goes_on, 0).otherwise(1)).over(window) - 1).cast("int"))
    joined = numbered.groupBy(id_col, "sentence_id").agg(F.sort_array(F.collect_list(F.struct("i", "piece"))).alias("p"))
    return joined.select(id_col, "sentence_id", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("sentence"))
