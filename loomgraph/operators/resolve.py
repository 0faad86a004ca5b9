"""Names to canonical entities: variants, scored candidates, gating by gender, canonical ids and summaries.

Distinct queries are scored once, however often they occur, against the variants that an index proposes (see likeness).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name, split_list
from . import likeness
from .events import keep_first

# Titles by gender.
TITLES = {"m": ("mr", "mister"), "f": ("mrs", "ms", "miss")}
#: What a score is multiplied by where genders differ, and where a single word of the query matched.
OTHER_GENDER, SINGLE_WORD = 0.8, 0.9


def name_variants(names: DataFrame, titles: dict[str, tuple[str, ...]] = TITLES) -> DataFrame:
    """(variant, id, id_order, gender, fullname): every normalised form of every dictionary row, '' left out.

    `names` has id, fullname, firstname, middlename, surname, gender, aka and profession, and row, its order.
    """
    part = {c: normalize_name(F.col(c)) for c in ("fullname", "firstname", "middlename", "surname")}
    both = lambda a, b: F.when((a != "") & (b != ""), normalize_name(F.concat(a, F.lit(" "), b))).otherwise("")
    forms = [part["fullname"], part["firstname"], part["middlename"], part["surname"], both(part["firstname"], part["surname"]), both(part["firstname"], part["middlename"])]
    titled = F.array().cast("array<string>")
    for gender, own in titles.items():
        # A title stands with a name only, not alone.
        with_title = [F.when(part[c] != "", normalize_name(F.concat(F.lit(t + " "), part[c]))).otherwise("") for t in own for c in ("surname", "fullname")]
        titled = F.when((F.col("gender") == gender) & (part["surname"] != ""), F.array(*with_title)).otherwise(titled)
    listed = [F.transform(split_list(F.col(c)), normalize_name) for c in ("aka", "profession")]
    every = F.filter(F.array_distinct(F.concat(F.array(*forms), titled, *listed)), lambda v: v != "")
    return names.select(F.explode(every).alias("variant"), "id", F.col("row").alias("id_order"), "gender", "fullname")


def known_tokens(variants: DataFrame) -> DataFrame:
    """(token) of all variants, distinct."""
    return variants.select(F.explode(F.split("variant", " ")).alias("token")).distinct()


def top_matches(queries: DataFrame, variants: DataFrame, k: int = 10, threshold: float = 60.0) -> DataFrame:
    """(query, variant, score, place) of the k best variants of each distinct query at or above the threshold.

    Ties go to the variant of the earliest dictionary row, then by text.
    """
    listed = variants.groupBy("variant").agg(F.min("id_order").alias("id_order"))
    return likeness.top(queries.select("query"), listed, k, threshold)


def gate(candidates: DataFrame, asked: DataFrame, variants: DataFrame, threshold: float = 60.0) -> DataFrame:
    """(query, gender, id, fullname, score, corrected_gender): the first acceptable dictionary row of each asked (query, gender).

    Candidates are tried by place, a variant's rows in dictionary order. Unknown gender accepts nothing; another
    gender than the dictionary's is accepted if the score times 0.8 still reaches the threshold, and is noted.
    """
    rows = asked.where("gender in ('m', 'f')").select("query", "gender").distinct().join(candidates, "query").join(variants.withColumnRenamed("gender", "own"), "variant")
    same = F.col("gender").eqNullSafe(F.col("own"))
    fine = rows.where(same | (F.col("score") * OTHER_GENDER >= threshold))
    first = keep_first(fine, ["query", "gender"], ["place", "id_order", "id"])
    return first.select("query", "gender", "id", "fullname", "score", F.when(~F.col("gender").eqNullSafe(F.col("own")), F.col("own")).alias("corrected_gender"))


def match_names(mentions: DataFrame, names: DataFrame, titles: list[str], stop_words: list[str], threshold: float = 60.0, k: int = 10) -> DataFrame:
    """mentions(name, gender, ...) with matched_id, matched_fullname, match_score and corrected_gender.

    The whole cleaned name is tried first, then each of its known words of three letters or more in order, at 0.9
    of the score. Without a match the id is null, the name is the mention's own and the score 0.
    """
    variants = name_variants(names)
    # Words are looked up by a join, so that the dictionary's words needn't be in one place.
    asked = mentions.select("name", "gender").distinct()
    split = asked.select("name", "gender", F.posexplode(F.split(normalize_name(F.col("name")), " ")).alias("p", "token"))
    marked = split.join(known_tokens(variants).withColumn("known", F.lit(True)), "token", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    kept = marked.where(F.col("known") | F.col("token").isin(*titles) | (~F.col("token").isin(*stop_words) & (F.length("token") > 2)))
    # As many words as a name has.
    words = F.sort_array(F.collect_list(F.struct("p", "token", "known")))
    cleaned = kept.groupBy("name", "gender").agg(words.alias("w")).select("name", "gender", "w", F.array_join(F.col("w.token"), " ").alias("query"))
    single = F.transform(F.filter("w", lambda x: x["known"] & (F.length(x["token"]) > 2)), lambda x, i: F.struct((i + 1).alias("turn"), x["token"].alias("q"), F.lit(SINGLE_WORD).alias("factor")))
    tries = cleaned.select("name", "gender", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("turn"), F.col("query").alias("q"), F.lit(1.0).alias("factor"))), single)).alias("t")).select("name", "gender", "t.turn", F.col("t.q").alias("query"), "t.factor")
    best = gate(top_matches(tries, variants, k, threshold), tries, variants, threshold)
    hits = keep_first(tries.join(best, ["query", "gender"]), ["name", "gender"], ["turn"])  # names without a word left have no tries
    found = hits.select("name", "gender", F.col("id").alias("matched_id"), F.col("fullname").alias("matched_fullname"), (F.col("score") * F.col("factor")).alias("match_score"), "corrected_gender")
    joined = mentions.join(found.withColumnsRenamed({"name": "_n", "gender": "_g"}), mentions["name"].eqNullSafe(F.col("_n")) & mentions["gender"].eqNullSafe(F.col("_g")), "left").drop("_n", "_g")
    return joined.withColumns({"matched_fullname": F.coalesce("matched_fullname", "name"), "match_score": F.coalesce("match_score", F.lit(0.0))})


def canonical_ids(matched: DataFrame) -> DataFrame:
    """matched with canonical_id: the least character_id of matched rows of the same matched_fullname, else its own."""
    least = matched.where("matched_id is not null").groupBy("matched_fullname").agg(F.min("character_id").alias("canonical_id"))
    return matched.join(least, "matched_fullname", "left").withColumn("canonical_id", F.coalesce("canonical_id", "character_id"))


def canonical_summary(matched: DataFrame, order: str = "pos") -> DataFrame:
    """(canonical_id, fullname, original_ids, avg_score): first name in order that is not null, sorted distinct ids, mean score."""
    return matched.groupBy("canonical_id").agg(
        F.min_by("matched_fullname", F.when(F.col("matched_fullname").isNotNull(), F.col(order))).alias("fullname"),
        F.sort_array(F.collect_set("character_id")).alias("original_ids"),
        F.avg("match_score").alias("avg_score"),
    )


def variants_seen(matched: DataFrame, order: str = "pos") -> DataFrame:
    """(canonical_id, name_variants): the distinct names of each canonical entity in the order first seen."""
    first = matched.groupBy("canonical_id", "name").agg(F.min(order).alias("_first"))
    rows = F.sort_array(F.collect_list(F.struct("_first", "name")))  # distinct names only
    return first.groupBy("canonical_id").agg(F.array_distinct(F.transform(rows, lambda r: r["name"])).alias("name_variants"))


def merge(matched: DataFrame, order: str = "pos") -> DataFrame:
    """Resolved events: the first of each (canonical_id, role, word, index), with the entity's summary and variants.

    Entities whose mean score is exactly 0 are dropped.
    """
    summary = canonical_summary(matched, order).where("avg_score <> 0").join(variants_seen(matched, order), "canonical_id", "left")
    first = keep_first(matched, ["canonical_id", "role", "word", "index"], [order])
    return first.select("canonical_id", "role", "word", "index", "gender", order).join(summary, "canonical_id").withColumnRenamed("fullname", "name")
