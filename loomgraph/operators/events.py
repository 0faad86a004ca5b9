"""Character events, agent-verb-patient triples, and the union of triple sources.

Order-dependent rules carry explicit ordinals: no rule depends on the order in which Spark holds rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ROWS, shuffled, tasks_for


def flatten_characters(characters: DataFrame) -> DataFrame:
    """One row per agent or patient event of each character: character_id, pos, names, common, role, word, index, gender, role_pos, word_pos.

    Characters without either role vanish; other roles are not read.
    """
    def events(role: str, order: int) -> Column:
        own = F.coalesce(F.col(role), F.array().cast("array<struct<w:string,i:bigint>>"))
        return F.transform(own, lambda e, k: F.struct(F.lit(role).alias("role"), e["w"].alias("word"), e["i"].alias("index"), F.lit(order).alias("role_pos"), k.alias("word_pos")))

    def words(kind: str) -> Column:
        return F.coalesce(F.transform(F.col(f"mentions.{kind}"), lambda m: m["n"]), F.array().cast("array<string>"))

    rows = characters.select(F.col("id").alias("character_id"), "pos", words("proper").alias("names"), words("common").alias("common"), F.coalesce("g.argmax", F.lit("")).alias("gender"), F.explode(F.concat(events("agent", 0), events("patient", 1))).alias("e"))
    return rows.select("character_id", "pos", "names", "common", "gender", "e.*")


def with_names(events: DataFrame) -> DataFrame:
    """Events with at least one proper or common name."""
    return events.where((F.size("names") > 0) | (F.size("common") > 0))


def allow_common(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Events with proper names, and those with common names only if `allowed` (character_id) has their character."""
    listed = allowed.select("character_id").distinct().withColumn("_listed", F.lit(True))
    joined = events.join(listed, "character_id", "left")
    return joined.where((F.size("names") > 0) | ((F.size("common") > 0) & F.col("_listed"))).drop("_listed")


def override(df: DataFrame, key: str, keys: list, values: dict) -> DataFrame:
    """Set the columns of `values` where `key` is one of `keys`."""
    return df.withColumns({c: F.when(F.col(key).isin(*keys), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def explode_names(events: DataFrame) -> DataFrame:
    """One row per event and name, proper names before common ones; name_pos is the name's place. Duplicates stay."""
    return events.select("*", F.posexplode(F.concat("names", "common")).alias("name_pos", "name")).drop("names", "common")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the order given."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")


def pair_roles(events: DataFrame, on: str = "index", who: str = "canonical_id", each: int = ROWS) -> DataFrame:
    """Agents and patients of the same event, in columns ending in _left and _right; nobody with themselves.

    Roles are filtered before the join, so pairs of equal roles and mirrored pairs never come up. Where there
    are more events than `each` for every core, a task has about so many.
    """
    spark = events.sparkSession
    tasks = tasks_for(spark, events.where(F.col("role").isin("agent", "patient")).count(), each)
    large = tasks > spark.sparkContext.defaultParallelism

    def side(role: str, end: str) -> DataFrame:
        rows = events.where(F.col("role") == role).select(on, *[F.col(c).alias(c + end) for c in events.columns if c != on])
        return rows.repartition(tasks, on) if large else rows

    return side("agent", "_left").join(shuffled(side("patient", "_right")), on).where(F.col(f"{who}_left") != F.col(f"{who}_right"))


def avp_triples(events: DataFrame, tokens: DataFrame | None = None, order: list[str] = ["pos"], span: tuple[int, int] | None = None) -> DataFrame:
    """Agent-verb-patient triples, the first of each (left, index, right); with lemma, sentence_id and negated if tokens are given.

    `order` names the columns that order events; `span` keeps events whose index lies in it, both ends included.
    """
    rows = events.where(F.col("index").between(*span)) if span else events
    ends = [f"{c}{e}" for e in ("_left", "_right") for c in order]
    triples = keep_first(pair_roles(rows), ["canonical_id_left", "index", "canonical_id_right"], ends)
    if tokens is None:
        return triples
    lookup = tokens.select(F.col("token_id").alias("index"), "lemma", "sentence_id")
    return triples.join(shuffled(lookup), "index", "left").join(shuffled(negated_verbs(tokens).withColumnRenamed("verb_id", "index")), "index", "left").withColumn("negated", F.coalesce("negated", F.lit(False)))


def negated_verbs(tokens: DataFrame, relation: str = "neg") -> DataFrame:
    """(verb_id, negated = true) of tokens that some token of their sentence depends on as a negation."""
    child = tokens.where(F.col("dep") == relation).select(F.col("head_id").alias("verb_id"), F.col("sentence_id").alias("_s")).distinct()
    verb = tokens.select(F.col("token_id").alias("verb_id"), F.col("sentence_id").alias("_v"))
    return child.join(shuffled(verb), "verb_id").where("_s = _v").select("verb_id").distinct().withColumn("negated", F.lit(True))


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with its columns renamed by position."""
    return df.toDF(*columns)


def combine(first: DataFrame, second: DataFrame, keys: list[str], order: list[str], rename_roles: dict[str, str] | None = None) -> DataFrame:
    """Both sources as one; of equal keys the row of `first` stays, then the first in `order`."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    if rename_roles:
        mapping = F.create_map(*[F.lit(x) for kv in rename_roles.items() for x in kv])
        both = both.withColumns({c: F.coalesce(F.element_at(mapping, F.col(c)), F.col(c)) for c in ("role_left", "role_right") if c in both.columns})
    return keep_first(both, keys, ["_source", *order]).drop("_source")


def layout(triples: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in file order; those missing are null."""
    return triples.select(*[F.col(c) if c in triples.columns else F.lit(None).cast("string").alias(c) for c in columns])
