"""The operators put together: from annotated tables to triples and networks, and from edges to measures by section."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import gender_class
from ..operators import cooccur, deps, events, graph, resolve, spans
from ..session import shared_checkpoint, shuffled


@dataclass
class Settings:
    """What depends on the corpus. Ids are those of character records."""

    titles: list[str] = field(default_factory=lambda: [t for own in resolve.TITLES.values() for t in own])
    stop_words: list[str] = field(default_factory=list)
    threshold: float = 60.0
    common_ids: list[int] = field(default_factory=list)  # records that may be matched by common names
    pronouns: dict[str, list[int]] = field(default_factory=dict)  # pronoun group to the records that get it
    renamed: dict[str, list[int]] = field(default_factory=dict)  # name to records that are it, unmatched


def resolve_characters(characters: DataFrame, names: DataFrame, settings: Settings) -> DataFrame:
    """Every event and name of a character with its match and canonical_id; pos orders them as the records do."""
    spark = characters.sparkSession
    allowed = spark.createDataFrame([(int(i),) for i in settings.common_ids], "character_id bigint")
    rows = events.allow_common(events.with_names(events.flatten_characters(characters)), allowed)
    for pronoun, ids in settings.pronouns.items():
        rows = events.override(rows, "character_id", ids, {"gender": pronoun})
    rows = events.explode_names(rows).withColumn("gender", gender_class(F.col("gender")))
    rows = rows.withColumn("pos", F.struct("pos", "role_pos", "word_pos", "name_pos")).drop("role_pos", "word_pos", "name_pos")
    matched = resolve.match_names(rows, names, settings.titles, settings.stop_words, settings.threshold)
    for name, ids in settings.renamed.items():
        matched = events.override(matched, "character_id", ids, {"matched_id": None, "matched_fullname": name, "match_score": 0.0})
    matched = matched.withColumn("name", F.col("matched_fullname"))
    return shared_checkpoint(resolve.canonical_ids(matched))


def agent_patient_triples(merged: DataFrame, tokens: DataFrame) -> DataFrame:
    return events.avp_triples(merged, tokens, ["pos"])


def subject_object_triples(tokens: DataFrame, entities: DataFrame, summary: DataFrame | None, names: DataFrame, characters: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """Triples whose subject and object both resolve, with their entities' names and genders in the columns of agent-patient triples.

    entities: coref, start_token, end_token, pos (its order). Without a summary of entities the characters are matched with
    the names first.
    """
    if summary is None:
        if characters is None:
            raise ValueError("without a summary, characters are needed to make one")
        summary = resolve.canonical_summary(resolve_characters(characters, names, settings or Settings()))
    raw = shared_checkpoint(deps.chunked(deps.svo_triples(tokens)).withColumn("key", F.monotonically_increasing_id()))
    token_map = shared_checkpoint(spans.span_runs(entities))
    lookup = spans.coref_to_canonical(summary)
    out = raw
    for part, end, role in (("subject", "_left", "subject"), ("object", "_right", "object")):
        corefs = spans.ids_to_corefs(raw.select("key", F.col(f"{part}_ids").alias("ids")), token_map, "ids", "key")
        first = spans.lookup_gender(spans.first_canonical(corefs, lookup, "corefs", "key"), names)
        side = first.join(shuffled(corefs), "key").select("key", F.col("canonical_id").alias(f"canonical_id{end}"), F.col("fullname").alias(f"name{end}"), F.col("gender").alias(f"gender{end}"), F.col("corefs").alias(f"original_ids{end}"), F.lit(role).alias(f"role{end}"))
        out = out.join(shuffled(side), "key")
    return out.select(F.lit("svo").alias("source"), F.col("verb_text").alias("word"), F.col("verb_lemma").alias("lemma"), F.col("verb_id").alias("index"), "negated", "sentence_id", *[c for c in out.columns if c.endswith(("_left", "_right"))])


def statistics(triples: DataFrame) -> DataFrame:
    """(source, n, negated, n_left, n_right, n_entities, n_loops) of triples: for each source, and for all."""
    every = triples.select("source", "negated", "canonical_id_left", "canonical_id_right")
    both = every.unionByName(every.withColumn("source", F.lit("all")))
    counted = both.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("negated").alias("negated"), F.countDistinct("canonical_id_left").alias("n_left"), F.countDistinct("canonical_id_right").alias("n_right"),
        F.count_if(F.col("canonical_id_left") == F.col("canonical_id_right")).alias("n_loops"),
    )
    sides = both.select("source", F.explode(F.array("canonical_id_left", "canonical_id_right")).alias("e")).groupBy("source").agg(F.countDistinct("e").alias("n_entities"))
    return counted.join(sides, "source")


def networks(entities: DataFrame, tokens: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with names and sentence lists, occurrences) of canonical entities."""
    lookup = spans.coref_to_canonical(summary)
    present = cooccur.presence(spans.mentions_in_sentences(entities, tokens).join(lookup.select("coref", "canonical_id"), "coref"))
    named = lookup.select("canonical_id", "fullname").distinct()
    edges = cooccur.name_edges(cooccur.edges(cooccur.pairs(present), lists=True), named)
    return edges, cooccur.occurrences(present, lists=True).join(named, "canonical_id", "left")


def extract(characters: DataFrame, tokens: DataFrame, entities: DataFrame, names: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """matched, summary, merged, avp, svo, combined, edges and occurrences."""
    matched = resolve_characters(characters, names, settings)
    summary = resolve.canonical_summary(matched)
    merged = resolve.merge(matched)
    avp = agent_patient_triples(merged, tokens).withColumn("source", F.lit("avp"))
    svo = subject_object_triples(tokens, entities, summary, names)
    combined = events.combine(avp, svo.withColumn("pos_left", F.lit(None).cast(avp.schema["pos_left"].dataType)), ["canonical_id_left", "index", "canonical_id_right"], ["pos_left", "sentence_id", "word", "original_ids_left", "original_ids_right"], {"subject": "agent", "object": "patient"})
    edges, occurrences = networks(entities, tokens, summary)
    return {"matched": matched, "summary": summary, "merged": merged, "avp": avp, "svo": svo, "combined": combined, "edges": edges, "occurrences": occurrences}


def analyse(edges: DataFrame, keys: list[str], main: DataFrame | None = None) -> DataFrame:
    """(keys, node, measure, value) of each section's simple graph, of its subgraph on main(node) if given; degrees count parallel edges.

    One row for each node and measure; values of measures that didn't settle are NaN.
    """
    nodes, own = (graph.nodes_of(edges, keys), edges) if main is None else graph.induced(edges, main, keys)
    single = graph.simple(own, keys)
    degree = graph.degree_centrality(own, keys, nodes).select(*keys, F.col("node").cast("string").alias("node"), F.lit("degree").alias("measure"), F.col("centrality").alias("value"))
    rest = [graph.measure(single, m, keys, nodes).select(*keys, "node", F.lit(m).alias("measure"), F.when(F.col("converged"), F.col("value")).otherwise(float("nan")).alias("value")) for m in ("closeness", "betweenness", "eigenvector", "katz")]
    return reduce(DataFrame.unionByName, rest, degree)
