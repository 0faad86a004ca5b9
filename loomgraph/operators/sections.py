"""Sections of a text as ranges of sentences or tokens, and what falls in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .spans import interval_join


def section_edges(edge_rows: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per edge instance and section: (division, section, source_id, target_id, sentence_id)."""
    rows = edge_rows.select("source_id", "target_id", F.explode("sentence_ids").alias("sentence_id"))
    return instances_in(rows, sections)


def instances_in(rows: DataFrame, sections: DataFrame) -> DataFrame:
    own = sections.select("division", "section", "sent_lo", "sent_hi")
    return interval_join(rows, own, "sentence_id", "sent_lo", "sent_hi").drop("sent_lo", "sent_hi")


def section_triples(triples: DataFrame, sections: DataFrame) -> DataFrame:
    """Directed, labelled edges of agent-patient triples by section; sections without a token range have none."""
    rows = triples.where("role_left = 'agent' and role_right = 'patient'").select(F.col("name_left").alias("a"), F.col("name_right").alias("b"), F.col("lemma").alias("label"), "index")
    own = sections.where("tok_lo is not null and tok_hi is not null").select("division", "section", "tok_lo", "tok_hi")
    return interval_join(rows, own, "index", "tok_lo", "tok_hi").drop("tok_lo", "tok_hi")


def ranges_from_markers(rows: DataFrame, is_marker: Column, position: str, by: list[str] = [], shifts: dict[int, int] | None = None, default_shift: int = 0) -> DataFrame:
    """(by, section from 0, lo, hi) between markers: each ends before the next begins, the last with the greatest position.

    `shifts` moves the begin of single sections, `default_shift` that of the others.
    """
    ends = rows.groupBy(*by).agg(F.max(position).alias("_last"))
    marks = numbered(rows.where(is_marker).select(*by, F.col(position).alias("_begin")), by, ["_begin"], "section")
    # A marker and the next one meet by their numbers, so that no task sees all of them.
    following = marks.select(*by, (F.col("section") - 1).alias("section"), (F.col("_begin") - 1).alias("_next"))
    listed = marks.join(following, [*by, "section"], "left")
    joined = listed.join(ends, by) if by else listed.join(F.broadcast(ends))  # one row
    moved = F.lit(default_shift)
    for section, shift in (shifts or {}).items():
        moved = F.when(F.col("section") == section, shift).otherwise(moved)
    return joined.select(*by, F.col("section").cast("int").alias("section"), (F.col("_begin") + moved).alias("lo"), F.coalesce("_next", "_last").alias("hi"))
