"""Subject-verb-object triples from dependency annotations, by patterns of relations.

tokens: sentence_id, token_id, word, lemma, pos, tag, dep, head_id; token ids are unique. A verb is a token of part
VERB. A pattern says how a subject or an object is reached from its verb: a path of relations, down to children or up
to heads. Patterns are data: they become joins of tokens with their heads. A verb without a subject that is coordinated
with another takes that one's, however long the chain. Coordinated nouns (conj) are subjects or objects of their own; a
noun takes along its compounds, recursively, a clause everything under it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ROWS, shared_checkpoint, shuffled, tasks_for
from .trees import forests, under

AUXILIARIES = ("aux", "auxpass")


@dataclass(frozen=True)
class Pattern:
    """How a subject or object is reached from a verb: steps of (down or up, relations). An up step goes to the head of a token
    that hangs there by one of the relations. `whole` takes everything under what is reached; `fallback` counts only for
    verbs for which the side's other patterns give nothing."""

    side: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    whole: bool = False
    fallback: bool = False


PATTERNS = (
    Pattern("subject", (("down", ("nsubj", "nsubjpass")),)),
    Pattern("subject", (("down", ("csubj", "csubjpass")),), whole=True),
    Pattern("object", (("down", ("dobj", "obj")),)),
    Pattern("object", (("down", ("agent",)), ("down", ("pobj",)))),
    Pattern("object", (("down", ("xcomp", "ccomp")),), whole=True, fallback=True),
)
#: More that can be asked for: nouns that a clause modifies, further objects, and clauses that say what for.
MODIFIED = Pattern("subject", (("up", ("relcl", "acl")),), fallback=True)
RECIPIENT = Pattern("object", (("down", ("dative", "iobj")),))
ATTRIBUTE = Pattern("object", (("down", ("attr", "acomp")),))
PREPOSITIONAL = Pattern("object", (("down", ("prep",)), ("down", ("pobj",))))
PURPOSE = Pattern("object", (("down", ("advcl",)),), whole=True, fallback=True)


def reached(tokens: DataFrame, verbs: DataFrame, path: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """(verb, token_id): where a path leads from each of verbs(verb)."""
    now = verbs.select("verb", F.col("verb").alias("token_id"))
    for direction, relations in path:
        if direction not in ("down", "up"):
            raise ValueError(f"no direction: {direction}")
        at, to = ("head_id", "token_id") if direction == "down" else ("token_id", "head_id")
        step = tokens.where((F.col("token_id") != F.col("head_id")) & F.col("dep").isin(*relations)).select(F.col(at).alias("_at"), F.col(to).alias("_to"))
        now = now.join(shuffled(step), F.col("token_id") == F.col("_at")).select("verb", F.col("_to").alias("token_id"))
    return now.distinct()


def _side(tokens: DataFrame, verbs: DataFrame, patterns: tuple[Pattern, ...], side: str) -> DataFrame:
    """(verb, token_id, whole) of all patterns of a side."""
    def of(fallback: bool) -> DataFrame | None:
        rows = [reached(tokens, verbs, p.path).withColumn("whole", F.lit(p.whole)) for p in patterns if p.side == side and p.fallback == fallback]
        return reduce(DataFrame.unionByName, rows).distinct() if rows else None

    firm, rest = of(False), of(True)
    if firm is None or rest is None:
        found = rest if firm is None else firm
        return verbs.select("verb", F.lit(None).cast("long").alias("token_id"), F.lit(False).alias("whole")).limit(0) if found is None else found
    return firm.unionByName(rest.join(shuffled(firm.select("verb").distinct()), "verb", "left_anti"))


def _children(tokens: DataFrame, *deps: str) -> DataFrame:
    rows = tokens.where(F.col("token_id") != F.col("head_id"))
    return (rows.where(F.col("dep").isin(*deps)) if deps else rows).select(F.col("head_id").alias("parent"), "token_id")


def compound_closure(tokens: DataFrame, roots: DataFrame, each: int = ROWS) -> DataFrame:
    """(root, token_id): each root (token_id) with its compounds and theirs, all levels down. Tasks have about `each` tokens."""
    tasks = tasks_for(tokens.sparkSession, tokens.count(), each)
    return under(shared_checkpoint(forests(tokens, tasks=tasks, compound=F.col("dep") == "compound")), roots, "compound", tasks)


def noun_info(tokens: DataFrame, closure: DataFrame) -> DataFrame:
    """(root, ids, text, lemma, pos): the tokens of each closure in order; pos is the root's."""
    rows = closure.join(shuffled(tokens.select("token_id", "word", "lemma", "pos")), "token_id")
    listed = rows.groupBy("root").agg(F.sort_array(F.collect_set(F.struct("token_id", "word", "lemma"))).alias("t"), F.max(F.when(F.col("token_id") == F.col("root"), F.col("pos"))).alias("pos"))
    return listed.select("root", F.transform("t", lambda r: r["token_id"]).alias("ids"), F.array_join(F.transform("t", lambda r: r["word"]), " ").alias("text"), F.array_join(F.transform("t", lambda r: r["lemma"]), " ").alias("lemma"), "pos")


def verb_info(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """(verb, verb_id, text, lemma) of groups(verb, token_id): verbs that are no auxiliaries, else what is no auxiliary, else all."""
    rows = groups.join(shuffled(tokens.select("token_id", "word", "lemma", "pos", "dep")), "token_id")
    main = ~F.col("dep").isin(*AUXILIARIES)
    rank = F.when(main & (F.col("pos") == "VERB"), 0).when(main, 1).otherwise(2)
    ranked = rows.withColumn("_r", rank)
    best = ranked.groupBy("verb").agg(F.min("_r").alias("_b"))
    kept = ranked.join(shuffled(best), "verb").where("_r = _b").groupBy("verb").agg(F.sort_array(F.collect_set(F.struct("token_id", "word", "lemma"))).alias("t"))
    return kept.select("verb", F.element_at("t", 1)["token_id"].alias("verb_id"), F.array_join(F.transform("t", lambda r: r["word"]), " ").alias("text"), F.array_join(F.transform("t", lambda r: r["lemma"]), " ").alias("lemma"))


def negated(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """(verb, negated): whether any token of the verb's group has a child that negates it."""
    neg = _children(tokens, "neg").select(F.col("parent").alias("token_id")).distinct().withColumn("_n", F.lit(True))
    return groups.join(shuffled(neg), "token_id", "left").groupBy("verb").agg(F.coalesce(F.bool_or("_n"), F.lit(False)).alias("negated"))


def svo_triples(tokens: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """subject_text, subject_ids, subject_pos, verb_text, verb_lemma, verb_id, object_text, object_ids, object_pos, negated, sentence_id.

    One row for each verb, subject and object. Heads outside the sentence are no heads.
    """
    verbs = tokens.where((F.col("pos") == "VERB") & ~F.col("dep").isin(*AUXILIARIES)).select(F.col("token_id").alias("verb"), "sentence_id", "dep", "head_id")
    own = shared_checkpoint(_side(tokens, verbs, patterns, "subject"))
    having = own.select("verb").distinct()
    # A coordinated verb without a subject hangs under the one before it: at the top of its tree is the nearest that has one.
    lone = verbs.where("dep = 'conj'").join(shuffled(having), "verb", "left_anti").select(F.col("verb").alias("token_id"), F.lit(True).alias("_lone"))
    marked = tokens.select("sentence_id", "token_id", "head_id", "dep").join(shuffled(lone), "token_id", "left")
    tasks = tasks_for(tokens.sparkSession, tokens.count())
    trees = shared_checkpoint(forests(marked, tasks=tasks, any=F.lit(True), compound=F.col("dep") == "compound", conj=F.col("dep") == "conj", lone=F.col("_lone")))

    def spread(rows: DataFrame) -> DataFrame:
        """Nouns with those coordinated with them."""
        nouns = rows.where("not whole")
        more = under(trees, nouns, "conj", tasks).select(F.col("root").alias("token_id"), F.col("token_id").alias("_t"))
        return shared_checkpoint(nouns.join(shuffled(more), "token_id").select("verb", F.col("_t").alias("token_id"), "whole").unionByName(rows.where("whole")).distinct())

    heirs = trees.where("top_lone <> token_id").select(F.col("top_lone").alias("root"), F.col("token_id").alias("verb"))
    shared = own.withColumnRenamed("verb", "root").join(shuffled(heirs), "root").select("verb", "token_id", "whole")
    sides = {"subject": spread(own.unionByName(shared)), "object": spread(_side(tokens, verbs, patterns, "object"))}
    both = sides["subject"].unionByName(sides["object"]).select("token_id", "whole").distinct()
    info = [noun_info(tokens, under(trees, both.where(F.col("whole") == whole), kind, tasks)).withColumn("whole", F.lit(whole)) for whole, kind in ((False, "compound"), (True, "any"))]
    info = shared_checkpoint(info[0].unionByName(info[1]).withColumnRenamed("root", "token_id"))

    def named(side: str) -> DataFrame:
        return sides[side].join(shuffled(info), ["token_id", "whole"]).select("verb", *[F.col(c).alias(f"{side}_{c}") for c in ("text", "ids", "pos")])

    auxiliaries = reached(tokens, verbs, (("down", AUXILIARIES),))
    groups = verbs.select("verb", F.col("verb").alias("token_id")).unionByName(auxiliaries)
    verb = verb_info(tokens, groups).select("verb", "verb_id", F.col("text").alias("verb_text"), F.col("lemma").alias("verb_lemma")).join(shuffled(negated(tokens, groups)), "verb")
    return named("subject").join(shuffled(named("object")), "verb").join(shuffled(verb), "verb").join(shuffled(verbs.select("verb", "sentence_id")), "verb").drop("verb")


def chunked(triples: DataFrame) -> DataFrame:
    """One row per run of consecutive subject ids and run of consecutive object ids, with their words."""
    def runs(ids: str, text: str):
        breaks = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0))), lambda i: (i == 0) | (F.get(ids, i) != F.get(ids, i - 1) + 1))
        ends = F.concat(F.slice(breaks, F.lit(2), F.greatest(F.size(breaks) - 1, F.lit(0))), F.array(F.size(ids)))
        return F.transform(F.arrays_zip(breaks.alias("a"), ends.alias("b")), lambda r: F.struct(F.slice(ids, r["a"] + 1, r["b"] - r["a"]).alias("ids"), F.array_join(F.slice(F.split(text, " "), r["a"] + 1, r["b"] - r["a"]), " ").alias("text")))

    rest = [c for c in triples.columns if c not in ("subject_ids", "subject_text", "object_ids", "object_text")]
    rows = triples.withColumn("_s", F.explode(runs("subject_ids", "subject_text"))).withColumn("_o", F.explode(runs("object_ids", "object_text")))
    return rows.select(*rest, F.col("_s.text").alias("subject_text"), F.col("_s.ids").alias("subject_ids"), F.col("_o.text").alias("object_text"), F.col("_o.ids").alias("object_ids"))
