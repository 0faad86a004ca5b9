"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffled, table

LEXICON = (("the", 0.4), ("of", -0.2), ("and", 0.1), ("idiot", -2.4), ("trash", -1.9), ("that", 0.7), ("la", 0.3), ("der", -0.6), ("pathetic", -2.2), ("with", 1.1))

PHRASES = (("of the", 1.2), ("la de", -0.8), ("and the", 0.6), ("the of", -1.0))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """An order is a sentence, its suppliers are the entities in it."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sentence_id"), F.col("l_suppkey").alias("canonical_id"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Five overlapping ranges of order keys, one for each region."""
    last = table(spark, d, "orders").agg(F.max("o_orderkey").alias("last"))
    r = table(spark, d, "region").crossJoin(last)
    lo, hi = F.floor(F.col("last") * F.col("r_regionkey") / 5) + 1, F.floor(F.col("last") * (F.col("r_regionkey") + 1) / 5 + F.col("last") / 50)
    return r.select(F.lit("fifths").alias("division"), F.col("r_name").alias("section"), lo.alias("sent_lo"), hi.alias("sent_hi"), lo.alias("tok_lo"), hi.alias("tok_hi"))


def role_events(spark: SparkSession, d: str) -> DataFrame:
    """Customers act on orders, suppliers undergo them; nations stand for both."""
    agent = table(spark, d, "orders").join(shuffled(table(spark, d, "customer")), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("canonical_id"), F.lit("agent").alias("role"), F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("pos"))
    patient = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("canonical_id"), F.lit("patient").alias("role"), F.col("l_orderkey").alias("index"), F.col("l_linenumber").cast("long").alias("pos"))
    return agent.unionByName(patient)


def order_tokens(spark: SparkSession, d: str) -> DataFrame:
    """One token per order: its first line's part names the lemma."""
    first = table(spark, d, "lineitem").where("l_linenumber = 1")
    return first.join(shuffled(table(spark, d, "part")), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("token_id"), F.col("p_name").alias("lemma"), F.expr("l_orderkey div 7").alias("sentence_id"))


def event_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Events as tokens: ten make a sentence, whose first is the head of all; errors negate."""
    return table(spark, d, "events").selectExpr("event_id as token_id", "event_id div 10 as sentence_id", "(event_id div 10) * 10 as head_id", "case when event_type = 'error' then 'neg' else 'dep' end as dep")


def names(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of names from nations."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.selectExpr("n_nationkey as id", "n_nationkey as row", "concat('The ', n_name) as fullname", "r_name as firstname", "cast(null as string) as middlename", "n_name as surname", "case when n_nationkey % 3 = 0 then 'f' else 'm' end as gender", "concat(n_name, ' land; old-', n_name) as aka", "concat(r_name, ' trader') as profession")


def ring(spark: SparkSession, d: str) -> DataFrame:
    """A sparse graph of nations, in two sections that share its first half."""
    return table(spark, d, "nation").selectExpr("cast(n_nationkey as string) as a", "cast((n_nationkey * n_nationkey + 1) % 25 as string) as b", "cast((n_nationkey + 7) % 25 as string) as c", "n_nationkey").selectExpr("explode(array(struct('all' as section, a, b), struct('all' as section, a, c as b), struct(case when n_nationkey < 13 then 'half' end as section, a, c as b))) as e").select("e.*").where("section is not null and a <> b")


def trade(spark: SparkSession, d: str) -> DataFrame:
    """An edge for each line of an order, between the customer's and the supplier's nation, by order year."""
    o = table(spark, d, "orders").join(shuffled(table(spark, d, "customer")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("c_nationkey").alias("a"))
    s = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("b"))
    return o.join(s, F.col("o_orderkey") == F.col("l_orderkey")).select("year", "a", "b")


def dealings(spark: SparkSession, d: str) -> DataFrame:
    """Edges between customers and the suppliers of their orders' lines: a graph that grows with the tables."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey")).alias("a"))
    return o.join(table(spark, d, "lineitem"), "l_orderkey").select("a", F.concat(F.lit("s"), F.col("l_suppkey")).alias("b"))


#: Words of a part, in the order of its clause's tokens: (word, part of speech, relation, head), by kind of clause. All are
#: negated by a last token in every seventh. Words in angle brackets are those of the part's brand and type, if it has as many.
CLAUSES = (
    # Compounds of compounds, with a mark between them.
    (("<brand>", "PROPN", "nsubj", 1), ("ships", "VERB", "ROOT", 1), ("<one>", "NOUN", "compound", 4), (",", "PUNCT", "punct", 4), ("<two>", "NOUN", "compound", 5), ("<three>", "NOUN", "dobj", 1)),
    # A passive with its agent.
    (("<one>", "NOUN", "compound", 1), ("<three>", "NOUN", "nsubjpass", 3), ("is", "AUX", "auxpass", 3), ("shipped", "VERB", "ROOT", 3), ("by", "ADP", "agent", 3), ("<brand>", "PROPN", "pobj", 4)),
    # Three coordinated objects.
    (("<brand>", "PROPN", "nsubj", 1), ("ships", "VERB", "ROOT", 1), ("<one>", "NOUN", "dobj", 1), ("<two>", "NOUN", "conj", 2), ("<three>", "NOUN", "conj", 3)),
    # A clause as complement, and a coordinated verb that shares the subject.
    (("<brand>", "PROPN", "nsubj", 1), ("wants", "VERB", "ROOT", 1), ("pack", "VERB", "xcomp", 1), ("<one>", "NOUN", "compound", 4), ("<three>", "NOUN", "dobj", 2), ("sends", "VERB", "conj", 1), ("<two>", "NOUN", "dobj", 5)),
    # A clause that modifies the subject, and an object after a preposition.
    (("<three>", "NOUN", "nsubj", 4), ("shipped", "VERB", "acl", 0), ("by", "ADP", "agent", 1), ("<brand>", "PROPN", "pobj", 2), ("arrives", "VERB", "ROOT", 4), ("at", "ADP", "prep", 4), ("<two>", "NOUN", "pobj", 5)),
    # A recipient, and a clause of purpose.
    (("<brand>", "PROPN", "nsubj", 1), ("gives", "VERB", "ROOT", 1), ("<one>", "NOUN", "dative", 1), ("<three>", "NOUN", "dobj", 1), ("to", "PART", "aux", 5), ("keep", "VERB", "advcl", 1), ("<two>", "NOUN", "dobj", 5)),
)
#: The verb that a clause's negation belongs to.
NEGATES = (1, 3, 1, 1, 4, 1)


def clause_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A clause of ten token ids for each part; its size says which kind, and whether it is negated."""
    p = table(spark, d, "part").selectExpr("p_partkey as s", "p_brand", "p_size", "split(p_type, ' ') as t")
    words = {"<brand>": F.col("p_brand"), "<one>": F.get("t", F.lit(0)), "<two>": F.coalesce(F.get("t", F.lit(1)), F.lit("lots")), "<three>": F.coalesce(F.get("t", F.lit(2)), F.lit("goods"))}
    token = lambda o, word, pos, dep, head: F.struct(F.lit(o).alias("o"), words.get(word, F.lit(word)).alias("word"), F.lit(pos).alias("pos"), F.lit(dep).alias("dep"), F.lit(head).alias("h"))
    kinds = [F.array(*[token(o, *row) for o, row in enumerate(clause)], *[F.when(F.col("p_size") % 7 == 0, token(9, "not", "PART", "neg", head))]) for clause, head in zip(CLAUSES, NEGATES)]
    rows = F.filter(F.element_at(F.array(*kinds), (F.col("p_size") % len(CLAUSES) + 1).cast("int")), lambda x: x.isNotNull())
    return p.select("s", F.explode(rows).alias("e")).selectExpr("cast(s as long) as sentence_id", "cast(s * 10 + e.o as long) as token_id", "e.word", "lower(e.word) as lemma", "e.pos", "e.pos as tag", "e.dep", "cast(s * 10 + e.h as long) as head_id")


def _coref(word: str) -> str:
    """A number for each noun of the clauses, as SQL: brands by their number, others by first letter and length."""
    return f"case when {word} like 'Brand#%' then cast(substr({word}, 7) as int) else ascii({word}) * 100 + length({word}) end"


def clause_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every noun of the clauses as a mention of one token."""
    nouns = clause_tokens(spark, d).where("pos in ('NOUN', 'PROPN')")
    return nouns.selectExpr(f"{_coref('word')} as coref", "token_id as start_token", "token_id as end_token", "token_id as pos", "word as text")


def clause_characters(spark: SparkSession, d: str) -> DataFrame:
    """The clauses' nouns as nested records: subjects act, objects and passive subjects undergo."""
    tokens = clause_tokens(spark, d)
    verb = tokens.select(F.col("token_id").alias("head_id"), F.col("word").alias("w"))
    roles = tokens.where("dep in ('nsubj', 'dobj', 'nsubjpass')").join(shuffled(verb), "head_id").selectExpr(f"cast({_coref('word')} as bigint) as id", "word", "dep", "named_struct('w', w, 'i', head_id) as e")
    own = roles.groupBy("id").agg(F.min("word").alias("n"), F.sort_array(F.collect_list(F.when(F.col("dep") == "nsubj", F.col("e")))).alias("agent"), F.sort_array(F.collect_list(F.when(F.col("dep") != "nsubj", F.col("e")))).alias("patient"))
    return own.selectExpr("id", "cast(id as int) as pos", "named_struct('argmax', case when id % 3 = 0 then 'she/her' else 'he/him/his' end) as g", "agent", "patient", "named_struct('proper', array(named_struct('n', n, 'c', 1L)), 'common', cast(array() as array<struct<n:string,c:bigint>>)) as mentions")


def clause_names(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of the same nouns."""
    own = clause_characters(spark, d)
    return own.selectExpr("cast(id as int) as id", "cast(id as int) as row", "mentions.proper[0].n as fullname", "cast(null as string) as firstname", "cast(null as string) as middlename", "cast(null as string) as surname", "case when id % 3 = 0 then 'f' else 'm' end as gender", "cast(null as string) as aka", "cast(null as string) as profession")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "word string, valence double")


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PHRASES), "phrase string, valence double")


def document_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", " ")).alias("token_id", "word"))
