"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segmentation, sentiment, text
from ..operators import cooccur, deps, events, graph, reports, resolve, sections, spans
from ..session import shared_folder, table
from ..sources import readers, schemas, writers
from ..streaming import cooccur as stream
from . import pipeline
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _places(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _listed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns})


# Co-occurrence


@query
def cooccurrence_edges(spark, d):
    return cooccur.edges(cooccur.pairs_of(t.mentions(spark, d)))


@query
def occurrence_counts(spark, d):
    return cooccur.occurrences(cooccur.presence(t.mentions(spark, d)))


@query
def edges_with_sentence_list(spark, d):
    return _listed(cooccur.edges(cooccur.pairs_of(t.mentions(spark, d)), lists=True), "sentence_ids")


@query
def edge_sentence_chunks(spark, d):
    return _listed(cooccur.edge_sentences(cooccur.pairs_of(t.mentions(spark, d)), size=5), "sentence_ids")


@query
def occurrence_sentence_chunks(spark, d):
    return _listed(cooccur.occurrence_sentences(cooccur.presence(t.mentions(spark, d)), size=50), "sentence_ids")


@query
def top_pairs(spark, d):
    return cooccur.top_pairs(cooccurrence_edges(spark, d))


@query
def named_edges(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("canonical_id"), F.col("s_name").alias("fullname"))
    return cooccur.name_edges(cooccurrence_edges(spark, d), names)


@query
def mentions_in_sentences(spark, d):
    e = table(spark, d, "events")
    own = e.selectExpr("user_id as coref", "event_id as start_token", "event_id + 3 as end_token")
    return spans.mentions_in_sentences(own, t.event_tokens(spark, d)).groupBy("coref").agg(F.countDistinct("sentence_id").alias("n_sentences"))


# Sections


@query
def section_edges(spark, d):
    rows = cooccur.pairs_of(t.mentions(spark, d))
    return sections.instances_in(rows, t.sections(spark, d)).groupBy("section").agg(F.count("*").alias("instances"), F.countDistinct("source_id", "target_id").alias("edges"))


@query
def chapter_ranges(spark, d):
    return sections.ranges_from_markers(table(spark, d, "events"), F.col("event_type") == "signup", "event_id", ["user_id"], {0: 3}, 1)


@query
def marker_ranges(spark, d):
    """Ranges between markers of the whole table, without a key."""
    return sections.ranges_from_markers(table(spark, d, "events"), F.col("event_type") == "signup", "event_id", [], {0: 3}, 1)


@query
def directed_labelled_edges(spark, d):
    triples = events.avp_triples(t.role_events(spark, d)).join(t.order_tokens(spark, d).select(F.col("token_id").alias("index"), "lemma"), "index")
    named = triples.select(F.col("canonical_id_left").alias("name_left"), F.col("canonical_id_right").alias("name_right"), "role_left", "role_right", "lemma", "index")
    return sections.section_triples(named, t.sections(spark, d)).groupBy("section", "label").agg(F.count("*").alias("n"), F.countDistinct("a", "b").alias("pairs"))


# Triples


@query
def avp_triples(spark, d):
    return events.avp_triples(t.role_events(spark, d)).select(F.col("canonical_id_left").alias("left_id"), "index", F.col("canonical_id_right").alias("right_id"), "pos_left", "pos_right")


@query
def avp_token_range(spark, d):
    return events.avp_triples(t.role_events(spark, d), span=text.token_range("100,900")).select(F.col("canonical_id_left").alias("left_id"), "index", F.col("canonical_id_right").alias("right_id"))


@query
def lemma_left_join(spark, d):
    triples = events.avp_triples(t.role_events(spark, d))
    lemma = t.order_tokens(spark, d).withColumnRenamed("token_id", "index")
    return triples.join(lemma, "index", "left").groupBy("lemma").agg(F.count("*").alias("n"), F.countDistinct("sentence_id").alias("n_sentences"))


@query
def negation_exists(spark, d):
    return t.event_tokens(spark, d).select("token_id").join(events.negated_verbs(t.event_tokens(spark, d)).withColumnRenamed("verb_id", "token_id"), "token_id", "left").select("token_id", F.coalesce("negated", F.lit(False)).alias("negated"))


def _triples(spark, d, kind):
    return table(spark, d, "events").where(F.col("event_type") == kind).selectExpr(f"'{kind}' as source", "user_id % 20 as left_id", "event_id % 50 as index", "cast(value as long) % 10 as right_id", "event_id as pos", "'agent' as role_left")


@query
def combined_triples(spark, d):
    return events.combine(_triples(spark, d, "view"), _triples(spark, d, "click"), ["left_id", "index", "right_id"], ["pos"], {"agent": "subject"})


@query
def allow_list(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id as character_id", "case when n_chars > 3000 then array('x') else array() end as names", "array(lang) as common")
    return events.allow_common(docs, table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("character_id"))).select("character_id")


@query
def conditional_update(spark, d):
    return events.override(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey", [1, 3], {"n_name": "GROUP", "n_nationkey": -1})


@query
def flatten_nested(spark, d):
    c = table(spark, d, "conversations").withColumn("w", F.struct(F.col("text").alias("w"), F.col("turn").cast("long").alias("i")))
    nested = c.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.col("w")))).alias("agent"), F.sort_array(F.collect_list(F.when(F.col("role") != "user", F.col("w")))).alias("patient"))
    shaped = nested.selectExpr("id", "id as pos", "agent", "patient", "named_struct('proper', array(named_struct('n', concat('c', id % 9), 'c', 1L)), 'common', array(named_struct('n', 'talk', 'c', 1L))) as mentions", "named_struct('argmax', 'they') as g")
    return events.explode_names(events.with_names(events.flatten_characters(shaped))).select("character_id", "role", "index", "name_pos", "name", F.length("word").alias("length"))


# Text


@query
def normalize_name(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_name(F.concat(F.lit("The "), F.col("p_name"), F.lit(', "'), F.col("p_type"), F.lit("-x."))).alias("name"))


@query
def clean_tokens(spark, d):
    known = F.array(F.lit("red"), F.lit("of"), F.lit("st"))
    return table(spark, d, "part").select("p_partkey", text.clean_tokens(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), known, ["mr", "lady"], ["polished", "steel", "economy"]).alias("name"))


@query
def gender_class(spark, d):
    pronouns = F.element_at(F.create_map(*[F.lit(x) for x in ("AUTOMOBILE", "she/her", "BUILDING", "he/him/his", "FURNITURE", "they/them/their", "MACHINERY", "")]), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", text.gender_class(pronouns).alias("gender"))


@query
def preprocess_text(spark, d):
    clean = text.preprocess(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(clean).cast("long").alias("length"), F.md5(clean.cast("binary")).alias("digest"))


@query
def sentence_segments(spark, d):
    return text.segment(table(spark, d, "documents"))


@query
def abbreviations(spark, d):
    return _places(segmentation.abbreviations(table(spark, d, "documents")), "score")


@query
def learnt_sentences(spark, d):
    """Sentences cut by what the documents say about their abbreviations and sentence starters."""
    docs = table(spark, d, "documents")
    types = segmentation.word_types(docs)
    short = segmentation.abbreviations(docs, types)
    return segmentation.segment_learnt(docs, short, segmentation.starters(docs, short, types))


@query
def joined_words(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber as token_id", "concat(l_returnflag, l_linestatus) as word")
    return text.joined_words(rows, ["l_orderkey"])


@query
def literal_lists(spark, d):
    made = table(spark, d, "nation").selectExpr("n_nationkey", "case when n_regionkey = 2 then 'oops' else concat('[', n_nationkey, ', ', n_regionkey, ']') end as s", "concat('[''', n_name, ''', ''x''', ']') as q", "concat(n_name, ' ; b;; ', n_regionkey) as m")
    return _listed(made.select("n_nationkey", text.int_list("s").alias("ids"), text.name_list("q").alias("names"), text.split_list(F.col("m")).alias("parts")), "ids", "names", "parts")


def _part_names(spark, d):
    return table(spark, d, "part").select("p_name").distinct()


@query
def fuzzy_score(spark, d):
    pairs = table(spark, d, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.select("a", "b", F.round(text.token_sort_ratio(F.col("a"), F.col("b")), 6).alias("score"))


# Files


@query
def sentence_lines(spark, d):
    """Sentences as lines of text, written and read again."""
    clean = table(spark, d, "documents").select("doc_id", text.preprocess(F.col("text")).alias("text"))
    writers.write_lines(text.segment(clean), path := shared_folder(spark, "lines"))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def whole_texts(spark, d):
    """Files read whole, and cut into their lines."""
    writers.write_lines(table(spark, d, "pages"), path := shared_folder(spark, "texts"), "url")
    return readers.read_text(spark, path).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


#: Words that readers must not take for something else.
_ODD = """concat(case p_size % 5 when 0 then '"' when 1 then 'null' when 2 then '' when 3 then 'nan' else p_name end, case when p_size % 3 = 0 then '"' else '' end)"""


@query
def raw_tokens(spark, d):
    """Tab-separated lines without quoting: quotes and words like null are text."""
    made = table(spark, d, "part").selectExpr("p_partkey", f"{_ODD} as word", "p_size")
    made.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "word", F.col("p_size").cast("string"))).write.text(path := shared_folder(spark, "tokens"))
    return readers.read_raw_tsv(spark, path, "p_partkey bigint, word string, p_size int", header=False)


@query
def quoted_columns(spark, d):
    """A TSV file with quotes, of which two columns are read."""
    made = table(spark, d, "part").selectExpr("p_partkey", "concat('a', char(9), p_name, '\"', p_type) as name", "p_size")
    writers.write_delimited(made, path := shared_folder(spark, "parts"), "\t")
    return readers.read_tsv(spark, path, "p_partkey bigint, name string, p_size int", ["p_partkey", "name"])


@query
def edge_file(spark, d):
    """An edge list as a CSV file, with its lists of sentences."""
    writers.write_delimited(cooccur.edges(cooccur.pairs_of(t.mentions(spark, d)), lists=True), path := shared_folder(spark, "edges"))
    read = readers.read_csv(spark, path, "source_id bigint, target_id bigint, weight bigint, sentence_ids string", ("sentence_ids",))
    return _listed(read, "sentence_ids")


@query
def character_records(spark, d):
    """Nested JSON documents of fifty conversations each, read as characters."""
    word = F.struct(F.coalesce("text", F.lit("")).alias("w"), F.col("turn").cast("long").alias("i"))
    own = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.when(F.col("role") == "user", word))).alias("agent"), F.sort_array(F.collect_list(F.when(F.col("role") != "user", word))).alias("patient"))
    nested = own.groupBy(F.expr("id div 50").alias("k")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("id", "count", "agent", "patient"))).alias("characters"))).alias("value"))
    nested.repartition("k").write.partitionBy("k").text(path := shared_folder(spark, "records"))
    rows = readers.read_characters(spark, path)
    return rows.select("id", "count", F.size("agent").cast("long").alias("n_agent"), F.size("patient").cast("long").alias("n_patient"), F.array_join(F.transform("patient", lambda x: x["i"].cast("string")), ",").alias("turns"))


@query
def graph_file(spark, d):
    """A GEXF graph in parts, and the edges that it lists."""
    edges = cooccur.edges(cooccur.pairs_of(t.mentions(spark, d))).selectExpr("source_id as a", "target_id as b", "weight")
    nodes = table(spark, d, "supplier").selectExpr("s_suppkey as id", "concat(s_name, ' <&\">') as label")
    folders = writers.write_gexf(nodes, edges, shared_folder(spark, "gexf"))
    line = spark.read.text(folders).select("value")
    named = lambda name: F.regexp_extract("value", f'{name}="([^"]*)"', 1)
    return line.select(F.regexp_extract("value", "^<(/?[a-z]+)", 1).alias("element"), named(" id").alias("id"), named("label").alias("label"), named("source").alias("a"), named("target").alias("b"), named("weight").alias("weight"))


@query
def degree_report(spark, d):
    """The first lines of a report, by degree."""
    rows = graph.degree_centrality(t.dealings(spark, d)).select("node", "degree")
    return spark.createDataFrame(list(enumerate(writers.report(rows, "degree", n=20))), "place int, line string")


# Resolution


@query
def name_variants(spark, d):
    return resolve.name_variants(t.names(spark, d)).select("variant", "id", "gender")


@query
def fuzzy_topk_match(spark, d):
    asked = _part_names(spark, d).select(F.regexp_replace("p_name", "[aeiou]([b-df-hj-np-tv-z]*)$", "$1").alias("query"))
    known = _part_names(spark, d).select(F.col("p_name").alias("variant"), F.length("p_name").cast("long").alias("id_order"))
    return _places(resolve.top_matches(asked, known, k=3, threshold=60.0), "score")


@query
def match_names(spark, d):
    s = table(spark, d, "nation").selectExpr("concat('that ', lower(substr(n_name, 1, 4)), lower(substr(n_name, 6)), ' man') as name", "case n_nationkey % 4 when 0 then 'u' when 1 then 'f' else 'm' end as gender", "n_nationkey as character_id")
    found = resolve.match_names(s, t.names(spark, d), ["mr", "mrs"], ["that", "man"])
    return _places(found, "match_score").withColumn("matched_id", F.coalesce("matched_id", F.lit(-1)))


def _matched(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("character_id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("name"), text.normalize_name(F.col("p_name")).alias("matched_fullname"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("matched_id"), (F.col("p_size") * 2.0).alias("match_score"), F.lit("agent").alias("role"), F.col("p_brand").alias("word"), F.col("p_size").alias("index"), F.lit("m").alias("gender"))


@query
def canonical_ids(spark, d):
    return resolve.canonical_ids(_matched(spark, d)).select("character_id", "canonical_id")


@query
def canonical_summary(spark, d):
    return _places(_listed(resolve.canonical_summary(resolve.canonical_ids(_matched(spark, d))), "original_ids"), "avg_score")


@query
def variants_seen(spark, d):
    return _listed(resolve.variants_seen(resolve.canonical_ids(_matched(spark, d))), "name_variants")


@query
def merged_events(spark, d):
    return resolve.merge(resolve.canonical_ids(_matched(spark, d))).select("canonical_id", "word", "index", "name", F.size("original_ids").cast("long").alias("n_ids"), "pos")


# Spans


def _spans(spark, d):
    return table(spark, d, "events").selectExpr("user_id as coref", "event_id as start_token", "event_id + cast(abs(value) as long) % 5 as end_token", "event_id as pos")


@query
def span_token_map(spark, d):
    return spans.span_token_map(_spans(spark, d))


@query
def span_runs(spark, d):
    return spans.span_runs(_spans(spark, d))


def _summary(spark, d):
    n = table(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("original_ids"), F.min("n_name").alias("fullname")).selectExpr("n_regionkey as canonical_id", "fullname", "original_ids", "cast(n_regionkey as double) as avg_score")


@query
def coref_lookup(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", "array(c_nationkey % 3, c_nationkey, 7) as ids")
    return spans.first_canonical(rows, spans.coref_to_canonical(_summary(spark, d)), "ids", "c_custkey")


@query
def ids_to_corefs(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "sequence(o_orderkey, o_orderkey + 3) as ids")
    return _listed(spans.ids_to_corefs(rows, spans.span_token_map(_spans(spark, d)), "ids", "o_orderkey"), "corefs")


@query
def islands(spark, d):
    lists = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_id").alias("ids"))
    return _listed(spans.islands(lists, "ids", ["user_id"]), "ids")


@query
def turn_runs(spark, d):
    return spans.runs_of_rows(table(spark, d, "conversations").where("role = 'user'"), ["conv_id"], "turn")


@query
def name_gender(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("The "), F.col("n_name"))).otherwise(F.lit("x")).alias("fullname"))
    return spans.lookup_gender(rows, t.names(spark, d)).select("s_suppkey", "gender")


@query
def heads_in_sentence(spark, d):
    return spans.heads_in_sentence(t.clause_tokens(spark, d)).select("token_id", "place", "head_place")


# Dependencies


@query
def svo_extract(spark, d):
    rows = deps.svo_triples(t.clause_tokens(spark, d))
    return _listed(rows, "subject_ids", "object_ids").select("sentence_id", "subject_text", "subject_ids", "subject_pos", "verb_text", "verb_lemma", "verb_id", "object_text", "object_ids", "object_pos", "negated")


@query
def svo_patterns(spark, d):
    """Triples by more patterns: modified nouns, recipients, objects after prepositions."""
    rows = deps.svo_triples(t.clause_tokens(spark, d), (*deps.PATTERNS, deps.MODIFIED, deps.RECIPIENT, deps.PREPOSITIONAL))
    return _listed(rows, "subject_ids", "object_ids").select("sentence_id", "subject_text", "subject_ids", "subject_pos", "verb_text", "verb_lemma", "verb_id", "object_text", "object_ids", "object_pos", "negated")


@query
def svo_chunks(spark, d):
    return _listed(deps.chunked(deps.svo_triples(t.clause_tokens(spark, d))), "subject_ids", "object_ids").select("sentence_id", "subject_ids", "object_text", "object_ids")


@query
def compound_closure(spark, d):
    tokens = t.clause_tokens(spark, d)
    return deps.compound_closure(tokens, tokens.where("dep = 'dobj'"))


# The whole extraction


def _extracted(spark, d):
    tokens = t.clause_tokens(spark, d)
    return pipeline.extract(t.clause_characters(spark, d), tokens, t.clause_entities(spark, d), t.clause_names(spark, d), pipeline.Settings())


@query
def extraction_triples(spark, d):
    """Triples of either source, from nested records, tokens, mentions and a dictionary of names."""
    return _extracted(spark, d)["combined"].select("source", "canonical_id_left", "role_left", "index", "negated", "canonical_id_right", "role_right")


@query
def extraction_edges(spark, d):
    return _extracted(spark, d)["edges"].select("source_id", "source_name", "target_id", "target_name", "weight")


@query
def extraction_statistics(spark, d):
    """How many triples of either source there are, negated ones, and different entities on either side."""
    return pipeline.statistics(_extracted(spark, d)["combined"])


@query
def triples_without_mappings(spark, d):
    """Subject-verb-object triples in the layout of files, where the mappings to entities have to be made first."""
    rows = pipeline.subject_object_triples(t.clause_tokens(spark, d), t.clause_entities(spark, d), None, t.clause_names(spark, d), t.clause_characters(spark, d))
    # Columns are told apart by their places, as in files of either source.
    columns = ["source", "canonical_id_left", "word", "lemma", "index", "canonical_id_right"]
    named = events.align(rows.select(*columns).toDF("kind", "subject", "verb", "verb_lemma", "place", "object"), columns)
    placed = events.layout(named, schemas.TRIPLE_COLUMNS)
    return placed.select("source", "canonical_id_left", "word", "lemma", "index", "canonical_id_right")


# Reports


@query
def event_value_counts(spark, d):
    return reports.value_counts(table(spark, d, "events"), "event_type")


@query
def stats_report(spark, d):
    e = table(spark, d, "events")
    return _places(reports.statistics(e, {"errors": F.col("event_type") == "error", "large": F.col("value") > 50}), "errors_share", "large_share")


@query
def distinct_over(spark, d):
    return reports.distinct_over(t.trade(spark, d), ["a", "b"])


# Graphs


@query
def induced_subgraph(spark, d):
    e = cooccurrence_edges(spark, d).selectExpr("source_id as a", "target_id as b", "weight")
    main = table(spark, d, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("node"))
    return graph.induced(e, main)[1].select("a", "b", "weight")


@query
def degree_centrality(spark, d):
    return _places(graph.degree_centrality(t.trade(spark, d), ["year"]), "centrality")


@query
def weighted_graph(spark, d):
    return _places(graph.weighted(t.trade(spark, d), ["year"]), "distance")


@query
def graph_summary(spark, d):
    return graph.summary(t.trade(spark, d), ["year"])


@query
def closeness(spark, d):
    return _places(graph.measure(graph.simple(t.ring(spark, d), ["section"]), "closeness", ["section"]).select("section", "node", "value"), "value")


@query
def closeness_by_joins(spark, d):
    return _places(graph.closeness_at_scale(t.ring(spark, d), ["section"]), "closeness")


@query
def closeness_of_traders(spark, d):
    """A graph that grows with the tables, by frontiers of 64 sources a word."""
    return _places(graph.closeness_at_scale(t.dealings(spark, d)), "closeness")


@query
def closeness_directed(spark, d):
    e = t.ring(spark, d).distinct()
    return _places(graph.measure(e, "closeness", ["section"], directed=True).select("section", "node", "value"), "value")


@query
def closeness_evolution(spark, d):
    e = t.trade(spark, d).select("year", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    grid = e.select("year").distinct().crossJoin(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node")))
    return _places(graph.evolution(e, ["year"], grid), "value")


@query
def betweenness(spark, d):
    return _places(graph.measure(graph.simple(t.ring(spark, d), ["section"]), "betweenness", ["section"]).select("section", "node", "value"), "value")


@query
def eigenvector(spark, d):
    return _places(graph.measure(graph.simple(t.ring(spark, d), ["section"]), "eigenvector", ["section"]), "value")


@query
def katz(spark, d):
    return _places(graph.measure(graph.simple(t.ring(spark, d), ["section"]), "katz", ["section"]), "value")


@query
def contraction_hypothesis(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("candidate"))
    return _places(graph.hypotheses(t.ring(spark, d), ["section"], "5", nodes), "value")


@query
def display_scale(spark, d):
    return _places(graph.display_scale(graph.weighted(t.trade(spark, d), ["year"]).select("year", "a", "b", "weight"), "weight", ["year"]), "scaled")


@query
def section_analysis(spark, d):
    return _places(pipeline.analyse(t.ring(spark, d), ["section"]), "value")


# Sentiment


@query
def document_sentiment(spark, d):
    return _places(sentiment.sentence_scores(t.document_words(spark, d), t.lexicon(spark), ["doc_id"]), "valence", "compound")


@query
def document_sentiment_by_all_rules(spark, d):
    scores = sentiment.full_scores(t.document_words(spark, d), t.lexicon(spark), ["doc_id"], t.phrases(spark))
    return _places(scores, "valence", "compound")


@query
def sentiment_by_pair(spark, d):
    scores = sentiment.sentence_scores(t.document_words(spark, d), t.lexicon(spark), ["doc_id"])
    instances = table(spark, d, "documents").selectExpr("doc_id", "source as a", "lang as b")
    return _places(graph.pair_sentiment(instances, scores, on="doc_id"), "total", "mean")


@query
def incident_sentiment(spark, d):
    e = t.trade(spark, d).withColumn("sentiment", (F.col("a") - F.col("b")) / 25.0)
    grid = e.select("year").distinct().crossJoin(table(spark, d, "nation").select(F.col("n_nationkey").alias("node")))
    return _places(graph.incident_sentiment(e, ["year"], grid=grid), "mean")


# Streams


@query
def window_pairs(spark, d):
    return stream.edge_batch(table(spark, d, "events"), "ts", "user_id", "1 hour")


@query
def stream_pairs(spark, d):
    """The windows that a stream over `events` has closed once it has read all there is."""
    folder = shared_folder(spark, "stream")
    schema = table(spark, d, "events").schema
    # A table is a file or a folder of them.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parquet") if whole else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = stream.presence_stream(rows, "ts", "user_id", "1 hour", "1 hour")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return cooccur.counted(spark.read.schema(out.schema).parquet(f"{folder}/out"), "window_start", "user_id")
