"""Tasks follow the number of rows: Spark doesn't merge them by their compressed size."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import cooccur, deps, events, spans, trees


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_roles_are_paired_in_tasks_of_a_bounded_number_of_events(spark):
    made = spark.range(2000).selectExpr("id % 7 as canonical_id", "if(id % 2 = 0, 'agent', 'patient') as role", "id div 4 as index", "id as pos")
    many = events.pair_roles(made, each=100)
    assert many.rdd.getNumPartitions() >= 20
    assert rows(many) == rows(events.pair_roles(made)) and many.count() > 1000


def test_pairs_are_made_in_tasks_of_a_bounded_number(spark):
    present = spark.range(1000).selectExpr("id div 5 as sentence_id", "id % 5 as canonical_id")
    many = cooccur.pairs(present, each=100)
    assert many.rdd.getNumPartitions() >= 20
    assert rows(many) == rows(cooccur.pairs(present)) and many.count() == 2000


def clauses(spark, n):
    """n sentences of four tokens: two compounds, one of the other, a noun, and a head outside the sentence."""
    return spark.range(n * 4).selectExpr("id div 4 as sentence_id", "id as token_id", "if(id % 4 < 2, 'compound', if(id % 4 = 2, 'dobj', 'x')) as dep", "if(id % 4 < 2, id + 1, if(id % 4 = 2, id, -1)) as head_id")


def test_compounds_are_followed_in_tasks_of_a_bounded_number_of_tokens(spark):
    tokens = clauses(spark, 500)
    # Roots that are named twice count once; one is of no sentence.
    roots = tokens.where("dep = 'dobj'").unionByName(tokens.where("token_id = 2")).select("token_id").unionByName(spark.range(1).selectExpr("-9L as token_id"))
    many = deps.compound_closure(tokens, roots, each=100)
    assert many.rdd.getNumPartitions() == 20
    assert rows(many) == sorted(((4 * s + 2, 4 * s + k) for s in range(500) for k in range(3)), key=repr) == rows(deps.compound_closure(tokens, roots))
    assert trees.forests(tokens, tasks=20, any=F.lit(True)).rdd.getNumPartitions() == 20


def test_heads_are_placed_in_tasks_of_a_bounded_number_of_tokens(spark):
    tokens = clauses(spark, 500)
    many = spans.heads_in_sentence(tokens, each=100)
    assert many.rdd.getNumPartitions() == 20
    got = sorted((r.token_id, r.place, r.head_place) for r in many.collect())
    assert got == sorted((4 * s + k, k, h) for s in range(500) for k, h in ((0, 1), (1, 2), (2, 2))) and rows(many) == rows(spans.heads_in_sentence(tokens))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan


def test_mentions_are_paired_without_distinct_rows(spark):
    rng = random.Random(3)
    made = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)])) for _ in range(600)]
    mentions = spark.createDataFrame(made, "sentence_id long, canonical_id long")
    want = rows(cooccur.pairs(cooccur.presence(mentions)))
    assert rows(cooccur.pairs_of(mentions)) == want and len(want) > 500
    # Mentions of hot sentences are made distinct first.
    assert rows(cooccur.pairs_of(mentions, heavy=4)) == want
    assert cooccur.pairs_of(mentions.limit(0)).count() == 0


def test_lists_of_edges_are_cut_from_sorted_rows(spark):
    rng = random.Random(8)
    made = [(rng.choice([None, "a", "b"]), rng.choice([None, "x", "y", "z"]), rng.choice([None, *range(30)])) for _ in range(400)]
    df = spark.createDataFrame(made, "source_id string, target_id string, sentence_id int")
    want = df.groupBy("source_id", "target_id").agg(F.count("*").alias("weight"), F.sort_array(F.collect_list("sentence_id")).alias("sentence_ids"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = cooccur.edges(df, lists=True)
            assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
            assert got.dtypes == want.dtypes and rows(got) == rows(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert cooccur.edges(df.limit(0), lists=True).count() == 0


def test_runs_of_one_key_each_are_not_held():
    batches = [pa.RecordBatch.from_pydict({"source_id": [k], "target_id": [k], "s": [s]}) for k in range(5) for s in (1, 2)]
    assert [b.to_pydict() for b in cooccur._edge_lists(iter(batches))] == [{"source_id": [k], "target_id": [k], "weight": [2], "sentence_ids": [[1, 2]]} for k in range(5)]
