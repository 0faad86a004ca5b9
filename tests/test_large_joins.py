"""Joins of rows that are exploded from a small table: none goes through the driver."""

import pytest

from loomgraph.operators import deps, events, spans, trees
from loomgraph.plans import tables
from loomgraph.session import shared_checkpoint

TOKENS = "sentence_id long, token_id long, word string, lemma string, pos string, tag string, dep string, head_id long"


@pytest.fixture(scope="module")
def tokens(spark):
    clause = (("she", "PRON", "nsubj", 1), ("reads", "VERB", "ROOT", 1), ("no", "DET", "neg", 1), ("books", "NOUN", "dobj", 1))
    return spark.createDataFrame([(s, s * 10 + o, w, w, p, p, d, s * 10 + h) for s in range(50) for o, (w, p, d, h) in enumerate(clause)], TOKENS)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_triples(tokens):
    rows = deps.svo_triples(tokens)
    assert "Broadcast" not in plan(rows)
    assert rows.count() == 50 and rows.where("negated").count() == 50


def test_subtrees(tokens):
    assert "Broadcast" not in plan(trees.under(shared_checkpoint(trees.forests(tokens, any=tokens["dep"] != "ROOT")), tokens.where("dep = 'ROOT'"), "any"))


def test_lookups(tokens):
    runs = spans.span_runs(tokens.selectExpr("token_id % 3 as coref", "token_id as start_token", "token_id as end_token", "token_id as pos"))
    assert "Broadcast" not in plan(spans.ids_to_corefs(tokens.selectExpr("token_id as key", "array(token_id, head_id) as ids"), shared_checkpoint(runs), "ids", "key"))
    assert "Broadcast" not in plan(spans.mentions_in_sentences(tokens.selectExpr("1 as coref", "token_id as start_token"), tokens))
    assert "Broadcast" not in plan(spans.heads_in_sentence(tokens))


def test_negations(tokens):
    assert "Broadcast" not in plan(events.negated_verbs(tokens))


def test_customers_and_parts(spark, tmp_path):
    made = {
        "orders": ["id as o_orderkey", "id as o_custkey"], "customer": ["id as c_custkey", "int(id % 5) as c_nationkey"], "part": ["id as p_partkey", "'x' as p_name"],
        "lineitem": ["id as l_orderkey", "id as l_partkey", "id as l_suppkey", "1 as l_linenumber"], "supplier": ["id as s_suppkey", "int(id % 5) as s_nationkey"],
    }
    for name, columns in made.items():
        spark.range(50).selectExpr(*columns).write.parquet(f"{tmp_path}/{name}.parquet")
    roles = tables.role_events(spark, str(tmp_path))
    assert roles.count() == 100 and "Broadcast" not in plan(roles.where("role = 'agent'"))
    assert "Broadcast" not in plan(tables.order_tokens(spark, str(tmp_path)))
