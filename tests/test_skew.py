"""Rules that hold whatever holds most of the rows: long spans and intervals, heavy sentences, one key or none."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cooccur, sections, spans
from loomgraph.operators.ordered import chunks, numbered


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_numbers_in_an_order(spark, keys):
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", rng.randrange(300)) for _ in range(2000)]
    got = numbered(spark.createDataFrame(rows, "k string, x int"), keys, ["x"]).collect()
    assert sorted((r.k or "", r.x) for r in got) == sorted((k or "", x) for k, x in rows)
    for key in {r.k for r in got} if keys else {"all"}:
        own = sorted((r.n, r.x) for r in got if not keys or r.k == key)
        assert [n for n, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)


def test_lists_in_numbered_parts(spark):
    df = spark.createDataFrame([("a", x) for x in range(25, 0, -1)] + [("b", 1)], "k string, x int")
    got = {(r.k, r.chunk): r["values"] for r in chunks(df, ["k"], "x", 10).collect()}
    assert got == {("a", 0): list(range(1, 11)), ("a", 1): list(range(11, 21)), ("a", 2): list(range(21, 26)), ("b", 0): [1]}
    assert chunks(df.limit(0), ["k"], "x", 10).count() == 0


def test_a_heavy_sentence_is_paired_in_chunks(spark):
    rows = [(1, e) for e in range(100)] + [(2, e) for e in (5, 3, 9)] + [(3, 7)]
    present = spark.createDataFrame(rows, "sentence_id int, canonical_id int")
    key = lambda df: sorted(map(tuple, df.select("sentence_id", "source_id", "target_id").collect()))
    want = key(cooccur.pairs(present))
    assert len(want) == 100 * 99 // 2 + 3 and key(cooccur.pairs(present, heavy=8)) == want
    lists = {(r.source_id, r.target_id, r.chunk): r.sentence_ids for r in cooccur.edge_sentences(cooccur.pairs(present), size=1).collect()}
    assert lists[3, 5, 0] == [1] and lists[3, 5, 1] == [2]
    assert [r.sentence_ids for r in cooccur.occurrence_sentences(present, size=5).where("canonical_id = 7").collect()] == [[1, 3]]


@pytest.mark.parametrize("bound", [3, 1000])
def test_runs_of_overlapping_spans(spark, bound):
    rng = random.Random(bound)
    rows = []
    for p in range(120):
        a = rng.randrange(200)
        rows.append((rng.choice("xy"), rng.choice("abc"), a, a + rng.choice([-1, 0, 1, 3, 40, 150]), p))
    rows.append(("x", "a", 10, 10**8, -1))
    got = spans.span_runs(spark.createDataFrame(rows, "doc string, coref string, start_token int, end_token int, pos int"), by=["doc"], bound=bound).collect()
    want = {}
    for doc, coref, a, b, _ in sorted(rows, key=lambda r: r[-1]):
        want |= {(doc, t): coref for t in range(a, min(b, 500) + 1)}
    have = {(r.doc, t): r.coref for r in got for t in range(r.lo, min(r.hi, 500) + 1)}
    assert have == want and max(r.hi for r in got) == 10**8 and len(got) < 2 * len(rows)
    for doc in "xy":
        own = sorted((r.lo, r.hi, r.coref) for r in got if r.doc == doc)
        assert all(b[0] > a[1] and (b[0] > a[1] + 1 or b[2] != a[2]) for a, b in zip(own, own[1:]))


def test_tokens_are_looked_up_in_runs(spark):
    entities = spark.createDataFrame([("A", 1, 5, 1), ("B", 3, 3, 2)], "coref string, start_token int, end_token int, pos int")
    runs = spans.span_runs(entities)
    assert sorted(map(tuple, runs.select("lo", "hi", "coref").collect())) == [(1, 2, "A"), (3, 3, "B"), (4, 5, "A")]
    triples = spark.createDataFrame([(1, [2, 3, 4]), (2, [9])], "key int, ids array<int>")
    by_runs = {r.key: r.corefs for r in spans.ids_to_corefs(triples, runs, "ids", "key").collect()}
    assert by_runs == {r.key: r.corefs for r in spans.ids_to_corefs(triples, spans.span_token_map(entities), "ids", "key").collect()} == {1: ["A", "B"], 2: []}
    assert spans.span_runs(entities.limit(0)).count() == spans.span_token_map(entities.limit(0)).count() == 0


def test_long_intervals_beside_short_ones(spark):
    intervals = spark.createDataFrame([("long", -5, 10**6)] + [(f"s{i}", 3 * i, 3 * i + i % 5 - 1) for i in range(200)], "name string, lo int, hi int")
    points = spark.createDataFrame([(x,) for x in [-6, -5, 0, 1, 7, 300, 599, 600, 10**6, 10**6 + 1]], "x int")
    got = sorted((r.x, r.name) for r in spans.interval_join(points, intervals, "x", "lo", "hi").collect())
    own = [tuple(r) for r in intervals.collect()]
    assert got == sorted((r.x, name) for r in points.collect() for name, lo, hi in own if lo <= r.x <= hi)
    assert spans.interval_join(points, intervals.limit(0), "x", "lo", "hi").count() == 0


def test_ranges_between_markers_of_a_whole_table(spark):
    marks = [3, 10, 11, 40, 95]
    df = spark.range(100).select(F.col("id").alias("p"), F.col("id").isin(*marks).alias("m")).repartition(5)
    got = sorted(map(tuple, sections.ranges_from_markers(df, F.col("m"), "p", [], {0: 3}, 1).select("section", "lo", "hi").collect()))
    assert got == [(0, 6, 9), (1, 11, 10), (2, 12, 39), (3, 41, 94), (4, 96, 99)]


def test_the_last_row_of_a_token_tells_its_sentence(spark):
    tokens = spark.createDataFrame([(1, 5, 1), (1, 2, 2), (2, 3, 1)], "token_id int, sentence_id int, row int")
    mentions = spark.createDataFrame([("A", 1), ("B", 2), ("C", 9)], "coref string, start_token int")
    assert sorted(map(tuple, spans.mentions_in_sentences(mentions, tokens, "row").collect())) == [("A", 2), ("B", 3)]


def test_chunks_of_light_keys_are_cut_in_place(spark):
    rows = spark.range(5000).selectExpr("case when id % 5 > 0 then id % 7 end as k", "id as x")
    got = {h: sorted((r.k if r.k is not None else -1, r.chunk, r["values"]) for r in chunks(rows, ["k"], "x", 10, heavy=h).collect()) for h in (100, 600, 100_000)}
    assert got[100] == got[600] == got[100_000] and {len(v) for *_, v in got[600] if _[0] == -1} == {10} and sum(len(v) for *_, v in got[600]) == 5000
    assert "rangepartitioning" not in chunks(rows, ["k"], "x", 10)._jdf.queryExecution().toString()
    assert dict(chunks(rows, ["k"], "x", 10).dtypes) == dict(chunks(rows, ["k"], "x", 10, heavy=1).dtypes)
