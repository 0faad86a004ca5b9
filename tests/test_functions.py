"""Text functions, readers and writers on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import sentiment, text
from loomgraph.operators.likeness import lcs, ratio
from loomgraph.sources import readers, schemas, writers


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normalize_name(spark):
    rows = [("The  Mr. O-Hara,",), (None,), ("",), ("the a an x",), ("an the x",), ("A  Lady",)]
    assert values(spark, rows, text.normalize_name(F.col("x"))) == ["mr ohara", "", "", "x", "the x", "lady"]


def test_clean_tokens(spark):
    rows = [("that fellow smith", ["smith"]), ("lady x", []), ("tall captain", []), ("", [])]
    got = values(spark, rows, text.clean_tokens(F.col("x"), F.col("known"), ["lady"], ["that", "fellow", "lady"]), "x string, known array<string>")
    assert got == ["smith", "lady", "tall captain", ""]


def test_gender_class(spark):
    rows = [("she/her",), ("he/him/his",), ("they/them/their",), ("",), (None,), ("it",)]
    assert values(spark, rows, text.gender_class(F.col("x"))) == ["f", "m", "u", "u", "u", "u"]


def test_preprocess_and_sentences(spark):
    rows = [("One Ill two.\r\nThree\n\nfour!  Five? six",)]
    assert values(spark, rows, text.preprocess(F.col("x"))) == ["One two. Three four! Five? six"]
    assert values(spark, rows, text.unify_newlines(F.col("x"))) == ["One Ill two. Three\n\nfour!  Five? six"]
    assert values(spark, rows, text.sentences(F.col("x"))) == [["One Ill two.", "Three\n\nfour!", "Five?", "six"]]


def test_lists(spark):
    rows = [("[1, 2]",), ("[]",), ("oops",), (None,)]
    assert values(spark, rows, text.int_list("x")) == [[1, 2], [], [], []]
    rows = [("['a', \"b c\", 'it''s']",), ("[]",), ("oops",), (None,)]
    assert values(spark, rows, text.name_list("x"))[1:] == [[], [], []] and values(spark, rows[:1], text.name_list("x"))[0][:2] == ["a", "b c"]
    assert values(spark, [(" a ;b;; c",), (None,)], text.split_list(F.col("x"))) == [["a", "b", "c"], []]


def plain_lcs(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        before, table = table, [0]
        for j, y in enumerate(b):
            table.append(before[j] + 1 if x == y else max(before[j + 1], table[j]))
    return table[-1]


def test_similarity(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ab c") for _ in range(rng.randrange(0, 9))), "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 9)))) for _ in range(80)] + [("", ""), ("x", ""), ("same name", "name same")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", text.lcs_length(F.col("a"), F.col("b")).alias("l"), text.token_sort_ratio(F.col("a"), F.col("b")).alias("r"), text.token_sort_ratio(F.col("b"), F.col("a")).alias("q")).collect()
    for r in rows:
        assert r.l == lcs(r.a, r.b) == plain_lcs(r.a, r.b)
        x, y = (" ".join(sorted(s.split())) for s in (r.a, r.b))
        assert r.r == pytest.approx(ratio(x, y)) and r.r == pytest.approx(r.q) and 0 <= r.r <= 100 and (r.r == 100) == (x == y)


def test_sentiment_rules(spark):
    words = ["good", "not good", "very good", "not very good", "bad", "plain", "no x y z good"]
    rows = [(i, k, w) for i, s in enumerate(words) for k, w in enumerate(s.split())] + [(9, 0, None)]
    lexicon = spark.createDataFrame([("Good", 2.0), ("bad", -1.0)], "word string, valence double")
    got = {r.s: r for r in sentiment.sentence_scores(spark.createDataFrame(rows, "s int, token_id int, word string"), lexicon, ["s"]).collect()}
    want = [2.0, -1.48, 2.293, -0.74 * 2.293, -1.0, 0.0, 2.0]
    assert [got[i].valence for i in range(7)] == pytest.approx(want) and got[9].valence == 0
    assert all(abs(got[i].compound - w / (w * w + 15) ** 0.5) < 1e-12 for i, w in enumerate(want))


def test_token_range():
    assert text.token_range("3,70") == (3, 70)
    with pytest.raises(ValueError):
        text.token_range("3")


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('sentence_id\ttoken_id\tword\tlemma\tpos\ttag\tdep\thead_id\n1\t1\t"\tnull\tX\tX\tnsubj\t2\n1\t2\tnan\t\tX\tX\tROOT\t2\n')
    rows = readers.read_raw_tsv(spark, str(tmp_path / "t.tsv"), schemas.TOKENS).orderBy("token_id").collect()
    assert [(r.word, r.lemma) for r in rows] == [('"', "null"), ("nan", "")]
    (tmp_path / "e.csv").write_text('source_id,source_name,target_id,target_name,weight,sentence_ids\n1,"a, ""b""",2,c,3,"[4, 5, 6]"\n')
    schema = schemas.EDGES.replace("array<int>", "string")
    (row,) = readers.read_csv(spark, str(tmp_path / "e.csv"), schema, int_lists=("sentence_ids",)).collect()
    assert (row.source_name, row.sentence_ids, row.weight) == ('a, "b"', [4, 5, 6], 3)
    (tmp_path / "b.json").write_text('{"characters": [{"id": 3, "count": 1, "g": null, "agent": [{"w": "go", "i": 5}], "patient": [], "mentions": {"proper": [{"n": "X", "c": 2}], "common": [], "pronoun": []}}, {"id": 4, "g": {"inference": {"he": 0.5}, "argmax": "he", "max": 0.5, "total": 1.0}}]}')
    rows = readers.read_characters(spark, str(tmp_path / "b.json")).collect()
    assert [(r.pos, r.id) for r in rows] == [(0, 3), (1, 4)] and rows[1].g.inference == {"he": 0.5}
    (tmp_path / "x.txt").write_text("a\nb")
    assert readers.read_text(spark, str(tmp_path / "x.txt")).first().text == "a\nb"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b, \"q\"", [1, 2]), (1, "a", [])], "n int, s string, l array<int>")
    writers.write_delimited(df, str(tmp_path / "out"))
    back = readers.read_csv(spark, str(tmp_path / "out"), "n int, s string, l string", int_lists=("l",))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    writers.write_lines(df, str(tmp_path / "lines"), "s", ["n"])
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a", 'b, "q"']
    assert writers.report(df, "n", "s") == ['b, "q";2', "a;1"]
    nodes, edges = spark.createDataFrame([(1, "<x>")], "id int, label string"), spark.createDataFrame([(1, 1, 2)], "a int, b int, weight int")
    folders = writers.write_gexf(nodes, edges, str(tmp_path / "g"))
    assert [r.value for r in spark.read.text(str(tmp_path / "g" / "manifest")).collect()] == [f.rsplit("/", 1)[1] for f in folders]
    lines = "".join(r.value for f in folders for r in spark.read.text(f).collect())
    import xml.etree.ElementTree as X

    assert X.fromstring(lines).find("./graph/nodes/node").get("label") == "<x>"


def test_control_characters_cut_no_sentence(spark):
    df = spark.createDataFrame([("One\u0001two. Three",)], "text string")
    assert df.select(text.sentences(F.col("text"))).first()[0] == ["One two.", "Three"]
