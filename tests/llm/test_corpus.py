"""Ids in blocks, decontamination, mixing, licences and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontam, idcodec, mixing, simhash
from loomgraph.llm.queries import tokenizer_path

ODD = [None, "", " ", "  a  b\n\n c\t\td ", "a<|endoftext|>b", "x \n y", "don't  stop   now!!! 12  3", " a b　c", "a\x1cb \x85 c", "café, 中文 \U0001f600. a², 12,–", "word, " * 9000, "_x_ y__ -- z."]


@pytest.mark.parametrize("n", [0, 1, 2, 191, 192, 5000, 60_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.zipf(1.3, n) % 50_257, np.zeros(n, int), np.arange(n) % 7):
        assert (idcodec.unpack(idcodec.pack(ids, 50_257), n, 50_257) == ids).all()


def test_blocks_of_other_shapes_are_read(monkeypatch):
    ids = np.random.default_rng(1).integers(0, 100, 30_000)
    data = idcodec.write_block([1], np.array([len(ids)]), ids, 100)
    monkeypatch.setattr(idcodec, "LANES", 3)
    assert (idcodec.read_block(data)[2] == ids).all()


def test_repetition_is_cheap():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_257, 50), 4000)
    assert 8 * len(idcodec.pack(ids, 50_257)) / len(ids) < 2


def test_blocks_stand_alone_and_are_checked():
    data = idcodec.write_block([3, None, 9], np.array([2, 0, 3]), np.array([1, 2, 3, 4, 0]), 10)
    names, counts, ids = idcodec.read_block(data)
    assert (names, counts.tolist(), ids.tolist()) == ([3, None, 9], [2, 0, 3], [1, 2, 3, 4, 0])
    for at in (0, 5, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            idcodec.read_block(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        idcodec.read_block(data[:10])


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def random_texts(n=150, seed=1):
    rng = random.Random(seed)
    pieces = ["the", "house", "Ing", "x", "12", "3.5", ",", ".", "!!", "'s", "don't", " ", "  ", "\n", "\t", "é", " ", "_", "-", "١", "$$$", "á"]
    return ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def white_texts():
    import itertools

    return ["".join(p) for n in range(1, 7) for p in itertools.product("a \n", repeat=n)] + ["b\u00a0  c", " \t a", "x,  y.\n z", "q \u3000 r", "a   ", "  ,  ."]


@pytest.mark.parametrize("limit", [8, 500_000])
def test_encoder_equals_the_library(limit):
    texts = ODD + random_texts() + white_texts()
    encoder = idcodec.TextEncoder(tokenizer_path(), limit)
    for _ in range(2):
        ids, counts = encoder(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library_ids(texts)
    # Texts and words in any company: alone, in slices, and none at all.
    assert all(encoder([t])[0].tolist() == want for t, want in zip(texts, library_ids(texts)))
    assert [len(x) for x in encoder([])] == [0, 0]


@pytest.mark.parametrize("block_ids", [100, 1 << 20])
def test_ids_in_files(spark, block_ids, tmp_path):
    texts = ODD + random_texts(60, 2)
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(None, "null id"), (5, "tie b"), (5, "tie a")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, part int").repartition(4)
    path = str(tmp_path / "ids")
    idcodec.write(docs, path, tokenizer_path(), block_ids=block_ids)
    got = sorted(idcodec.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (name, text), ids in zip(got, rows, library_ids([t for _, t in rows]), strict=True):
        ids = ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (name, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_ids_of_nothing(spark):
    assert idcodec.round_trip(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def plain_normal(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def semiglobal(passage, text):
    previous = [0] * (len(text) + 1)
    for i, x in enumerate(passage):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(previous[j] + (x != y), previous[j + 1] + 1, now[j] + 1))
        previous = now
    return min(previous)


def passages(rng, n=12):
    words = ["".join(rng.choice(["an", "re", "the", "ou", "sh", "ti", "on"]) for _ in range(rng.randrange(1, 4))) for _ in range(80)]
    return words, [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 30))) for _ in range(n)]


def test_decontamination_equals_alignment(spark):
    rng = random.Random(3)
    words, items = passages(rng)
    texts = []
    for k in range(60):
        p = list(items[k % len(items)])
        for _ in range(rng.randrange(0, max(1, int(0.16 * len(p))))):
            at, kind = rng.randrange(len(p)), rng.random()
            p[at : at + (kind < 0.7)] = [] if kind < 0.3 else [rng.choice("abcdefgh")]
        fill = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 20)))
        texts.append(f"{fill()}, {''.join(p).upper() if k % 2 else ''.join(p)}! {fill()}")
    texts += ODD
    want = {(i, j): d for i, t in enumerate(texts) for j, p in enumerate(items) if decontam.budget(len(plain_normal(p))) >= (d := semiglobal(plain_normal(p), plain_normal(t)))}
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([*enumerate(items), (100, None), (101, ""), (102, "short"), (None, items[0])], "item_id long, text string")
    for group in (10**6, 60):  # one pass, and many
        got = {(r.doc_id, r.item_id): r.edits for r in decontam.matches(docs, bench, group_chars=group).collect()}
        assert got == want
    rows = {r.doc_id: r for r in decontam.summary(docs, bench).collect()}
    assert len(rows) == len(texts)
    for i in rows:
        own = sorted(j for a, j in want if a == i)
        assert (rows[i].n_items, rows[i].item_ids, rows[i].contaminated) == (len(own), ",".join(map(str, own)), bool(own))
        assert rows[i].least_edits == min([d for (a, _), d in want.items() if a == i], default=-1)
    assert {r.doc_id for r in decontam.remove(docs, bench).collect()} == set(rows) - {i for i, _ in want}


def test_decontamination_places(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    text = "Intro -- " + item.title() + "... end"
    (found,) = {(a, b) for _, _, n, a, b in decontam.search([text], decontam.build([1], [item])) if n == 0}
    assert plain_normal(text[found[0] : found[1]]).endswith("again and again") and abs(found[0] - 9) <= 2


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "some words that stand here for a while"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_items for r in decontam.summary(docs, none).collect()] == [0, 0] and decontam.remove(docs, none).count() == 2
    bench = spark.createDataFrame([(1, "some words that stand here for a while")], none.schema)
    assert decontam.summary(docs.limit(0), bench).count() == 0


def test_exponents():
    tokens = [900, 50, 30, 20]
    assert mixing.exponent(tokens) == 0.0 and mixing.exponent([5]) == 1.0 and mixing.exponent([]) == 1.0
    e = mixing.exponent(tokens, target=0.8)
    assert mixing.entropy(mixing.weights(tokens, e)) == pytest.approx(0.8 * math.log(4), abs=1e-9)
    e = mixing.exponent(tokens, target=0.99, max_repeats=3, budget=1000.0)
    assert max(mixing.repeats(tokens, mixing.weights(tokens, e), 1000.0)) == pytest.approx(3, abs=1e-6)
    e = mixing.exponent(tokens, target=0.99, max_repeats=1.5)
    passes = mixing.repeats(tokens, mixing.weights(tokens, e), None)
    assert min(passes) == pytest.approx(1) and max(passes) == pytest.approx(1.5, abs=1e-6)


def mixed_rows():
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "big" if i % 3 else f"s{i % 5}") for i in range(600)]
    return rows + [(700, None, "s1"), (701, "a b", None), (702, "", "empty"), (703, "a b c", "s1"), (703, "a b c", "s1")]


def test_plan_meets_quotas(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")
    got = mixing.plan(docs, target=0.95, max_repeats=3.0, block_tokens=200).collect()
    assert len(got) == len(rows) and Counter(r.n_tokens for r in got) == Counter(len((t or "").split()) for _, t, _ in rows)
    have, give, weight = Counter(), Counter(), {}
    for r in got:
        have[r.source] += r.n_tokens
        give[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
    total = sum(have.values())
    assert sum(weight.values()) == pytest.approx(1)
    names = sorted(have)
    e = mixing.exponent([have[s] for s in names], 0.95, 3.0, float(total))
    for s, w in zip(names, mixing.weights([have[s] for s in names], e)):
        assert weight[s] == pytest.approx(w) and (not have[s] or 0 <= give[s] - w * total + 1 <= 42)
    assert [r.copies for r in got if r.source == "empty"] == [1]
    # Copies follow the permutation: within a source those with one more pass come first, whole blocks at a time.
    again = {(r.doc_id, r.copies) for r in mixing.plan(docs.repartition(7), target=0.95, max_repeats=3.0, block_tokens=200).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_plan_equals_its_sql(spark, tmp_path):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    for target, most in ((0.95, 3.0), (0.999, 1.2), (0.1, 4.0)):
        got = mixing.plan(docs, target=target, max_repeats=most, block_tokens=200).collect()
        want = duckdb.sql(mixing.sql(target, most, block_tokens=200)).fetchall()
        plain = lambda r: (r[0] is None, *(r[0] or 0, r[1], r[2], round(r[3], 6), r[4], r[5], r[6]))
        assert sorted(map(plain, map(tuple, got))) == sorted(map(plain, want))


def test_realise_keeps_rows_and_columns(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*r, "kept", 4) for r in rows], "doc_id long, text string, source string, copies string, block int")
    out = mixing.realise(docs, target=0.95, max_repeats=1.5, budget=None)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 4 and len({times[i] for i in range(600)}) > 1
    empty = docs.limit(0)
    assert mixing.plan(empty).count() == 0 and mixing.realise(empty).count() == 0


def test_realise_takes_any_columns_and_orders_blocks(spark):
    rows = [(i if i % 9 else None, " ".join(["w"] * (i % 13)), f"s{i % 4 % 3}", *"abcdefgh") for i in range(400)]
    names = ["doc_id", "text", "source", "_id", "_copies", "_copy", "a.b", "key", "block", "place", "row"]
    docs = spark.createDataFrame(rows, names)
    out = mixing.realise(docs, target=0.99, max_repeats=2.5, block_tokens=50).cache()
    assert out.columns == names
    plan = mixing.plan(docs, target=0.99, max_repeats=2.5, block_tokens=50).collect()
    assert out.count() == sum(r.copies for r in plan)
    want = Counter()
    for r in plan:
        want[r.doc_id, r.n_tokens] += r.copies
    assert Counter((r[0], len(r[1].split())) for r in out.collect()) == +want
    # Blocks stay together, and their order is no order of sources or ids.
    parts = out.rdd.glom().map(lambda p: [(r[2], r[0]) for r in p]).collect()
    assert any(len({s for s, _ in p}) > 1 for p in parts)


def test_budgets_that_no_exponent_meets(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b", "y")], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.plan(docs, max_repeats=0.5)
    assert sum(r.copies for r in mixing.plan(docs, max_repeats=0.6, budget=3.0).collect()) == 2


@pytest.mark.parametrize("asked", [{"target": None, "max_repeats": None, "budget": 400.0}, {"target": 0.95, "max_repeats": 3.0, "budget": "total"}, {"target": 0.9, "max_repeats": 1.5, "budget": None}])
def test_more_sources_than_are_collected(spark, monkeypatch, asked):
    """Their quotas are found by sums over a table, and are the same; every row keeps its source."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{min(i % 10, 6)}") for i in range(200)] + [(900, "", "none"), (901, "a b", None)], "doc_id long, text string, source string")
    few = {r.doc_id: r for r in mixing.plan(docs, block_tokens=20, **asked).collect()}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    many = {r.doc_id: r for r in mixing.plan(docs, block_tokens=20, **asked).collect()}
    assert {r.doc_id: r.source or "" for r in docs.collect()} == {i: r.source for i, r in many.items()}
    assert few.keys() == many.keys()
    for i, r in few.items():
        assert (r.copies, r.block, r.place) == (many[i].copies, many[i].block, many[i].place) and many[i].weight == pytest.approx(r.weight, abs=1e-12)
    assert sum(r.copies for r in many.values()) == mixing.realise(docs, block_tokens=20, **asked).count()


def test_passages_of_one_item_fall_in_several_groups(spark, monkeypatch):
    texts = [f"passage number {i} has words {i * 7919} of its own and ends with {i * 104729}" for i in range(60)]
    bench = spark.createDataFrame([(7, t) for t in texts], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)] + [(99, "clean words")], "doc_id long, text string")
    built = []
    monkeypatch.setattr(decontam, "build", lambda items, own, edits, f=decontam.build: built.append(len(own)) or f(items, own, edits))
    got = {r.doc_id: (r.item_ids, r.contaminated) for r in decontam.summary(docs, bench.repartition(3)).collect()}
    assert built == [60]
    assert got == {r.doc_id: (r.item_ids, r.contaminated) for r in decontam.matches(docs, bench, group_chars=500).groupBy("doc_id").agg(F.first("item_id").cast("string").alias("item_ids"), F.lit(True).alias("contaminated")).collect()} | {99: ("", False)}
    assert len(built) > 5 and max(built[1:]) < 30


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words, items = passages(rng, 3)
    plain = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 120))) for _ in range(60)]
    texts = plain + [plain[0], plain[1]] + [p + " " + items[2] * 1 for p in plain[10:14]] + [p.replace(" ", " zgrumpf ", 6) for p in plain[20:32]] + [None, ""]
    toxic = set(range(66, 78))
    rows = [(i, t, "en", f"s{i % 7 % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(78)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        if name != "token_ids":
            assert out.columns == docs.columns
            docs = out
    every = set(range(len(rows)))
    assert seen[0] == every - toxic
    fps = {i: simhash.fingerprint(texts[i], 5) for i in seen[0]}
    near = {i for i in fps if any(j < i and bin(fps[i] ^ fps[j]).count("1") <= 4 for j in fps)}
    assert {60, 61, 79} <= near and seen[1] == seen[0] - near
    held = {i for i in seen[1] if any(plain_normal(p) in plain_normal(texts[i]) for p in items)}
    assert set(range(62, 66)) & seen[1] <= held and seen[2] == seen[1] - held
    assert seen[3] == seen[2] == seen[4]
    rows = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and sum(r.n_tokens for r in rows[:-1]) == rows[-1].start


def test_pipeline_keeps_columns_of_any_name_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    words, items = passages(rng, 2)
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)] + [None, "", "  ", long, long]
    names = ["_id", "_kept", "_copies", "_wanted", "a.b", "row", "key", "place", "node", "score"]
    rows = [(i if i != 7 else None, t, None if i == 3 else "en", None if i == 5 else f"s{i % 2}", len(t or ""), *names) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.schema == spark.read.parquet(str(tmp_path / "documents.parquet")).schema
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {*range(7), *range(8, 31), None, 33}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in docs.collect())
    empty = tmp_path / "empty"
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{table}.parquet")).limit(0).write.parquet(str(empty / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
