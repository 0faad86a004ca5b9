"""Importance resampling against the rules worked out one document at a time."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import importance


def plain(docs, target, longest, buckets, percent, min_words):
    def grams(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for g in grams(text)[1]:
                counts[place(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for d, text in docs:
        words, own = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(g)] for g in own)
        rows.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    live = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(live[: int(percent * len(live) // 100)], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 50), (3, 100)])
def test_equals_one_document_at_a_time(spark, longest, percent):
    rng = random.Random(longest)
    words = ["Alpha", "beta-gamma", "été", "ÉTÉ", "x1", "中文", "\U0001f600", "I", "don't", "_"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(80)]
    docs += [(None, "alpha beta"), (None, None), (81, ""), (82, "..."), (5, docs[5][1]), (5, "other words"), (83, "long " * 20_000)]
    target = ["alpha beta gamma", None, "", "x1 x1 X1"]
    frame = spark.createDataFrame([(d, t, 1, "b") for d, t in docs], "doc_id long, text string, row int, bucket string").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, aim, longest, 50, percent, 3)
    key = lambda rows: sorted(rows, key=str)
    assert key(map(tuple, got.collect())) == key(plain(docs, target, longest, 50, percent, 3))


def test_empty_tables(spark):
    docs, aim = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "text string")
    got = importance.resample(docs, aim, min_words=1, percent=100).orderBy("doc_id").collect()
    assert [(r.n_features, r["rank"]) for r in got] == [(3, 1), (0, None)]
    assert importance.resample(docs.limit(0), aim).count() == 0
    assert {r.weight for r in importance.resample(docs.where("doc_id = 2"), aim).collect()} == {0}


def test_ranks_go_on_over_partitions(spark):
    rows = spark.range(5000).withColumn("v", (F.col("id") * 7919) % 100)
    got = importance.ranked(rows, F.desc("v"), F.asc("id")).collect()
    assert [(-r.v, r.id) for r in sorted(got, key=lambda r: r["rank"])] == sorted((-r.v, r.id) for r in got)
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
