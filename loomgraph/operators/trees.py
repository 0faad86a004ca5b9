"""Trees of tokens as intervals: what hangs under a token, over any number of levels, is a range of numbers.

Tokens are numbered once, a sentence at a time, in the order in which a tree is walked down; a token's subtree is then
the numbers from its own to the last one under it. Trees may use some of the relations only, each kind with numbers of
its own. So a closure is a join on equal trees with a range, however deep the trees are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffled, tasks_for


def walked(ids: list[int], heads: list[int], linked: list[bool]) -> tuple[list[int], list[int], list[int]]:
    """(top, pre, last) of each token of a sentence: its tree's root, its number, and the last number under it.

    A token hangs under its head if it is linked and the head is another token of the sentence. Of tokens in a circle the
    least is taken for the root.
    """
    place = {t: k for k, t in enumerate(ids)}
    up = [place.get(h, -1) if on and h != t else -1 for t, h, on in zip(ids, heads, linked)]
    below: list[list[int]] = [[] for _ in ids]
    for k, p in enumerate(up):
        if p >= 0:
            below[p].append(k)
    top, pre, last, count = [-1] * len(ids), [-1] * len(ids), [-1] * len(ids), 0
    # Roots first; whatever they don't reach goes round in circles.
    for root in [*(k for k, p in enumerate(up) if p < 0), *sorted(range(len(ids)), key=ids.__getitem__)]:
        if pre[root] >= 0:
            continue
        stack = [(root, False)]
        while stack:
            k, done = stack.pop()
            if done:
                last[k] = count - 1
            elif pre[k] < 0:
                top[k], pre[k], count = ids[root], count, count + 1
                stack.append((k, True))
                stack += [(c, False) for c in reversed(below[k])]
    return top, pre, last


def forests(tokens: DataFrame, *, tasks: int | None = None, **kinds: Column) -> DataFrame:
    """(sentence_id, token_id) of every token, with top_k, pre_k and last_k for every kind k of tree: a condition on tokens that
    says which of them hang under their heads. One shuffle by sentence; a sentence is numbered in one task. There are as many
    tasks as given, or as tokens ask for, which are counted then."""
    names, tasks = list(kinds), tasks or tasks_for(tokens.sparkSession, tokens.count())
    rows = tokens.select(F.col("sentence_id").cast("long"), F.col("token_id").cast("long"), F.col("head_id").cast("long"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in kinds.items()])
    columns = ["sentence_id", "token_id", *[f"{part}_{k}" for k in names for part in ("top", "pre", "last")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(3 + len(names))]
        for batch in batches:
            held = [a + b.to_pylist() for a, b in zip(held, batch.columns)]
            # The last sentence may go on in the next batch.
            cut = len(held[0])
            while cut and held[0][cut - 1] == held[0][-1]:
                cut -= 1
            if cut:
                yield numbers([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held[0]:
            yield numbers(held)

    def numbers(own: list[list]) -> pa.RecordBatch:
        out: list[list[int]] = [[] for _ in range(3 * len(names))]
        begin = 0
        for end in range(1, len(own[0]) + 1):
            if end == len(own[0]) or own[0][end] != own[0][begin]:
                for k in range(len(names)):
                    for column, part in zip(out[3 * k : 3 * k + 3], walked(own[1][begin:end], own[2][begin:end], own[3 + k][begin:end])):
                        column += part
                begin = end
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (own[0], own[1], *out)], names=columns)

    dealt = rows.repartition(tasks, "sentence_id").sortWithinPartitions("sentence_id", "token_id")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def under(numbered: DataFrame, roots: DataFrame, kind: str, tasks: int | None = None) -> DataFrame:
    """(root, token_id): each of roots(token_id), once, with all that hangs under it in the trees of a kind. The joins have as many
    tasks as given, or as tokens ask for, which are counted then."""
    tasks = tasks or tasks_for(numbered.sparkSession, numbered.count())
    kept = shuffled(numbered.repartition(tasks, "token_id")).join(roots.select(F.col("token_id").cast("long")).repartition(tasks, "token_id"), "token_id", "left_semi")
    own = kept.select("sentence_id", F.col("token_id").alias("root"), F.col(f"top_{kind}").alias("_top"), F.col(f"pre_{kind}").alias("_from"), F.col(f"last_{kind}").alias("_to"))
    rest = numbered.select("sentence_id", "token_id", F.col(f"top_{kind}").alias("_top"), F.col(f"pre_{kind}").alias("_pre"))
    keys = ["sentence_id", "_top"]
    met = own.repartition(tasks, *keys).join(shuffled(rest.repartition(tasks, *keys)), keys)
    return met.where(F.col("_pre").between(F.col("_from"), F.col("_to"))).select("root", "token_id")
