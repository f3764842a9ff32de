import heapq
import random

import pytest
from cohortlab.llm.topn import LoserTree, latest, top_n

SCHEMA = "g1 int, g2 string, score double, tie string, bucket int, rank int"  # clashing names


def brute(rows, n):
    by = {}
    for r in rows:
        if r[2] is not None and r[2] == r[2]:
            by.setdefault((r[0], r[1]), []).append(r)
    out = []
    for g, v in by.items():
        v.sort(key=lambda r: (-r[2], r[3] is None, r[3] or ""))
        out += [(*g, r[2], r[3], k + 1) for k, r in enumerate(v[:n])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [0, 1, 2, 5, 9])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(30), k=rng.randrange(8))) for _ in range(k)]
    at = [0] * k
    tree = LoserTree([r[0] if r else None for r in runs])
    out = []
    while k and tree.keys[w := tree.winner()] is not None:
        out.append(runs[w][at[w]])
        at[w] += 1
        tree.replace(w, runs[w][at[w]] if at[w] < len(runs[w]) else None)
    assert out == list(heapq.merge(*runs))


@pytest.mark.parametrize("parts", [1, 7])
def test_hot_group_ties_nulls(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["a", None]), rng.choice([0.5, 0.25, float("nan"), None, float("inf"), rng.random()]), rng.choice([None, f"t{rng.randrange(50):02d}"]), 9, 9) for _ in range(3000)]
    rows += rows[:100]  # repeated rows count each
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in top_n(df, ["g1", "g2"], "score", "tie", 5).collect()), key=repr)
    assert got == brute(rows, 5)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), ["g1"], "score", "tie", 3).count() == 0


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 1, 7), ("b", 1, 7)], "k string, t int, v int")
    assert {tuple(r) for r in latest(df, "k", ["v"], ["t"]).collect()} == {("a", None), ("b", 7)}
