import random

import pytest
from cohortlab.operators import hierarchy
from pyspark.sql import functions as F

KEY = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))


def brute(parent):
    out = {}
    for a in parent:
        seen, x = [], a
        while x is not None and x not in seen:
            seen.append(x)
            p = parent[x]
            x = p if p in parent else None
        out[a] = (seen[-1], len(seen) - 1) if x is None else (min(seen[seen.index(x) :]), -1)
    return out


def solve(spark, parent, **kw):
    df = spark.createDataFrame(list(parent.items()), "id string, up string")
    return {r[0]: (r[1], r[2]) for r in hierarchy.resolve(df, "id", "up", **kw).select("node", "root", "depth").collect()}


@pytest.mark.parametrize("block", [3, 17, 10_000])
def test_random_forests_with_loops(spark, block):
    rng = random.Random(block)
    parent = {f"n{i:03d}": (f"n{rng.randrange(max(1, i)):03d}" if i % 9 else None) for i in range(300)}
    for k in range(0, 60, 20):  # loops of three, some nodes below them, one loop of itself
        parent[f"z{k}a"], parent[f"z{k}b"], parent[f"z{k}c"], parent[f"z{k}d"] = f"z{k}b", f"z{k}c", f"z{k}a", f"z{k}a"
    parent["self"] = "self"
    assert solve(spark, parent, block_rows=block) == brute(parent)


def test_long_chain_over_blocks(spark):
    parent = {f"c{i:04d}": f"c{i - 1:04d}" if i else None for i in range(700)}
    assert solve(spark, parent, block_rows=50) == brute(parent)


def test_paths_and_descendants(spark):
    parent = {"a": None, "b": "a", "c": "b", "d": "b", "x": "y", "y": "x"}
    df = spark.createDataFrame(list(parent.items()), "id string, up string")
    res = hierarchy.resolve(df, "id", "up", with_path=True, block_rows=2)
    assert {r["node"]: r["path"] for r in res.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "d"], "x": None, "y": None}
    assert {tuple(r) for r in hierarchy.descendants(res).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_odd_rows(spark):
    """Blank and unknown parents make roots, case and blanks don't matter, repeats count once, null nodes drop out."""
    rows = [("a", " ", 1), ("a", " ", 2), ("b", " A ", 1), ("c", "nowhere", 1), (None, "a", 1), ("d", None, 1)]
    df = spark.createDataFrame(rows, "id string, up string, node int")  # a clashing name
    got = {r[0]: (r[1], r[2]) for r in hierarchy.resolve(df, "id", "up", key=KEY).select("node", "root", "depth").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("c", 0), "d": ("d", 0)}


def test_empty_and_hot_parent(spark):
    assert hierarchy.resolve(spark.createDataFrame([], "id string, up string"), "id", "up").count() == 0
    parent = {"root": None} | {f"k{i}": "root" for i in range(500)}
    assert solve(spark, parent, block_rows=40) == brute(parent)


def test_neighbouring_blocks_merge_level_by_level(spark, monkeypatch):
    """With locality the boundary shrinks at every level and no round of joins is needed; loops cross blocks, too."""
    monkeypatch.setattr(hierarchy, "_doubled", lambda *a: pytest.fail("no locality found"))
    made, forest = [], hierarchy._forest
    monkeypatch.setattr(hierarchy, "_forest", lambda rows, path: made.append(rows) or forest(rows, path))
    rng = random.Random(8)
    rows, before = [], []
    for g in range(90):
        now = [f"g{g:02d}n{i}" for i in range(8)]
        rows += [(x, rng.choice(before[:2]) if before else None, g) for x in now]
        before = now
    rows += [("loop1", "loop2", 3), ("loop2", "loop3", 40), ("loop3", "loop1", 80), ("below", "loop3", 81)]
    df = spark.createDataFrame(rows, "id string, up string, generation int")
    res = hierarchy.resolve(df, "id", "up", locality=("generation",), block_rows=24, with_path=True).collect()
    parent = {a: b for a, b, _ in rows}
    assert {r["node"]: (r["root"], r["depth"]) for r in res} == brute(parent) and len(made) > 2
    for r in res:
        if r["path"] is not None:
            assert r["path"][-1] == r["node"] and r["path"][0] == r["root"] and all(parent[b] == a for a, b in zip(r["path"], r["path"][1:], strict=False))
