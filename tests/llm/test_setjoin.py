import random
import re

import numpy as np
import pytest
from cohortlab.llm import neardup, overlap, queries, setjoin, sigtree
from pyspark.sql import functions as F

W = re.compile(r"[^\W_]+")


def sim(a, b):
    a, b = set(W.findall(a.lower())), set(W.findall(b.lower()))
    return len(a & b) / len(a | b)


def texts(rng, n, words=400):
    vocab = [f"w{i}" for i in range(words)]
    out = [" ".join(rng.choices(vocab, k=rng.randrange(15, 60))) for _ in range(n)]
    for _ in range(n):  # near copies: substitutions, insertions, another order
        w = rng.choice(out).split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            rng.shuffle(w)
        out.append(" ".join(w))
    return out


def test_tree_bound_loses_nothing():
    rng = random.Random(1)
    t = [" ".join(f"w{i}" for i in rng.sample(range(120), rng.randrange(5, 40))) for _ in range(150)]
    t += [x + " extra" for x in t[:60]]
    from cohortlab.llm.words import Memo, distinct, hashed

    sets, bounds = distinct(*hashed(t, Memo()))
    r = sigtree.Records(np.arange(len(t)), sigtree.bitmaps(sets, bounds), np.diff(bounds))
    got = {(min(a, b), max(a, b)) for i, j in sigtree.block_pairs(np.zeros(len(t), np.uint64), r, 0.8) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(t)) for j in range(i + 1, len(t)) if sim(t[i], t[j]) >= 0.8}
    assert want <= got and len(got) < len(t) ** 2 / 8
    side = np.array([i % 2 for i in range(len(t))], np.int8)
    r2 = sigtree.Records(r.ref, r.bits, r.size, side)
    two = {(min(a, b), max(a, b)) for i, j in sigtree.block_pairs(np.zeros(len(t), np.uint64), r2, 0.8, True) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert {(i, j) for i, j in want if i % 2 != j % 2} <= two and all(i % 2 != j % 2 for i, j in two)


@pytest.mark.parametrize("hot", [4096, 8])
def test_near_pairs(spark, hot):
    t = texts(random.Random(2), 150)
    rows = [(f"p{i:03d}", "s" if i % 3 else "u", x, None) for i, x in enumerate(t)]
    rows += [rows[0], ("n", "s", None, None), (None, "s", t[1], None), ("e", "s", "", None), ("short", "s", "a b", None), ("short2", "s", "a b", None), ("long", "s", "x1 x2 x3 " * 20_000, None), ("clash", "s", t[2], None)]
    df = spark.createDataFrame(rows, "id string, space string, text string, ref string")
    if hot == 4096:
        pairs = neardup.near_pairs(df.drop("ref"))
    else:  # every block is split by prefixes
        pairs = setjoin.similar(df.drop("ref").withColumn("side", F.lit(0)), 0.8, neardup.band_keyer, min_words=12, hot=hot)
    ok = {(r[0], r[1], r[2]) for r in rows if r[0] and r[2] and len(W.findall(r[2])) >= 12}
    want = {(a[0], b[0], a[1]) for a in ok for b in ok if a[0] < b[0] and a[1] == b[1] and sim(a[2], b[2]) >= 0.8}
    assert {(r["id_a"], r["id_b"], r["space"]) for r in pairs.collect()} == want


def test_many_copies_stay_linear(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:03d}", "s", base) for i in range(200)] + [(f"v{k}", "s", base + f" new{k}") for k in range(3)]
    df = spark.createDataFrame(rows, "id string, space string, text string")
    links = {(r["id_a"], r["id_b"]): r["link"] for r in neardup.near_pairs(df, copies=64).collect()}
    got = set(links)
    assert {links["c000", "c001"], links["c005", "v1"]} == {"first"} and links["v0", "v1"] == "pair"
    assert {("c000", f"c{i:03d}") for i in range(1, 200)} <= got
    assert {(f"c{i:03d}", f"v{k}") for i in range(200) for k in range(3)} <= got and len(got) < 1000


@pytest.mark.parametrize(("n", "copies"), [(65, setjoin.COPIES), (200, None)])
def test_every_pair_of_copies(spark, n, copies):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:03d}", "s", base) for i in range(n)] + [(f"v{k:03d}", "s", base + f" new{k}") for k in range(70)]
    got = neardup.near_pairs(spark.createDataFrame(rows, "id string, space string, text string"), copies=copies).collect()
    ids = sorted(r[0] for r in rows)
    assert {(r["id_a"], r["id_b"]) for r in got} == {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]} and {r["link"] for r in got} == {"pair"}


def test_one_word_in_every_text(spark):
    """A prefix block of all texts is cut into chunks, and no task joins more records than the bound."""
    rng = random.Random(9)
    few = [f"k{i}" for i in range(30)]
    t = [" ".join(rng.sample(few, rng.randrange(12, 22))) for _ in range(100)]
    t += [" ".join(x.split()[1:]) for x in t[:40]]
    rows = [(f"p{i:03d}", "s", x) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "id string, space string, text string").withColumn("side", F.lit(0))
    one = lambda flat, offsets, sets, bounds: (np.zeros(len(bounds) - 1, np.uint64), np.arange(len(bounds)))
    got = {(r["id_a"], r["id_b"]) for r in setjoin.similar(df, 0.8, one, hot=20).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and sim(a[2], b[2]) >= 0.8} and got
    from cohortlab.llm.words import Memo, distinct, hashed

    sets, bounds = distinct(*hashed(t, Memo()))
    block = np.zeros(len(t), setjoin.RECORD)
    block["ref"], block["bits"], block["size"] = np.arange(len(t)), sigtree.bitmaps(sets, bounds), np.diff(bounds)
    block["side"] = np.arange(len(t)) % 3 == 0
    for two in (False, True):
        out = [r for b in setjoin._chunks(block, 1, 0.8, two, 20) for r in b.to_pylist()]
        chunks = {r["i"]: np.frombuffer(r["blob"], setjoin.RECORD) for r in out if r["blob"]}
        assert max(map(len, chunks.values())) <= 10 and sum(map(len, chunks.values())) == len(t)
        meet = {(min(a, b), max(a, b)) for r in out if r["j"] is not None for a in chunks[r["i"]]["ref"].tolist() for b in chunks[r["j"]]["ref"].tolist()}
        assert all((i, j) in meet for i in range(len(t)) for j in range(i + 1, len(t)) if sim(t[i], t[j]) >= 0.8 and (not two or (i % 3 == 0) != (j % 3 == 0)))


def test_links_count_every_copy(spark):
    base = " ".join(f"h{i}" for i in range(40))
    rows = [(f"p{i:03d}", "s", x) for i, x in enumerate(texts(random.Random(6), 40))] + [(f"c{i:02d}", "s", base) for i in range(70)]
    rows += [("v", "s", base + " new"), ("c00", "s", rows[0][2]), ("d", "t", base), ("e", "t", base)]
    got = {(r["space"], r["id"]): (r["class_id"], r["links"]) for r in neardup.linked(spark.createDataFrame(rows, "id string, space string, text string")).collect()}
    near = {k: {b[0] for b in rows for a in rows if a[:2] == k and b[0] != k[0] and b[1] == k[1] and sim(a[2], b[2]) >= 0.8} for k in {r[:2] for r in rows}}

    def least(k):
        seen, todo = {k[0]}, [k[0]]
        while todo:
            todo = [y for x in todo for y in near[x, k[1]] - seen if not seen.add(y)]
        return min(seen)

    assert got == {(k[1], k[0]): (least(k), len(v)) for k, v in near.items() if v}
    assert got["s", "c05"][1] == 70


def test_rates_count_every_copy(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:02d}", "a" if i < 10 else "b", base) for i in range(75)] + [("v", "b", base + " new"), ("v2", "a", base + " new"), ("x", "a", base.replace("w", "x"))]
    rows += [("two", "b", base), ("two", "b", base + " old"), ("c00", "a", base), ("n", "a", None)]
    spark.createDataFrame([(i, r, (t,), (None,)) for i, r, t in rows], "persona_id string, run_id string, cognitive_motivation_profile struct<narrative: string>, demographics struct<family_context: string>").write.parquet(f"{tmp_path}/personas.parquet")
    spark.sql("select 'a' as run_id, 0.5d as near_duplicate_rate, timestamp'2024-01-01' as evaluated_at").write.parquet(f"{tmp_path}/evaluations.parquet")
    got = {r["run_id"]: (r["n_personas"], r["n_pairs"], r["rate"], r["reported"]) for r in queries.p6_rates(spark, str(tmp_path)).collect()}
    assert got == {"a": (12, 11 * 10 // 2, round(55 / 66, 6), 0.5), "b": (67, 67 * 66 // 2, 1.0, None)}


def test_groups(spark):
    p = spark.createDataFrame([("s", f"a{i:02d}", f"a{i + 1:02d}") for i in range(20)] + [("s", "x", "y"), ("t", "a00", "x")], "space string, id_a string, id_b string")
    got = {(r["space"], r["id"]): (r["class_id"], r["links"]) for r in neardup.groups(p).collect()}
    assert all(got["s", f"a{i:02d}"][0] == "a00" for i in range(21)) and got["s", "y"] == ("x", 1) and got["t", "x"][0] == "a00"
    assert neardup.groups(p.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [4096, 6])
def test_across_splits(spark, hot):
    rng = random.Random(3)
    t = texts(rng, 120)
    stock = "please mark the answer that fits you best today "
    split = [rng.choice(["train", " Train", "TEST", "validation", "other", None]) for _ in t]
    rows = [(f"i{i:03d}", stock + x if i % 2 else x, s, 1) for i, (x, s) in enumerate(zip(t, split, strict=True))]
    rows += [rows[5], ("n", None, "train", 1), (None, t[0], "train", 1), ("e", "", "test", 1), ("one", "word", "train", 1), ("uno", "word", "test", 1)]
    df = spark.createDataFrame(rows, "item_id string, text string, split string, space int")
    side = {None: None, "train": 0, "test": 1, "validation": 1, "other": None}
    ok = {(r[0], r[1], side[r[2] and r[2].strip().lower()]) for r in rows if r[0] and r[1]}
    want = {(a[0], b[0]) for a in ok for b in ok if a[2] == 0 and b[2] == 1 and sim(a[1], b[1]) >= 0.75}
    if hot == 4096:
        got = {(r["id_train"], r["id_held"]) for r in overlap.across(df, "item_id", "text", "split").collect()}
        assert got == want
    else:
        s = F.lower(F.trim("split"))
        r = df.select(F.col("item_id").alias("id"), F.lit("").alias("space"), F.when(s == "train", 0).when(s.isin("validation", "test"), 1).alias("side"), "text").where("side is not null")
        got = {(x["id_a"], x["id_b"]) for x in setjoin.similar(r, 0.75, overlap.winnow_keyer({}, {}, 0.75), two_sides=True, hot=hot).collect()}
        assert got == want


def test_prefix_blocks_are_exact():
    rng = random.Random(4)
    t = texts(rng, 80)
    from cohortlab.llm.words import Memo, distinct, hashed

    sets, bounds = distinct(*hashed(t, Memo()))
    keys, ends = setjoin.prefix_keyer(0.8, {int(sets[0]): 50, int(sets[5]): 9})(None, None, sets, bounds)
    own = [set(keys[ends[i] : ends[i + 1]].tolist()) for i in range(len(t))]
    assert all(own[i] & own[j] for i in range(len(t)) for j in range(i) if sim(t[i], t[j]) >= 0.8)


@pytest.mark.parametrize("t", [0.75, 0.8])
def test_cross_keys_are_exact(t):
    """Every pair that reaches the threshold shares a key, whatever its size and order."""
    rng, out = random.Random(5), []
    for n in [*range(1, 30), 60] * 3:
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        out.append(" ".join(w))
        for _ in range(3):
            x = [a for a in w if rng.random() > 0.1] + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 2 + n // 10))]
            rng.shuffle(x)
            out.append(" ".join(x or w))
    from cohortlab.llm.words import Memo, distinct, hashed

    flat, offsets = hashed(out, Memo())
    sets, bounds = distinct(flat, offsets)
    keys, ends = overlap.winnow_keyer({}, {}, t)(flat, offsets, sets, bounds)
    own = [set(keys[ends[i] : ends[i + 1]].tolist()) for i in range(len(out))]
    near = [(i, j) for i in range(len(out)) for j in range(i) if sim(out[i], out[j]) >= t]
    assert len(near) > 100 and all(own[i] & own[j] for i, j in near)


@pytest.mark.parametrize("many", ["test", "train"])
def test_copies_with_many_partners_keep_all_links(spark, many):
    other = {"test": "train", "train": "test"}[many]
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:02d}", base, many, "X") for i in range(70)] + [(f"v{i:02d}", base + f" new{i}", other, "X") for i in range(70)]
    df = spark.createDataFrame(rows, "item_id string, text string, split string, instrument string")
    found = overlap.across(df, "item_id", "text", "split")
    got = [(r["id_train"], r["id_held"]) for r in found.collect()]
    want = {(f"c{i:02d}", f"v{j:02d}") for i in range(70) for j in range(70)}
    assert {(min(p), max(p)) for p in got} == want and len(got) == len(want)
    r = overlap.overlap_report(df, found, "item_id", "split", "instrument").collect()
    assert [(x["n_items"], x["n_overlapping"], x["share"], x["mean_cover"]) for x in r] == [(70, 70, 1.0, 1.0 if many == "test" else round(40 / 41, 6))]


def test_chain():
    a = "one two three four five six seven eight nine ten".split()
    assert overlap.chain(a, a) == (1.0, 1.0)
    assert overlap.chain(a, a[:5] + ["x"] + a[5:]) == (1.0, 10 / 11)
    assert overlap.chain(a, a[5:] + a[:5]) == (0.5, 0.5)  # one order only
    assert overlap.chain(a, ["z"]) == (0.0, 0.0) and overlap.chain([], []) == (0.0, 0.0)


def test_report(spark):
    items = spark.createDataFrame([("a", "test", "X", "t1"), ("b", "test", "X", "t2"), ("c", "train", "X", "t1"), ("a", "test", "X", "t1")], "item_id string, split string, instrument string, text string")
    found = spark.createDataFrame([("c", "a", 1.0, 0.9, 0.8)], "id_train string, id_held string, similarity double, cover_train double, cover_held double")
    r = overlap.overlap_report(items, found, "item_id", "split", "instrument").collect()
    assert [(x["split"], x["source"], x["n_items"], x["n_overlapping"], x["share"]) for x in r] == [("test", "X", 2, 1, 0.5)]
