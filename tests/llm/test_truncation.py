import random

import pytest
from cohortlab.llm import truncation as T
from pyspark.sql import functions as F

NOUNS = ["door", "garden", "lantern", "ledger", "river", "engine", "poem", "kettle", "village", "harbour"]
VERBS = ["keeps", "repairs", "sells", "paints", "counts", "hides"]


def sentence(rng):
    a, b, c = rng.choice(NOUNS), rng.choice(NOUNS), rng.choice(NOUNS)
    return rng.choice([f"The baker {rng.choice(VERBS)} a {a} near the {b}", f"After the move the old {a} became quiet and the {b} felt small", f"Nobody in the {a} knows who {rng.choice(VERBS)} the {b} of the {c}"])


def table(spark, n=900):
    """Source a writes full stops, b writes none and c cuts at 150 characters; some values of a and b are cut at random."""
    rng, rows, cut = random.Random(1), [], set()
    for i in range(n):
        src = "abc"[i % 3]
        text = ". ".join(sentence(rng) for _ in range(4)) + ("" if src == "b" else ".")
        if src == "c" and len(text) > 150:
            text = text[:150]
            cut |= {str(i)} if not text.rstrip().endswith(".") else set()
        elif src != "c" and i % 10 == 0:
            at = rng.randrange(60, len(text) - 12)
            text = text[:at]
            if not T.STOP.search(text.rstrip()) and not any(text.rstrip() == ". ".join(text.split(". ")[:k]) for k in range(1, 5) if k < len(text.split(". "))):
                cut.add(str(i))
        rows.append((str(i), src, text, "x"))
    odd = [("f1", "a", "n/a", "x"), ("f2", "a", "n/a", "x"), ("f3", "a", "n/a", "x"), ("q1", "a", sentence(rng) + ', or so they say: "peace."', "x"), ("q2", "a", sentence(rng) + ". (That is all.)", "x"), ("q3", "a", sentence(rng) + "!", "x"), ("z", "a", None, "x"), ("y", "a", "  ", "x"), ("w", "a", "-", "x"), (None, "a", "The", "x"), ("s", None, sentence(rng) + ".", "x")]
    return spark.createDataFrame(rows + odd + rows[:5], "id string, source string, body string, field string"), cut


def test_cuts_are_found(spark):
    df, cut = table(spark)
    s = T.scored(T.values(df, "id", "source", {"body": F.col("body")}))
    got = {r["id"] for r in s.where("cut").select("id").distinct().collect()}
    assert not got & {"f1", "f2", "f3", "q1", "q2", "q3", "z", "y", "w", "s"}
    hit = len(got & cut)
    assert hit / len(cut) > 0.93 and hit / len(got) > 0.93
    r = {x["source"]: x for x in T.cut_report(s).collect()}
    assert r["c"]["share"] > 0.5 and r[""]["n_cut"] == 0 and r["a"]["n_values"] == 300 + 3 + 3 + 1


@pytest.mark.parametrize("marker", ["…", "...", " [more]", " (cont", "�"])
def test_markers(spark, marker):
    df, _ = table(spark, 300)
    more = spark.createDataFrame([("m", "a", "The baker keeps a lantern near the" + marker, "x")], df.schema)
    s = T.scored(T.values(df.unionByName(more), "id", "source", {"body": F.col("body")}))
    assert s.where("id = 'm' and cut").count() == 1


def test_held_out_accuracy():
    rng = random.Random(9)
    texts = [". ".join(sentence(rng) for _ in range(5)) + "." for _ in range(600)]
    w = T.train(*T.examples(texts[:400]))
    x, y = T.examples(texts[400:], seed=11)
    right = sum((sum(w[f] for f in v) > 0) == bool(k) for v, k in zip(x, y, strict=True))
    assert right / len(y) > 0.93


def test_empty(spark):
    df = spark.createDataFrame([], "id string, source string, body string")
    s = T.scored(T.values(df, "id", "source", {"body": F.col("body")}))
    assert s.count() == 0 and T.cut_report(s).count() == 0


def test_very_long_text(spark):
    df, _ = table(spark, 60)
    long = spark.createDataFrame([("long", "a", "The baker keeps a lantern. " * 5000 + "The baker keeps a", "x")], df.schema)
    assert T.scored(T.values(df.unionByName(long), "id", "source", {"body": F.col("body")})).where("id = 'long' and cut").count() == 1
