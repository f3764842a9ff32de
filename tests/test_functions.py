import hashlib

import pytest
from cohortlab.functions import scalars, texts
from pyspark.sql import functions as F


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("v", "want"), [(0.0, 0), (0.34, 1), (0.9999, 2), (1.0, 2), (-0.1, 0), (None, 1)])
def test_cell(spark, v, want):
    assert one(spark, v, "double", lambda x: scalars.cell(x, 3)) == want


@pytest.mark.parametrize(("v", "want"), [(0.34, "low"), (0.35, "mid"), (0.66, "high"), (None, None)])
def test_band(spark, v, want):
    assert one(spark, v, "double", scalars.band) == want


@pytest.mark.parametrize(("r", "d", "want"), [(5, 1, 1.0), (4, -1, 0.25), (2, 1, 0.25), (0, 1, None), (None, 1, None)])
def test_likert(spark, r, d, want):
    assert one(spark, r, "int", lambda x: scalars.likert(x, F.lit(d))) == want


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), ([], ["x"], 0.0), (["x", "y"], ["y", "z"], 1 / 3)])
def test_jaccard(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(scalars.jaccard("a", "b")).first()[0]
    assert got == pytest.approx(want)


def trim(text, limit):
    """What a smart trim means, by plain string search."""
    if len(text) <= limit:
        return text
    head = text[: max(0, limit - 1)]
    at = max([head.rfind(x) for x in (". ", "! ", "? ", "; ")] + [head.rfind(x) for x in "。！？；"])
    return (head[: at + 1].rstrip() if at >= int(limit * 0.6) else head.rstrip(" ,;:，；：")) + "…"


@pytest.mark.parametrize("text", ["short", "One. Two three four five six seven.", "No boundary in here at all, just words", "A. " + "b" * 60, "Ends here. and, goes on and on;", "中文。句子很长很长很长很长很长"])
@pytest.mark.parametrize("limit", [10, 20, 33])
def test_smart_trim(spark, text, limit):
    assert one(spark, text, "string", lambda x: scalars.smart_trim(x, limit)) == trim(text, limit)


def test_texts(spark):
    reply = '```json\n{"a": "}", "b": {"c": 1}} tail {'
    assert one(spark, reply, "string", texts.first_object) == '{"a": "}", "b": {"c": 1}}'
    assert one(spark, "no object {", "string", texts.first_object) is None
    assert one(spark, '{"b":1,"a":[2]}', "string", texts.genome_hash) == hashlib.sha256(b'{"a":[2],"b":1}').hexdigest()
    same = [one(spark, t, "string", texts.phenotype_hash) for t in ('{"a":1,"last_mutation":{"x":1}}', '{"a": 1}')]
    assert same[0] == same[1]
    assert one(spark, "broken", "string", texts.genome_hash) is None
    assert one(spark, '{"k": ["B", {"z": "A"}], "n": 1}', "string", texts.text_blob) == "b a"


@pytest.mark.parametrize(("reply", "want"), [('"q" 4', 4), ('{"q": "2"', 2), ('"q" = 9', 3), (None, 3)])
def test_salvage(spark, reply, want):
    assert one(spark, reply, "string", lambda x: texts.salvage(x, "q")) == want


@pytest.mark.parametrize(("kind", "value", "want"), [("number", "4.6", 4), ("string", "4.6", 3), ("boolean", "true", 1), ("string", " 5 ", 5), ("number", "99", 5), ("number", "-2", 1), ("none", None, 3)])
def test_answer(spark, kind, value, want):
    assert one(spark, value, "string", lambda x: texts.answer(F.lit(kind), x)) == want
