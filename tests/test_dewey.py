import json

from cohortlab.operators import dewey


def nodes(spark, *docs, **kw):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "doc string, text string")
    return dewey.label(df, "doc", "text", **kw).collect()


def test_labels_and_paths(spark):
    n = {r["label"]: r for r in nodes(spark, json.dumps({"a": [{"b": 1}, {"b": None}], "c": "x"}))}
    assert {k: r["path"] for k, r in n.items()} == {"0": "$", "0.0": "$.a", "0.0.0": "$.a[]", "0.0.0.0": "$.a[].b", "0.0.1": "$.a[]", "0.0.1.0": "$.a[].b", "0.1": "$.c"}
    assert n["0.0.1.0"]["kind"] == "null" and n["0.0.0.0"]["value"] == "1" and n["0.0.0.0"]["parent"] == "0.0.0"


def test_broken_null_empty(spark):
    assert nodes(spark, None, "", "{broken", "NaN", '{"a": NaN}') == []
    assert [r["kind"] for r in nodes(spark, "[]", "3", '"x"')] == ["list", "number", "string"]


def test_text_that_is_json_is_opened(spark):
    n = nodes(spark, json.dumps({"s": json.dumps([1, 2])}))
    assert [r["path"] for r in n] == ["$", "$.s", "$.s[]", "$.s[]"]


def test_very_deep_and_wide(spark):
    wide = json.dumps({"m": {f"k{i}": i for i in range(5000)}})
    assert len(nodes(spark, wide, maps=("$.m",))) == 5002
    assert nodes(spark, "[" * 100_000 + "]" * 100_000) == []  # deeper than the parser goes: as if broken


RUN = {
    "shadow_simulations": [
        {"persona_id": "p", "survey_id": "s", "responses": {"q1": 3, "q2": "4", "q3": " 2 ", "q4": 2.0, "q5": 2.5, "q6": True, "q7": {"value": 5, "ms": 1}, "q8": 9, "q9": "x", "q10": []}, "axis_scores": {"a": 0.25, "b": "0.5", "c": None}},
        {"responses": [{"item": "q1", "answer": {"value": 1}}, {"item_id": "q2", "response": "5", "note": "n"}], "axis_scores": [{"axis": "a", "score": 1}]},
        {"responses": None, "axis_scores": {"axes": {"a": 0.1}, "round": 3}},
    ]
}
WANT = {("r", 0, "response", "q1", 3), ("r", 0, "response", "q2", 4), ("r", 0, "response", "q3", 2), ("r", 0, "response", "q4", 2), ("r", 0, "response", "q7", 5), ("r", 0, "axis", "a", 250), ("r", 0, "axis", "b", 500), ("r", 1, "response", "q1", 1), ("r", 1, "response", "q2", 5), ("r", 1, "axis", "a", 1000), ("r", 2, "axis", "a", 100)}


def test_run_values(spark):
    """Lists, objects and texts of simulations; deliveries in another order don't mix; clashing columns don't matter."""
    again = json.loads(json.dumps(RUN))
    again["shadow_simulations"][1]["responses"].reverse()
    single = {"shadow_simulations": {"responses": {"q": 1}}}
    packed = {"shadow_simulations": json.dumps([{"responses": {"q": 1}}])}
    rows = [("r", json.dumps(RUN), "x"), ("r", json.dumps(again, indent=1), "x"), ("r", json.dumps(RUN)[:90], "x"), ("r", None, "x"), ("s", json.dumps(single), "y"), ("t", json.dumps(packed), "y"), ("u", "{}", None)]
    n = spark.createDataFrame(rows, "run_id string, payload string, label string")
    assert {tuple(r) for r in dewey.run_values(n).collect()} == WANT | {("s", 0, "response", "q", 1), ("t", 0, "response", "q", 1)}
    sims = {(r["run_id"], r["sim_no"], r["persona_id"]) for r in dewey.simulations(n).collect()}
    assert ("r", 0, "p") in sims and ("r", 2, None) in sims and ("s", 0, None) in sims


def test_empty_table(spark):
    n = spark.createDataFrame([], "run_id string, payload string")
    assert dewey.run_values(n).count() == 0


def test_tables_keep_parents(spark):
    doc = {"a": 1, "b": {"c": "x", "d": {"e": None}}, "l": [{"k": 1, "deep": [{"z": 5}]}, 7], "m": {"q": {"v": 2}, "w": [1]}}
    df = spark.createDataFrame([("0", json.dumps(doc))], "doc string, text string")
    r = {(x["path"], x["label"]): {(f["at"], f["key"].replace(dewey.SEP, "/")): f["value"] for f in x["fields"]} for x in dewey.tables(df, "doc", "text", ("$", "$.l[]", "$.l[].deep[]", "$.m"), ("$.m",), "v").collect()}
    assert r["$", "0"] == {("0", "a"): "n1", ("1", "b"): "o", ("1.0", "b/c"): "sx", ("1.1", "b/d"): "o", ("1.1.0", "b/d/e"): "z", ("2", "l"): "l", ("3", "m"): "o"}
    assert r["$.l[]", "0.2.0"] == {("0", "k"): "n1", ("1", "deep"): "l"} and r["$.l[]", "0.2.1"] == {("", ""): "n7"}
    assert r["$.l[].deep[]", "0.2.0.1.0"] == {("0", "z"): "n5"}  # its parent's label is a prefix
    assert r["$.m", "0.3"] == {("0", "q"): "n2", ("1", "w"): "l"} and len(r) == 5
