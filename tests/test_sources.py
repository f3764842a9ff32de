import json

from cohortlab.sources import artifacts
from cohortlab.sources.slot_source import SlotSource


def test_candidate_files(spark, tmp_path):
    for name, x in {"a": {"candidate_id": "a", "fitness": 0.5, "last_evolution_operator": {"id": "op3"}}, "b": {"candidate_id": "b"}, "c": {"candidate_id": "c", "fitness": 0.1, "engine_mutation": {"operator_id": "op9"}, "last_mutation": {"mode": "mixed", "scale": 0.1}}, "d": {"candidate_id": "d", "fitness": 0.2, "last_evolution_operator": "op1"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    (tmp_path / "broken.json").write_text('{"candidate_id": "x", "fit')
    rows = {r["candidate_id"]: (r["operator_id"], r["mode"], r["generation"]) for r in artifacts.candidates(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("op3", "", 0), "c": ("op9", "mixed", 0), "d": ("op1", "", 0)}


def test_evaluations_skip_aliases(spark, tmp_path):
    for d in ("e1", "alias_e1"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.json").write_text(json.dumps({"fitness": 1.0, "candidate": {"candidate_id": d}}))
    assert artifacts.evaluations(spark, str(tmp_path)).count() == 1
    assert artifacts.evaluations(spark, str(tmp_path), aliases=True).count() == 2


def test_latest_alias_wins(spark):
    df = spark.createDataFrame([("k", "p1", 1, False), ("k", "p2", 2, False), ("k", "p0", 0, True)], "k string, p string, r int, a boolean")
    assert artifacts.latest_payload(df, "k", "p", "r").first()["p"] == "p2"
    assert artifacts.latest_payload(df, "k", "p", "r", "a").first()["p"] == "p0"


def test_store_split_and_digest(spark, tmp_path):
    items = spark.createDataFrame([("s1", 1, "q1", "train", "t"), ("s1", 0, "q2", "train", "u")], "survey_id string, item_pos int, item_id string, split string, text string")
    artifacts.write_split(items, str(tmp_path / "split"))
    back = spark.read.schema(items.schema).json(str(tmp_path / "split"))
    one, two = (artifacts.split_hash(d, "split", ["item_id", "text"]).first() for d in (items, back.repartition(3)))
    assert one == two and one["n_items"] == 2
    artifacts.write_store(items, str(tmp_path / "store"), ["split"])
    artifacts.write_store(items, str(tmp_path / "store"), ["split"])
    assert artifacts.read_store(spark, str(tmp_path / "store")).count() == 4


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    s = artifacts.Settings.load(str(tmp_path / "c.json"))
    assert s.get("a.b") == 1 and s.get("a.x.y", 7) == 7


def test_reports(spark):
    df = spark.createDataFrame([("</script>", 1)], "a string, b int")
    page = artifacts.to_html({"r": df}, "T")
    assert page.count("</script>") == 1 and "| a | b |" in artifacts.to_markdown(df)
    assert set(artifacts.unify({"x": df, "y": spark.range(1)}).columns) == {"a", "b", "id", "kind"}


def test_slot_source(spark):
    spark.dataSource.register(SlotSource)
    rows = spark.read.format("slots").option("n", 10).option("dims", 2).option("partitions", 3).load().collect()
    assert len({r["slot_id"] for r in rows}) == 10 and rows[0]["point"] == [0.5, 1 / 3]
