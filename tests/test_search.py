import json

import pytest
from cohortlab.operators import genome, search
from cohortlab.operators.policy import Policy

SEED = json.dumps({"quota_weights": {"a": 0.5, "b": 0.5}, "axis_bias": dict.fromkeys(genome.AXES, 0.1), "axis_stretch": dict.fromkeys(genome.AXES, 1.0), "style": "plain"}, sort_keys=True)
CONFIG = search.Config(islands=2, children=2, generations=2, extinction_every=2)


def test_search_and_resume(spark):
    evaluate = search.conditioned_evaluator(spark, 16)
    first = search.run(spark, search.Config(**{**CONFIG.__dict__, "generations": 1}), [SEED], evaluate)
    h = [r["best"] for r in first["history"].orderBy("generation").collect()]
    assert len(h) == 2 and h[1] >= h[0]
    again = search.run(spark, CONFIG, [], evaluate, resume=first["state"])
    assert again["state"]["generation"] == 3 and [r["best"] for r in again["history"].orderBy("generation").collect()][:2] == h
    hits = again["results"].where("cache_hit").count()
    assert hits >= 1  # the second island's seed is the first's phenotype
    assert again["elites"].groupBy("island_id", "metric").count().where("count > 1").count() == 0
    with pytest.raises(ValueError, match="differs"):
        search.run(spark, search.Config(islands=3), [], evaluate, resume=first["state"])
    sealed = search.sealed(again["elites"], evaluate)
    assert sealed.count() == again["elites"].count()


def test_mutation_is_repeatable_and_single_module(spark):
    jobs = [(i, i, 1, m, 0.2, f"op{i:02d}", "v4" if i > 1 else "v3", "cognitive_core", 1.1, 0.05, "echo_graph" if i > 1 else None, SEED) for i, m in enumerate(["mixed", "numeric_only", "mixed"])]
    df = spark.createDataFrame(jobs, "island_id int, child_idx int, generation int, mode string, scale double, operator_id string, family string, axis string, stretch double, bias double, module string, genome string")
    a, b = ({r["island_id"]: r["child"] for r in genome.mutate(d, 5).collect()} for d in (df, df.repartition(3)))
    assert a == b
    parent, v4 = json.loads(SEED), json.loads(a[2])
    assert {k for k in v4 if v4.get(k) != parent.get(k)} == {"echo_graph", "last_mutation", "last_evolution_operator"}
    v3 = json.loads(a[0])
    assert sum(v3["quota_weights"].values()) == pytest.approx(1.0) and all(-0.35 <= x <= 0.35 for x in v3["axis_bias"].values())


def test_elites_keep_incumbent_on_ties(spark):
    old = spark.createDataFrame([(0, "m", 1.0, "old", "g")], "island_id int, metric string, value double, candidate_id string, child string")
    new = spark.createDataFrame([(0, {"m": 1.0, "n": float("nan")}, "new", "h", 1, 0), (0, {"m": 0.5, "n": 0.2}, "n2", "i", 1, 1)], "island_id int, metrics map<string,double>, candidate_id string, child string, generation int, child_idx int")
    assert {(r["metric"], r["candidate_id"]) for r in search.merge_elites(old, new).collect()} == {("m", "old"), ("n", "n2")}


def test_extinction_spares_the_best(spark):
    rows = [(i, "global_best", v, f"c{i}", "g") for i, v in enumerate([0.1, 0.9, 0.5, 0.4, 0.2])]
    out = {r["island_id"]: r["candidate_id"] for r in search.extinct(spark.createDataFrame(rows, "island_id int, metric string, value double, candidate_id string, child string")).collect()}
    assert out == {0: "c1", 1: "c1", 2: "c2", 3: "c3", 4: "c1"}


def test_confirmation(spark):
    res = spark.createDataFrame([("a", "g"), ("b", "h")], "candidate_id string, child string")
    eli = spark.createDataFrame([("a",)], "candidate_id string")
    rep = spark.createDataFrame([("a", 1)], "candidate_id string, k int")
    assert [(r["candidate_id"], r["missing"]) for r in search.confirm(res, eli, rep, 3).collect()] == [("a", 2)]


def test_a_killed_search_goes_on_from_its_folder(spark, tmp_path):
    """Stopped in the middle of a generation, and in another process for what the driver knows: same elites, same policy."""
    evaluate = search.conditioned_evaluator(spark, 16)
    whole = search.run(spark, CONFIG, [SEED], evaluate, path=f"{tmp_path}/a")
    calls = []

    def dying(rows):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return evaluate(rows)

    with pytest.raises(RuntimeError, match="killed"):
        search.run(spark, CONFIG, [SEED], dying, path=f"{tmp_path}/b")
    assert search.load(spark, f"{tmp_path}/b")["generation"] == 2
    again = search.run(spark, CONFIG, [], evaluate, path=f"{tmp_path}/b")
    rows = lambda d: sorted(map(tuple, d.select("island_id", "metric", "value", "candidate_id").collect()))
    assert rows(again["elites"]) == rows(whole["elites"]) and again["state"]["history"] == whole["state"]["history"]
    assert again["policy"].state() == whole["policy"].state() and again["results"].count() == whole["results"].count()
    with pytest.raises(ValueError, match="differs"):
        search.run(spark, search.Config(islands=3), [], evaluate, path=f"{tmp_path}/b")


def test_study_and_manifest(spark, tmp_path):
    config = search.Config(islands=2, children=1, generations=1, repeats=2)
    evaluate = search.conditioned_evaluator(spark, 16)
    seen = []

    def noisy(rows):  # the second evaluation gives half of the first
        seen.append(sorted(r[0] for r in rows.select("repeat").distinct().collect()))
        half = rows.select("phenotype", "repeat").distinct()
        return evaluate(rows.select("phenotype", "child").distinct()).join(half, "phenotype").selectExpr("phenotype", "transform_values(metrics, (k, v) -> v / repeat) as metrics")

    done = search.study(spark, config, [SEED], noisy, evaluate, f"{tmp_path}/s")
    assert [2] in seen  # would-be elites were evaluated again
    top = done["elites"].where("metric = 'schema'").first()["value"]
    assert top == pytest.approx(0.75)  # the mean of 1 and 0.5
    assert search.config_of(spark, f"{tmp_path}/s") == config and done["manifest"]["best"]["value"] == search._best(done["elites"])
    assert done["sealed"].count() == done["elites"].count() and done["summary"].count() == 2
    assert {r["generation"]: r["n"] for r in search.backfill(spark, f"{tmp_path}/s").collect()} == {0: 2, 1: 2}


def test_extinction_interval_time_and_guard():
    c = search.Config(extinction_every=3, extinction_seconds=10.0)
    assert [g for g in range(1, 8) if search.extinction_due(c, g, 0, 0.0)] == [3, 6]
    assert search.extinction_due(c, 4, 0, 11.0) and not search.extinction_due(c, 4, 3, 11.0) and not search.extinction_due(c, 4, 2, 1.0)


def test_policy_learns_and_restores():
    p = Policy(["a", "b", "c"])
    assert [p.choose(1, 0, k) for k in range(3)] == ["a", "b", "c"]  # untried first, siblings apart
    for k, r in enumerate((0.1, 0.9, -0.2)):
        p.record(1, 0, k, r, r > 0.5)
    assert p.nodes[""].visits == 3 and p.paths[0] == ["b"] and p.edges[""]["b"].mean == 0.9
    assert p.choose(2, 1, 0) == "b" and p.choose(2, 0, 0) == "a"  # island 0 stands at a node that has tried nothing
    p.record(2, 0, 0, 0.5, True)
    assert p.paths[0] == ["b", "a"] and p.nodes["b"].visits == 2 and p.nodes["b/a"].visits == 1
    q = Policy.restore(p.state())
    assert q.state() == p.state() and q.choose(3, 1, 0) == p.choose(3, 1, 0)
    assert p.record(9, 9, 9, 1.0, True) == 0.0  # unknown children are ignored
    deep = Policy(["a"], depth=2)
    for g in range(5):
        deep.choose(g, 0, 0), deep.record(g, 0, 0, 1.0, True)
    assert deep.paths[0] == ["a", "a"] and max(len(k.split("/")) for k in deep.nodes) == 2
    assert "b" not in {o for own in Policy.restore(p.state(), ["a", "c"]).edges.values() for o in own}


def test_policy_widens_and_standardises():
    p = Policy([f"o{i}" for i in range(9)], widen=True, standardise=True)
    picks = []
    for g in range(6):
        picks.append(p.choose(g, 0, 0))
        p.record(g, 0, 0, 0.5 if g else 0.1, False)
        p.paths.clear()
    assert len(set(picks)) <= 4 and abs(p.seen[1] - (0.1 + 5 * 0.5) / 6) < 1e-12


def test_responder_mutates_and_rules_stand_in(spark):
    jobs = [(0, i, 1, "mixed", 0.2, f"op{i:02d}", "v3", "cognitive_core", 1.1, 0.05, None, SEED) for i in range(4)]
    df = spark.createDataFrame(jobs, "island_id int, child_idx int, generation int, mode string, scale double, operator_id string, family string, axis string, stretch double, bias double, module string, genome string")

    def responder(request):
        job = json.loads(request.split("\n\n")[0])
        if job["operator_id"] == "op00":
            return json.dumps({**job["genome"], "style": "vivid"})
        if job["operator_id"] == "op01":  # no change at first
            return json.dumps({**job["genome"], "style": "terse"}) if "nothing was changed" in request else json.dumps(job["genome"])
        if job["operator_id"] == "op02":
            return '{"style": "bare"}'
        raise RuntimeError("down")

    got = {r["operator_id"]: r for r in genome.mutate_with(df, responder, 5, pause=0.0).collect()}
    assert [got[f"op{i:02d}"]["by"] for i in range(4)] == ["responder", "responder", "rules", "rules"]
    assert json.loads(got["op00"]["child"])["style"] == "vivid" and json.loads(got["op01"]["child"])["style"] == "terse"
    assert "missing" in got["op02"]["error"] and "down" in got["op03"]["error"] and got["op00"]["error"] is None
    plain = {r["operator_id"]: r["child"] for r in genome.mutate(df, 5).collect()}
    assert got["op03"]["child"] == plain["op03"]
