"""Micro-fixtures with values that were worked out by hand, and brute-force twins."""

import math

import numpy as np
import pytest
from cohortlab.operators import diversity, genome, reports, rules, sampling, scoring, similarity, student, windows
from pyspark.sql import Row
from pyspark.sql import functions as F

WEIGHTS = [0.18, 0.16, 0.16, 0.17, 0.17, 0.16]


@pytest.mark.parametrize(("n", "want"), [(25, [5, 4, 4, 4, 4, 4]), (6, [1] * 6), (100, [18, 16, 16, 17, 17, 16])])
def test_largest_remainder(spark, n, want):
    df = spark.createDataFrame(list(enumerate(WEIGHTS)), "k int, w double")
    assert [r["n_slots"] for r in sampling.quota(df, "k", "w", "k", n).orderBy("k").collect()] == want


def test_quota_without_weights(spark):
    df = spark.createDataFrame([(0, 0.0), (1, None)], "k int, w double")
    assert sum(r["n_slots"] for r in sampling.quota(df, "k", "w", "k", 5).collect()) == 5


def test_axis_scores(spark):
    items = spark.createDataFrame([("q1", "c", 1, {"a": 1.0}), ("q2", "c", -1, {"a": 0.8, "b": 0.2}), ("q3", "d", 1, {"b": 0.4})], "item_id string, construct string, direction int, axis_weights map<string,double>")
    answers = spark.createDataFrame([(1, "q1", 5), (1, "q2", 4), (1, "q3", 2), (1, "q4", 3), (1, "q1x", None), (2, "q1", 9)], "sim_id bigint, item_id string, response int")
    s = scoring.item_scores(answers, items)
    assert sorted(r["score"] for r in s.collect()) == [0.25, 0.25, 1.0]
    got = {(r[0], r[1]): r[2] for r in scoring.axis_scores(s, answers, ("a", "b", "c")).collect()}
    assert got[1, "a"] == pytest.approx(2 / 3) and got[1, "b"] == pytest.approx(0.25) and got[1, "c"] == 0.5 and got[2, "a"] == 0.5


def test_entropy(spark):
    a = [(i, "q", k) for i, k in enumerate([1] * 10 + [2] * 20 + [3] * 40 + [4] * 20 + [5] * 10)]
    answers = spark.createDataFrame(a, "sim_id bigint, item_id string, response int")
    expected = answers.select("sim_id", "item_id", F.lit("x").alias("b"))
    r = scoring.quality(answers, expected, ["b"]).first()
    assert r["entropy"] == pytest.approx(0.913865, abs=1e-6) and r["completeness"] == 1.0 and r["neutral_rate"] == 0.4


def test_rule_penalties(spark):
    df = spark.createDataFrame([Row(axis_alignment=0.9)]).withColumn("issues", F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity")) for i, s in (("a", "error"), ("b", "warning"), ("c", "warning"))]))
    r = df.select((1 - rules.penalty()).alias("rule"), (0.7 * F.col("axis_alignment") + 0.3 * (1 - rules.penalty())).alias("score"), rules.valid().alias("ok")).first()
    assert r["rule"] == pytest.approx(0.85) and r["score"] == pytest.approx(0.885) and not r["ok"]


def test_empty_population(spark):
    df = spark.createDataFrame([], "axis_alignment double, rule_score double, score double, penalty double, issues array<struct<rule_id:string,severity:string>>")
    r = rules.population(df, []).first()
    assert (r["sample_size"], r["axis_target_mae"], r["weighted_issue_rate"], r["issue_rate"], r["strict_error"], r["mean_score"]) == (0, 1.0, 1.0, 1.0, 1.0, 0.0)


POINTS = [(0.0, 0.0), (1.0, 1.0), (0.5, 0.5), (0.5, 0.5)]


def points(spark, rows, pop="p"):
    return spark.createDataFrame([(pop, i, [float(x) for x in r]) for i, r in enumerate(rows)], "pop string, id bigint, point array<double>")


def test_pairwise_and_kl(spark):
    r = diversity.pairwise(points(spark, POINTS)).first()
    assert (r["n_pairs"], r["min_dist"]) == (6, 0.0) and r["avg_dist"] == pytest.approx(0.707107, abs=1e-6)
    assert diversity.kl_uniform(points(spark, POINTS), 2).first()["kl"] == pytest.approx(1.1575038, abs=1e-6)


def test_pairwise_over_many_blocks(spark):
    z = np.random.default_rng(1).random((300, 3))
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))[np.triu_indices(300, 1)]
    r = diversity.pairwise(points(spark, z), block=32).first()
    assert (r["n_pairs"], r["avg_dist"], r["min_dist"]) == (len(d), pytest.approx(d.mean()), pytest.approx(d.min()))


def test_single_point(spark):
    r = diversity.pairwise(points(spark, [(0.1, 0.2)])).first()
    assert (r["n_pairs"], r["avg_dist"], r["min_dist"]) == (0, 0.0, 0.0)


def test_coverage_and_dispersion(spark):
    z = np.random.default_rng(2).random((50, 3))
    for salt, frame, check in ((1, diversity.coverage(points(spark, z), 3, 0.2), lambda d: (d <= 0.2).mean()), (2, diversity.dispersion(points(spark, z), 3), max)):
        d = np.sqrt(((diversity.reference_points(3, salt)[:, None] - z[None]) ** 2).sum(2)).min(1)
        assert frame.first()[1] == pytest.approx(check(d))


def test_spread_beats_cluster(spark):
    g = np.random.default_rng(3)
    a, b = g.random((25, 2)), np.clip(0.5 + 0.05 * g.standard_normal((25, 2)), 0, 1)
    rows = points(spark, a, "spread").unionByName(points(spark, b, "cluster"))
    avg = {r["pop"]: r["avg_dist"] for r in diversity.pairwise(rows).collect()}
    kl = {r["pop"]: r["kl"] for r in diversity.kl_uniform(rows, 2).collect()}
    hull = {r["pop"]: r["hull"] for r in diversity.hull(rows).collect()}
    assert avg["spread"] > avg["cluster"] and kl["spread"] < kl["cluster"] and hull["spread"] > hull["cluster"]


def test_hull_volumes():
    cube = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    inner = np.random.default_rng(4).random((200, 3)) * 0.9 + 0.05
    assert diversity.hull_volume(np.concatenate([cube, inner])) == pytest.approx(1.0)
    assert diversity.hull_volume(cube[:, :2]) == pytest.approx(1.0)
    assert diversity.hull_volume(cube[:3]) == 0.0 and diversity.hull_volume(np.c_[cube[:, :2], np.zeros(8)]) == 0.0


def test_radius_shrinks():
    assert 0 < diversity.calibrated_radius(64, 2, trials=3) < diversity.calibrated_radius(16, 2, trials=3)


def test_composites(spark):
    r = spark.range(1).select(diversity.balanced(F.lit(0.4), F.lit(1.2), F.lit(0.35), F.lit(0.05)), diversity.combined(F.lit(0.9), F.lit(0.1), F.lit(0.4), F.lit(0.35), F.lit(0.05), 3), reports.gated(F.lit(0.6), F.lit(0.9), F.lit(0.4), F.lit(0.8), F.lit(1.0))).first()
    assert list(r) == [pytest.approx(0.315713, abs=1e-6), pytest.approx(0.253858, abs=1e-6), pytest.approx(0.3591, abs=1e-6)]


def test_research_score(spark):
    m = {"strict_consistency": F.lit(0.1), "shadow_mae": F.lit(0.2)}
    v = reports.fitness_view(lambda k: m.get(k, F.lit(None).cast("double")), F.lit(0.25))
    assert spark.range(1).select(v["research_score"]).first()[0] == pytest.approx(0.22795)


def test_running_z(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([0.1, 0.3, -0.2])], "g string, i int, v double")
    for z in (windows.z_scores(df, ["g"], ["i"], "v"), scoring.running(df, ["g"], ["i"], "v")):
        assert [r["z"] for r in z.orderBy("i").collect()] == [pytest.approx(x, abs=1e-6) for x in (0.0, 0.707107, -1.059626)]


def test_bests_over_partitions(spark):
    g = np.random.default_rng(5)
    v = [float(x) for x in g.integers(0, 40, 400)]
    df = spark.createDataFrame([(i % 3 == 0, i, x) for i, x in enumerate(v)], "g boolean, i int, v double")
    got = {r["i"]: (r["best_before"], r["new_best"], r["stale"]) for r in windows.bests(df, ["g"], ["i"], "v").collect()}
    state = {}
    for i, x in enumerate(v):
        best, last, n = state.get(i % 3 == 0, (None, 0, 0))
        n += 1
        new = best is None or x > best
        last = n if new else last
        assert got[i] == (best, new, n - last)
        state[i % 3 == 0] = (x if new else best, last, n)


def test_uct(spark):
    s = spark.createDataFrame([("", "a", 4, 0.4, 0.1), ("", "b", 6, 0.0, 0.0)], "node string, operator string, visits bigint, value_sum double, mean double")
    r = reports.uct(s).first()
    assert r["operator"] == "a" and r["uct"] == pytest.approx(0.1 + 1.4 * math.sqrt(math.log(11) / 4))


def test_tree_stats(spark):
    df = spark.createDataFrame([(["x", "y"], 1.0), (["x", "z"], 0.0), (["q", "w", "x", "y"], 2.0)], "path array<string>, reward double")
    got = {(r["node"], r["operator"]): (r["visits"], r["value_sum"]) for r in reports.tree_stats(df).collect()}
    assert got == {("", "x"): (2, 1.0), ("x", "y"): (1, 1.0), ("x", "z"): (1, 0.0), ("", "w"): (1, 2.0), ("w", "x"): (1, 2.0), ("w/x", "y"): (1, 2.0)}


def test_role_of_zero_metric(spark):
    df = spark.createDataFrame([("a", 1, 0.5, {"e": 0.0}), ("b", 1, 0.4, {"e": 0.1})], "candidate_id string, generation bigint, fitness double, metrics map<string,double>")
    assert reports.roles(df, {"r": ("e", "min")}).first()["candidate_id"] == "b"


def test_sample_deviation_of_one(spark):
    r = reports.summary(spark.createDataFrame([("k", 2.0)], "k string, v double"), ["k"], "v").first()
    assert (r["n"], r["std"], r["sem"]) == (1, 0.0, 0.0)


def test_bootstrap(spark):
    g = np.random.default_rng(6)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(g.normal(5, 1, 60))] + [("b", 0, 3.0)], "k string, i int, v double")
    r = {x["k"]: x for x in reports.bootstrap(df, ["k"], "v", draws=400).collect()}
    assert r["b"]["low"] == r["b"]["high"] == 3.0
    se = 1 / math.sqrt(60)
    assert r["a"]["low"] < r["a"]["mean"] < r["a"]["high"] and 2 * se < r["a"]["high"] - r["a"]["low"] < 6 * se


@pytest.mark.parametrize("t", [0.5, 0.75, 0.8])
def test_similarity_join(spark, t):
    g = np.random.default_rng(7)
    sets = [sorted({f"w{x}" for x in g.integers(0, 25, g.integers(0, 14))}) for _ in range(120)]
    sets += [sets[0], sets[1], [], []]
    rows = [("g" if i % 2 else "h", i, s) for i, s in enumerate(sets)] + [("g", 900, None), (None, 901, ["w1"])]
    df = spark.createDataFrame(rows, "grp string, id bigint, tokens array<string>")

    def jac(a, b):
        return 1.0 if not a and not b else len({*a} & {*b}) / len({*a} | {*b})

    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if i % 2 == j % 2 and jac(sets[i], sets[j]) >= t}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df, t).collect()} == want


def test_numbered(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(200)][::-1], "k string")
    assert [r[0] for r in sampling.numbered(df, ["k"], "n").orderBy("k").select("n").collect()] == list(range(200))


def test_surveys_cover_axes(spark):
    bank = spark.createDataFrame([(i, f"q{i}", {"a": 1.0} if i else {"b": 1.0}) for i in range(9)], "no bigint, item_id string, axis_weights map<string,double>")
    rows = sampling.surveys(bank, 4, 3, 1, "train", ["a", "b"]).collect()
    assert len(rows) == 12 and all(any(r["item_id"] == "q0" for r in rows if r["survey_no"] == s) for s in range(1, 5))


def test_slots(spark):
    strata = spark.createDataFrame([("a", 3, ["x"], ["m"]), ("b", 5, ["y"], ["n", "o"])], "label string, n_slots bigint, stages array<string>, drives array<string>")
    rows = sampling.slots(strata, spark, 8, 7).collect()
    assert sorted(r["quota_label"] for r in rows) == ["a"] * 3 + ["b"] * 5 and len({r["slot_id"] for r in rows}) == 8
    assert all(0 <= r["x0"] < 1 for r in rows)


def test_context_without_cues(spark):
    r = student.appraise(spark.createDataFrame([(None,)], "t string"), "t").first()
    assert r["threat"] == 0.25 and r["deadline_pressure"] == 0.15


def test_genome_parts(spark):
    df = spark.createDataFrame([({"a": 0.9, "b": 0.0}, {"x": 0.9, "y": None})], "q map<string,double>, b map<string,double>")
    r = df.select(genome.normalized("quota_weights", F.col("q")), genome.normalized("axis_bias", F.col("b"))).first()
    assert r[0] == {"a": pytest.approx(0.6 / 0.62), "b": pytest.approx(0.02 / 0.62)} and r[1] == {"x": 0.35, "y": 0.0}


def test_audit_and_patch(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"})], "p map<string,string>, k map<string,string>")
    a = genome.audit(F.col("p"), F.col("k"), F.array(F.lit("b"), F.lit("z")))
    assert list(df.select(*a.values()).first()) == [["b", "c"], ["c"], ["z"]]
    assert df.select(genome.patch(F.col("p"), F.col("k"))).first()[0] == {"a": "1", "b": "3", "c": "4"}


def test_design(spark):
    d = genome.factorial(genome.catalogue(spark), genome.MODES, 2, [("numeric_only", "v4")])
    assert d.count() == 27 * 4 * 2 - 6 * 2 and d.agg(F.max("run_no")).first()[0] == d.count()
    assert genome.family(genome.catalogue(spark), "free").count() == 21


def test_running_deviation_far_from_zero(spark):
    """Values around a billion with a deviation of 1: squared sums would lose every digit."""
    import numpy as np
    from cohortlab.operators import windows

    v = 1e9 + np.random.default_rng(1).standard_normal(400)
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(v)], "g string, i int, v double").repartition(4)
    got = {r["i"]: (r["run_n"], r["run_mean"], r["run_std"]) for r in windows.running(df, ["g"], ["i"], "v").collect()}
    for i in (0, 1, 57, 399):
        assert got[i][0] == i + 1 and got[i][1] == pytest.approx(v[: i + 1].mean(), abs=1e-6) and got[i][2] == pytest.approx(v[: i + 1].std(ddof=1) if i else 0.0, abs=1e-5)


def test_pair_counts_weigh_copies(spark):
    from cohortlab.operators import similarity

    words = [f"w{i}" for i in range(20)]
    rows = [("g", f"a{i}", words) for i in range(30)] + [("g", f"b{i}", [*words, "new"]) for i in range(10)] + [("g", "e1", []), ("g", "e2", []), ("g", "e3", []), ("g", None, words), ("h", "x", None)]
    df = spark.createDataFrame(rows, "grp string, id string, tokens array<string>")
    assert {r["grp"]: r["k"] for r in similarity.pair_counts(df, 0.8).collect()} == {"g": 40 * 39 // 2 + 3}
    assert similarity.similar_pairs(df, 0.8).count() == 40 * 39 // 2 + 3


def test_all_tasks(spark):
    from cohortlab.operators import sampling

    a, b = spark.createDataFrame([("p2",), ("p1",), (None,), ("p1",)], "p string"), spark.createDataFrame([(f"s{i}",) for i in range(5)], "s string")
    got = sorted((r["task_no"], r["p"], r["s"]) for r in sampling.tasks(a, "p", b, "s", block=2).collect())
    assert got == [(k, "p1" if k < 5 else "p2", f"s{k % 5}") for k in range(10)]
    assert sampling.tasks(a, "p", b.limit(0), "s").count() == 0


def nodes(node):
    """All nodes of a plan that has run."""
    name = node.getClass().getSimpleName()
    below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return [(name, node), *(x for k in below for x in nodes(k))]


def test_tasks_hold_no_pairs_of_blocks(spark):
    """Until a task passes its first row on, it has made the pairs of one left id, not all of its two blocks: those fill the memory."""
    from cohortlab.operators import sampling

    a, b = spark.range(3000).selectExpr("format_string('p%04d', id) p"), spark.range(700).selectExpr("format_string('s%03d', id) s")
    plan = sampling.tasks(a, "p", b, "s")._jdf.queryExecution().executedPlan()
    assert len(plan.execute().take(1)) == 1
    assert 0 < max(x.metrics().apply("numOutputRows").value() for name, x in nodes(plan) if name == "GenerateExec") <= 700
    assert not [x for name, x in nodes(plan) if name == "BroadcastHashJoinExec" and "_x#" in x.simpleString(25)]  # nor are copies of blocks broadcast


def shuffled_rows(df):
    """Runs a plan; the rows written by each of its exchanges."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()

    def of(node):
        name = node.getClass().getSimpleName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
        return own + [x for k in below for x in of(k)]

    return of(plan)


@pytest.mark.parametrize("t", [0.3, 0.8])
def test_similarity_join_shuffles_no_keys(spark, monkeypatch, t):
    """Neither keys nor candidates travel as rows: sets of 80 tokens have as many keys, and frequent keys make pairs of pairs."""
    g = np.random.default_rng(3)
    sets = [{f"w{int(x)}" for x in 5000 * g.random(g.integers(40, 90)) ** 3} for _ in range(200)]
    for _ in range(200):
        own = sorted(sets[g.integers(0, 200)])
        sets.append({*own[int(g.integers(0, 9)) :], *(f"n{int(x)}" for x in g.integers(0, 10**6, g.integers(0, 9)))})
    df = spark.createDataFrame([("g", i, sorted(s)) for i, s in enumerate(sets)], "grp string, id bigint, tokens array<string>")
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t}
    steps, write = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda x, label: steps.append(x) or write(x, label))
    found = similarity.similar_pairs(df, t)
    assert len(want) > 50 and {(r["a"], r["b"]) for r in found.collect()} == want
    if t == 0.8:
        assert max(x for step in [*steps, found] for x in shuffled_rows(step)) <= 1000


def test_tasks_shuffle_blocks_of_ids(spark):
    """No row of a left id and a block of right ids is shuffled: those grow as the pairs."""
    from cohortlab.operators import sampling

    a, b = spark.range(3000).selectExpr("format_string('p%04d', id) p"), spark.range(700).selectExpr("format_string('s%03d', id) s")
    df = sampling.tasks(a, "p", b, "s")
    r = df.selectExpr("count(*)", "count(distinct task_no)", "max(task_no)", "count_if(int(substr(p, 2)) * 700 + int(substr(s, 2)) <> task_no)").first()
    assert tuple(r) == (2_100_000, 2_100_000, 2_099_999, 0)

    assert 0 < max(shuffled_rows(df)) <= 3000


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from cohortlab import workspace

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        workspace.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


@pytest.mark.parametrize("table", ["STATE", "TRAITS", "STATE2", "STYLE"])
def test_a_wrong_weight_shows(spark, sf, table, monkeypatch):
    """The SQL twins have their own constants: a changed weight makes them differ."""
    from cohortlab.operators import student
    from cohortlab.plans import registry

    from tests import oracle

    stages = getattr(student, table)
    name, (constant, weights) = next(iter(stages[0].items()))
    wrong = {**stages[0], name: (constant, {**weights, next(iter(weights)): 0.011})}
    monkeypatch.setattr(student, table, (wrong, *stages[1:]))
    got = oracle.rows(registry.queries()["student_states"](spark, sf))
    assert got != oracle.sql_rows(oracle.tables(sf), registry.oracle_sql()["student_states"])


def test_built_narratives_pass_the_length_rule(spark, sf):
    from cohortlab.operators import rules
    from cohortlab.plans import registry

    low, high = rules.LENGTHS["narrative"][:2]
    n = registry.queries()["built_personas"](spark, sf).selectExpr("min(length(narrative)) a", "max(length(narrative)) b").first()
    assert low <= n["a"] <= n["b"] <= high


def test_best_before(spark):
    from cohortlab.operators import windows

    v = [3.0, 1.0, None, 5.0, 4.0, 5.0]
    df = spark.createDataFrame([(i, x, -i) for i, x in enumerate(v)], "i int, a double, b int").repartition(3)
    got = [(r["b_a"], r["b_b"]) for r in windows.best_before(df, [], ["i"], ["a", "b"]).orderBy("i").collect()]
    assert got == [(None, None), (3.0, 0), (3.0, 0), (3.0, 0), (5.0, 0), (5.0, 0)]


def test_extra_keys(spark):
    from cohortlab.operators import rules

    df = spark.createDataFrame([('{"a": 1, "d": {"x": 1, "y": 2}, "z": 0}',), ('{"a": 1}',), (None,), ("{broken",)], "t string")
    got = [r[0] for r in df.select(rules.extra_keys(F.col("t"), {"$": ("a", "d"), "$.d": ("x",)})).collect()]
    assert got == [["$.d.y", "$.z"], [], None, None]
