"""Queries over candidates of the search: reports, elites, repeats, rewards, roles, lineage, genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.functions.scalars import percent_delta
from cohortlab.functions.texts import genome_hash, phenotype_hash
from cohortlab.operators import genome, reports, search, windows
from cohortlab.plans import sqltext as T
from cohortlab.plans.persona_queries import _m, _t
from cohortlab.sources.artifacts import latest_payload
from cohortlab.streaming import elites as streams
from cohortlab.workspace import materialize

c = F.col
METRICS = ("validity", "coverage", "avg_dist", "alignment", "shadow_mae", "strict_consistency")


def _c(spark, sf):
    """One row per candidate, its last record; NaN fitness is none."""
    t = _t(spark, sf, "candidates").where("candidate_id is not null")
    last = t.groupBy("candidate_id").agg(F.max_by(F.struct("parent_id", "island_id", "generation", "fitness", "evaluated", "metrics", "genome", "seed_name", "recorded_at"), F.struct("recorded_at", "ingested_at")).alias("r")).select("candidate_id", "r.*")
    return last.withColumns({"fitness": F.when(~F.isnan("fitness"), c("fitness")), "generation": c("generation").cast("bigint")})


def _v(metric: str):
    return F.element_at("metrics", F.lit(metric))


def _style():
    return F.coalesce(F.get_json_object("genome", "$.style"), F.lit("none"))


def generation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per island and generation: candidates, mean, best, least fitness, the best candidate and the best so far."""
    g = reports.generations(_c(spark, sf).where("island_id is not null"), ["island_id"])
    return g.select("island_id", "generation", "n", *_m("mean_fitness"), "best_fitness", "min_fitness", "best_id", "best_so_far")


def first_reach(spark: SparkSession, sf: str) -> DataFrame:
    """First generation of each island's final best and the generations since."""
    g = reports.generations(_c(spark, sf).where("island_id is not null"), ["island_id"])
    return reports.first_reach(g, ["island_id"]).select("island_id", c("final").alias("best"), c("first").alias("first_generation"), c("last").alias("last_generation"), "stagnation")


def seed_report(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates per seed: scored, mean, deviation, best and least fitness, mean of three metrics."""
    d = _c(spark, sf).withColumns({m: _v(m) for m in ("coverage", "alignment", "validity")})
    g = reports.groups_report(d, ["seed_name"], means=("coverage", "alignment", "validity"))
    return g.select("seed_name", "n", "n_scored", *_m("mean", "std"), "best", "least", *_m("mean_coverage", "mean_alignment", "mean_validity"))


def style_report(spark: SparkSession, sf: str) -> DataFrame:
    """The same per style of the genome, ranked by mean, none last."""
    g = reports.groups_report(_c(spark, sf).withColumn("style", _style()), ["style"])
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), "style"))
    return g.withColumn("rank", rank.cast("bigint")).select("style", "n", "n_scored", *_m("mean", "std"), "best", "least", "rank")


def _long(spark, sf):
    """Metrics and fitness as rows."""
    m = F.map_concat(F.coalesce("metrics", F.create_map().cast("map<string,double>")), F.create_map(F.lit("fitness"), F.coalesce("fitness", F.lit(float("nan")))))
    return _c(spark, sf).where("island_id is not null").select("island_id", c("generation").alias("seq"), c("candidate_id").alias("id"), "generation", "seed_name", F.explode(m).alias("metric", "value"))


def island_elites(spark: SparkSession, sf: str) -> DataFrame:
    """Elite of every island and metric; the earlier generation, then the smaller id, wins ties."""
    return reports.elites(_long(spark, sf), ["island_id"]).select("island_id", "metric", c("id").alias("candidate_id"), "value")


def global_best(spark: SparkSession, sf: str) -> DataFrame:
    """Best candidate of each generation over islands by fitness, else coverage, else 0."""
    v = F.coalesce("fitness", _v("coverage"), F.lit(0.0))
    return _c(spark, sf).groupBy("generation").agg(F.min(F.struct((-v).alias("v"), c("candidate_id").alias("id"))).alias("b")).select("generation", c("b.id").alias("candidate_id"), (-c("b.v")).alias("value"))


def seed_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of every metric per seed over all its candidates; a missing metric counts as 0."""
    d = _c(spark, sf)
    n = d.groupBy("seed_name").agg(F.count("*").alias("n"))
    s = reports.metric_rows(d, ["seed_name"]).groupBy("seed_name", "metric").agg(F.sum("value").alias("s"))
    return s.join(n, "seed_name").select("seed_name", "metric", F.round(c("s") / c("n") + 1e-9, 6).alias("mean"))


def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population deviation of every metric per island."""
    r = reports.rollup(_c(spark, sf).where("island_id is not null").withColumns({m: _v(m) for m in METRICS}), ["island_id"], list(METRICS))
    return r.select("island_id", "metric", "n", *_m("mean", "std"))


def batch_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the standard error per seed, fitness included."""
    r = reports.rollup(_c(spark, sf).withColumns({m: _v(m) for m in METRICS}), ["seed_name"], [*METRICS, "fitness"])
    return r.select("seed_name", "metric", "n", *_m("mean", "std", "sem"))


def sealed_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population deviation of every metric per generation and over all: one pass with grouping sets."""
    d = reports.metric_rows(_c(spark, sf), ["generation"])
    g = d.groupingSets([[c("metric"), c("generation")], [c("metric")]], c("metric"), c("generation")).agg(F.count("*").cast("bigint").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.grouping("generation").cast("bigint").alias("over_all"))
    return g.select("metric", "generation", "over_all", "n", *_m("mean", "std"))


def elite_metric_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per generation and metric: mean, median, largest, least and deviation of the islands' elites."""
    b = reports.elites(_long(spark, sf), ["island_id", "generation"])
    s = b.groupBy("generation", "metric").agg(F.count("*").cast("bigint").alias("n_islands"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.max("value").alias("best"), F.min("value").alias("least"), F.stddev_pop("value").alias("std"))
    return s.select("generation", "metric", "n_islands", "best", "least", *_m("mean", "median", "std"))


def _repeats(spark, sf):
    return _t(spark, sf, "candidates").where("candidate_id is not null and fitness is not null").where(~F.isnan("fitness")).select("candidate_id", "recorded_at", "fitness").distinct()


def repeat_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded fitness of each candidate: n, mean, sample deviation, standard error."""
    return reports.summary(_repeats(spark, sf), ["candidate_id"], "fitness").select("candidate_id", "n", *_m("mean", "std", "sem"))


def repeat_values(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded values as numbered rows again, from their list in time order."""
    lists = _repeats(spark, sf).groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("recorded_at", "fitness"))).alias("v"))
    return lists.select("candidate_id", F.posexplode("v").alias("k", "e")).select("candidate_id", c("k").cast("bigint").alias("repeat"), c("e.fitness").alias("fitness"))


def noise_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics that every generation of a seed has: mean, deviation, range and two deviations."""
    n = reports.noise_floor(_long(spark, sf).where(~F.isnan("value")), "generation", ["seed_name"], "value")
    return n.select("seed_name", "metric", "n", *_m("mean", "std", "low", "high", "range", "two_sigma"))


def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """95 % bootstrap interval of the mean over generation means, per seed."""
    g = reports.finite(_c(spark, sf), "fitness").groupBy("seed_name", "generation").agg(F.round(F.avg("fitness"), 9).alias("m"))
    return reports.bootstrap(g, ["seed_name"], "m").select("seed_name", "n", *_m("mean", "low", "high"))


def ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates per seed and style against the mean of the plain style: n, mean, deviation, best, gain, beats."""
    d = _c(spark, sf).withColumn("style", _style())
    g = reports.groups_report(d, ["seed_name", "style"])
    ref = d.where("style = 'plain'").groupBy("seed_name").agg(F.avg("fitness").alias("ref"))
    j = g.join(ref, "seed_name", "left").withColumn("gain", F.round(c("mean") - c("ref") + 1e-9, 6))
    return j.select("seed_name", "style", "n", "n_scored", *_m("mean", "std"), "best", "gain", (c("gain") > 0).alias("beats"))


def time_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Start of each generation of an island, seconds since the one before and minutes since the first."""
    g = _c(spark, sf).where("island_id is not null").groupBy("island_id", "generation").agg(F.min("recorded_at").alias("t"))
    w = Window.partitionBy("island_id").orderBy("generation")
    s = F.unix_micros("t")
    return g.select("island_id", "generation", F.round((s - F.lag(s).over(w)) / 1e6, 3).alias("seconds"), F.round((s - F.first(s).over(w)) / 6e7, 4).alias("minutes"))


def _rewards(spark, sf):
    """Gain of each candidate over its parent."""
    d = materialize(_c(spark, sf).where("fitness is not null and island_id is not null"), "candidates")
    p = d.select(F.lower(F.trim("candidate_id")).alias("k"), c("fitness").alias("pf"))
    return d.withColumn("k", F.lower(F.trim("parent_id"))).join(p, "k").select("candidate_id", "island_id", "generation", F.round(c("fitness") - c("pf"), 9).alias("reward"), "fitness")


def reward_z(spark: SparkSession, sf: str) -> DataFrame:
    """Running mean, deviation and clipped z-score of the rewards of an island."""
    z = windows.z_scores(_rewards(spark, sf), ["island_id"], ["generation", "candidate_id"], "reward")
    return z.select("candidate_id", c("run_n").cast("bigint").alias("run_n"), *[F.round(c(n) + 1e-9, 5).alias(n) for n in ("run_mean", "run_std", "z")])


def stale_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Best fitness before each candidate of an island, whether it beats that, and candidates since that happened."""
    b = windows.bests(_rewards(spark, sf), ["island_id"], ["generation", "candidate_id"], "fitness")
    return b.select("candidate_id", c("run_n").cast("bigint").alias("run_n"), "best_before", "new_best", "stale", search.rotate(c("run_n") - 1).alias("objective"))


def phenotypes(spark: SparkSession, sf: str) -> DataFrame:
    """First candidate of each genome text and how many share it."""
    d = _c(spark, sf).where("genome is not null")
    return d.groupBy("genome").agg(F.min(F.struct("generation", "candidate_id")).alias("f"), F.count("*").cast("bigint").alias("n")).select(c("f.candidate_id").alias("candidate_id"), c("f.generation").alias("generation"), "n")


def genome_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of the canonical genome and of its phenotype, per candidate."""
    return _c(spark, sf).select("candidate_id", genome_hash("genome").alias("code_hash"), phenotype_hash("genome").alias("phenotype_hash"))


ROLES = {"best_fitness": ("fitness", "max"), "best_coverage": ("coverage", "max"), "best_alignment": ("alignment", "max"), "lowest_shadow_mae": ("shadow_mae", "min"), "best_validity": ("validity", "max"), "best_spread": ("avg_dist", "max"), "best_strictness": ("strict_consistency", "max"), "lowest_coverage": ("coverage", "min")}


def role_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate for each of eight roles."""
    return reports.roles(_c(spark, sf), ROLES).select("role", "metric", "candidate_id", "value", "fitness")


def elite_children(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty children dealt to the eight fittest candidates in turn."""
    top = reports.finite(_c(spark, sf), "fitness").orderBy(F.desc("fitness"), "candidate_id").limit(8)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("fitness"), "candidate_id")) - 1)
    kids = spark.range(20).select(c("id").alias("child"), (c("id") % 8).alias("r"))
    return kids.join(ranked, "r").select("child", c("candidate_id").alias("parent"), "fitness")


def extinction_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Islands by their best fitness and which of them, the worst half but never the best, take over the best one's elites."""
    b = reports.finite(_c(spark, sf), "fitness").where("island_id is not null").groupBy("island_id").agg(F.max("fitness").alias("best"))
    w = Window.orderBy("best", F.desc("island_id"))
    r = b.withColumns({"r": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return r.select("island_id", "best", ((c("r") <= F.greatest(F.lit(1), F.floor((c("n") - 1) / 2))) & (c("r") < c("n"))).alias("extinct"))


def extinction_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Elites of the islands after an extinction: the worst half takes over the best island's where those are better."""
    e = reports.elites(_long(spark, sf), ["island_id"]).select("island_id", F.when(c("metric") == "fitness", "global_best").otherwise(c("metric")).alias("metric"), "value", c("id").alias("candidate_id"), F.lit("").alias("child"))
    return search.extinct(materialize(e, "elites")).select("island_id", "metric", "candidate_id", "value")


def metric_heads(spark: SparkSession, sf: str) -> DataFrame:
    """First three metric names of each candidate: a slice with an explicit order."""
    return _c(spark, sf).select("candidate_id", F.array_join(F.slice(F.array_sort(F.map_keys("metrics")), 1, 3), ",").alias("names"))


def _paths(spark, sf):
    """Styles of grandparent, parent and candidate (those that exist) and the reward over the parent."""
    d = materialize(_c(spark, sf).select(F.lower(F.trim("candidate_id")).alias("k"), F.lower(F.trim("parent_id")).alias("pk"), _style().alias("style"), F.coalesce("fitness", F.lit(0.0)).alias("fitness")), "styles")
    p = d.select(c("k").alias("pk"), c("pk").alias("gk"), c("style").alias("ps"), c("fitness").alias("pf"))
    g = d.select(c("k").alias("gk"), c("style").alias("gs"))
    return d.join(p, "pk").join(g, "gk", "left").select(F.array_compact(F.array("gs", "ps", "style")).alias("path"), F.round(c("fitness") - c("pf"), 9).alias("reward"))


def tree_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Visits and value of every node and operator of the action tree."""
    return reports.tree_stats(_paths(spark, sf)).select("node", "operator", "visits", *_m("value_sum", "mean"))


def _styles(spark, sf) -> list[str]:
    return [r[0] for r in _c(spark, sf).select(_style()).distinct().collect()]  # the few operators of the tree


def tree_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Operator of each node: one that it has not tried, else by upper confidence, on a plateau."""
    return reports.uct(reports.tree_stats(_paths(spark, sf)), 1.4, stagnation=6, operators=_styles(spark, sf)).select("node", "operator", *_m("uct"))


def widened_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The same among the few operators that a node's visits admit."""
    return reports.uct(reports.tree_stats(_paths(spark, sf)), 1.4, widen=True, operators=_styles(spark, sf)).select("node", "operator", *_m("uct"))


def lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate with its parent's island and fitness."""
    d = materialize(_c(spark, sf).select("candidate_id", "parent_id", "island_id", "fitness"), "lineage")
    p = d.select(F.lower(F.trim("candidate_id")).alias("k"), c("candidate_id").alias("parent"), c("island_id").alias("parent_island"), c("fitness").alias("parent_fitness"))
    return d.withColumn("k", F.lower(F.trim("parent_id"))).join(p, "k").select("candidate_id", "parent", (~c("island_id").eqNullSafe(c("parent_island"))).alias("migrated"), F.round(c("fitness") - c("parent_fitness"), 6).alias("gain"))


def fitness_view(spark: SparkSession, sf: str) -> DataFrame:
    """The eleven elite metrics of every scored candidate."""
    v = reports.fitness_view(lambda m: _v(m) if m in METRICS else F.lit(None).cast("double"), c("fitness"))
    return _view(_c(spark, sf)).select("candidate_id", *_m(*v))


def _view(d: DataFrame) -> DataFrame:
    v = reports.fitness_view(lambda m: _strict() if m == "strict_consistency" else _v(m) if m in METRICS else F.lit(None).cast("double"), c("fitness"))
    return d.where("fitness is not null").select("candidate_id", "parent_id", "generation", *[x.alias(n) for n, x in v.items()])


def _strict():
    return 1.0 - _v("strict_consistency")


def _pairs(spark, sf):
    d = materialize(windows.best_before(_view(_c(spark, sf)), [], ["generation", "candidate_id"], list(reports.WEIGHTS)), "views")
    p = d.select(F.lower(F.trim("candidate_id")).alias("k"), *[c(m).alias(f"p_{m}") for m in reports.WEIGHTS])
    return d.withColumn("k", F.lower(F.trim("parent_id"))).join(p, "k")


def _better():
    return F.filter(F.array(*[F.when(c(m) > c(f"p_{m}"), F.lit(m)) for m in reports.WEIGHTS]), lambda x: x.isNotNull())


def parent_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Plain and structured reward of every candidate over its parent, with fixed and with deficit weights.

    Progress and deficits are taken against the best of all candidates before, by generation and id.
    """
    j = _pairs(spark, sf).withColumn("better", _better())
    better = F.when(F.size("better") > 0, c("better"))
    parent, child = lambda m: c(f"p_{m}"), lambda m: c(m)
    w = reports.deficit_weights(parent, lambda m: c(f"b_{m}"))
    progress = F.greatest(F.lit(0.0), F.coalesce(c("global_best") - c("b_global_best"), F.lit(0.0)))
    return j.select(
        "candidate_id",
        F.round(reports.reward(parent, child, better) + 1e-9, 6).alias("plain"),
        F.round(reports.structured_reward(parent, child, better, progress) + 1e-9, 5).alias("structured"),
        F.round(reports.structured_reward(parent, child, better, progress, w) + 1e-9, 5).alias("deficit"),
    )


def experiment_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Gated score and weighted composite of every candidate with metrics."""
    z = lambda m: F.coalesce(_v(m), F.lit(0.0))
    g = reports.gated(z("validity"), z("strict_consistency"), z("coverage"), z("alignment"), F.lit(1.0))
    composite = 0.4 * z("coverage") + 0.3 * z("alignment") + 0.2 * z("avg_dist") - 0.1 * z("shadow_mae")
    return _c(spark, sf).where("metrics is not null").select("candidate_id", F.round(g + 1e-9, 6).alias("gated"), F.round(composite + 1e-9, 6).alias("composite"))


def heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """Mean metrics per seed scaled to 0..1 over the seeds; errors the other way round; 0.5 for a flat metric."""
    m = reports.metric_rows(_c(spark, sf), ["seed_name"]).groupBy("seed_name", "metric").agg(F.round(F.avg("value"), 9).alias("v"))
    w = Window.partitionBy("metric")
    low, high = F.min("v").over(w), F.max("v").over(w)
    x = F.when(high > low, (c("v") - low) / (high - low)).otherwise(0.5)
    return m.select("seed_name", "metric", F.round(F.when((c("metric") == "shadow_mae") & (high > low), 1.0 - x).otherwise(x) + 1e-9, 6).alias("scaled"))


def best_vs_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Per seed the first scored candidate against the best one, with the change in percent."""
    d = reports.finite(_c(spark, sf), "fitness")
    g = d.groupBy("seed_name").agg(F.min(F.struct("generation", "candidate_id", "fitness")).alias("f"), F.min(F.struct((-c("fitness")).alias("v"), "candidate_id")).alias("b"))
    return g.select("seed_name", c("f.candidate_id").alias("baseline"), c("f.fitness").alias("baseline_fitness"), c("b.candidate_id").alias("best"), (-c("b.v")).alias("best_fitness"), F.round(percent_delta(-c("b.v"), c("f.fitness")) + 1e-9, 5).alias("percent"))


def normalised_genomes(spark: SparkSession, sf: str) -> DataFrame:
    """Axis bias of every genome held to its limits."""
    g = _c(spark, sf).withColumn("b", F.from_json("genome", "bias map<string,double>")["bias"]).where("b is not null")
    n = genome.normalized("axis_bias", c("b"))
    return g.select("candidate_id", *[F.round(F.element_at(n, F.lit(a)), 6).alias(a) for a in genome.AXES])


def genome_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of each genome against its parent's by top-level key, with ``style`` declared: actual, undeclared, phantom."""
    keys = ("version", "style", "bias", "scenario")
    m = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.get_json_object("genome", f"$.{k}"))]), lambda k, v: v.isNotNull())
    d = materialize(_c(spark, sf).where("genome is not null").select("candidate_id", "parent_id", m.alias("m")), "genomes")
    p = d.select(F.lower(F.trim("candidate_id")).alias("k"), c("m").alias("pm"))
    a = genome.audit(c("pm"), c("m"), F.array(F.lit("style")))
    return d.withColumn("k", F.lower(F.trim("parent_id"))).join(p, "k").select("candidate_id", *[F.array_join(v, ",").alias(n) for n, v in a.items()])


def patched_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each candidate patched with a fixed change: new keys join, given ones replace."""
    base = F.coalesce("metrics", F.create_map().cast("map<string,double>"))
    p = genome.patch(base, F.create_map(F.lit("coverage"), F.lit(1.0), F.lit("bonus"), F.lit(0.5)))
    return _c(spark, sf).select("candidate_id", F.element_at(p, F.lit("coverage")).alias("coverage"), F.element_at(p, F.lit("bonus")).alias("bonus"), F.element_at(p, F.lit("validity")).alias("validity"), F.size(F.map_keys(p)).cast("bigint").alias("n_keys"))


def operator_design(spark: SparkSession, sf: str) -> DataFrame:
    """Factorial design of operators, modes and three replicates without numeric runs of structured operators."""
    return genome.factorial(genome.catalogue(spark), genome.MODES, 3, [("numeric_only", "v4")])


def filled_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every island and generation up to its last with mean fitness; generations without results count as zero rows."""
    d = _c(spark, sf).where("island_id is not null and generation is not null")
    span = d.groupBy("island_id").agg(F.max("generation").alias("g")).select("island_id", F.explode(F.sequence(F.lit(0).cast("bigint"), c("g"))).alias("generation"))
    m = reports.finite(d, "fitness").groupBy("island_id", "generation").agg(F.avg("fitness").alias("mean"), F.count("*").alias("n"))
    return span.join(m, ["island_id", "generation"], "left").select("island_id", "generation", F.round(F.coalesce("mean", F.lit(0.0)) + 1e-9, 6).alias("mean"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def latest_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Length of the last payload of each run that has one."""
    r = _t(spark, sf, "experiment_runs").where("payload is not null")
    return latest_payload(r, "run_id", "payload", "ingested_at").select("run_id", F.length("payload").cast("bigint").alias("n_chars"))


def metric_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all metrics and how many candidates have them."""
    return _c(spark, sf).select(F.explode(F.map_keys("metrics")).alias("metric")).groupBy("metric").agg(F.count("*").cast("bigint").alias("n"))


def candidate_status(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by eligibility: evaluated with a positive fitness, stale, failed or waiting."""
    s = F.when(~c("evaluated"), "waiting").when(c("fitness").isNull(), "failed").when(c("fitness") <= 0, "stale").otherwise("eligible")
    return _c(spark, sf).groupBy(s.alias("status")).agg(F.count("*").cast("bigint").alias("n"))


def stream_elites(spark: SparkSession, sf: str) -> DataFrame:
    """Best fitness per island from a stream of the candidate files, run until all are read."""
    path = f"{sf}/candidates.parquet"
    out: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        out[:] = [materialize(batch, "elites")]

    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/candidates*.parquet")
    streams.island_elites(stream).writeStream.outputMode("complete").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return out[0].select("island_id", "fitness", "candidate_id", c("n").cast("bigint").alias("n"))


def island_search(spark: SparkSession, sf: str) -> DataFrame:
    """Three generations of the search from the genomes of the fittest candidates."""
    import json

    top = reports.finite(_c(spark, sf).where("genome is not null"), "fitness").orderBy(F.desc("fitness"), "candidate_id").limit(4).select("genome").collect()
    axes = genome.AXES
    first = []
    for r in top:
        bias = json.loads(r[0]).get("bias") or {}
        first.append(json.dumps({"quota_weights": {"a": 0.5, "b": 0.5}, "axis_bias": {a: max(-0.35, min(0.35, float(bias.get(a, 0.0)))) for a in axes}, "axis_stretch": {a: 1.0 for a in axes}, "style": "plain"}, sort_keys=True))
    done = search.run(spark, search.Config(), first or ["{}"], search.conditioned_evaluator(spark))
    return done["elites"].select("island_id", "metric", *_m("value"), "candidate_id")


QUERIES = {
    f.__name__: f
    for f in (
        *(generation_report, first_reach, seed_report, style_report, island_elites, global_best, seed_baseline, metric_rollup, batch_rollup),
        *(sealed_rollup, elite_metric_stats, repeat_summary, repeat_values, noise_floor, bootstrap_intervals, ablation, time_deltas, reward_z),
        *(stale_counters, phenotypes, genome_hashes, role_selection, elite_children, extinction_plan, extinction_merge, metric_heads, tree_stats, tree_choice),
        *(widened_choice, lineage, fitness_view, parent_rewards, experiment_scores, heatmap, best_vs_baseline, normalised_genomes),
        *(genome_edits, patched_metrics, operator_design, filled_grid, latest_payloads, metric_keys, candidate_status, stream_elites, island_search),
    )
}

# SQL ----------------------------------------------------------------------------------------------------------------
C = T.CANDIDATES
_me = "e as (select c.* exclude (metrics), x.key as metric, x.value as value from (select *, unnest(map_entries(metrics)) as x from c) c where x.value is not null and isfinite(x.value))"
_gen = f"{C}, g as (select island_id, generation, count(*) as n, round(avg(fitness) + 1e-9, 6) as mean_fitness, max(fitness) as best_fitness, min(fitness) as min_fitness, arg_min(candidate_id, (-fitness, candidate_id)) as best_id from c where island_id is not null and fitness is not null group by all), h as (select *, max(best_fitness) over (partition by island_id order by generation) as best_so_far from g)"
_lg = f"{C}, l as (select island_id, generation, seed_name, candidate_id, x.key as metric, x.value as value from (select *, unnest(list_concat(coalesce(map_entries(metrics), []), [{{'key': 'fitness', 'value': fitness}}])) as x from c where island_id is not null) where x.value is not null and isfinite(x.value))"
_st = "coalesce(json_extract_string(genome, '$.style'), 'none')"
_grp = lambda keys: f"count(*) as n, count(fitness) as n_scored, round(avg(fitness) + 1e-9, 6) as mean, round(stddev_pop(fitness) + 1e-9, 6) as std, max(fitness) as best, min(fitness) as least"  # noqa: E731, ARG005
_pk = "lower(trim(parent_id))"
_rw = f"{C}, rw as (select c.candidate_id, c.island_id, c.generation, round(c.fitness - p.fitness, 9) as reward, c.fitness from c join c p on lower(trim(p.candidate_id)) = lower(trim(c.parent_id)) and p.fitness is not null and p.island_id is not null where c.fitness is not null and c.island_id is not null)"
_path = f"""{C}, d as (select lower(trim(candidate_id)) as k, {_pk} as pk, {_st} as style, coalesce(fitness, 0.0) as fitness from c),
    pa as (select list_filter([g.style, p.style, d.style], lambda x: x is not null) as path, round(d.fitness - p.fitness, 9) as reward from d join d p on p.k = d.pk left join d g on g.k = p.pk),
    st as (select array_to_string(path[1:n - 1], '/') as node, path[n] as operator, reward from (select path, reward, unnest(range(1, len(path) + 1)) as n from pa)),
    tr as (select node, operator, count(*) as visits, sum(reward) as value_sum, sum(reward) / count(*) as mean from st group by all)"""
_number = lambda x: f"case json_type({x}) when 'DOUBLE' then cast(cast({x} as double) as varchar) else cast({x} as varchar) end"
_canonical = f"""case json_type(json_extract(g, '$.' || k)) when 'OBJECT' then '{{' || array_to_string(list_transform(list_sort(json_keys(json_extract(g, '$.' || k))), lambda m: '"' || m || '":' || {_number("json_extract(g, '$.' || k || '.' || m)")}), ',') || '}}' else {_number("json_extract(g, '$.' || k)")} end"""
_choice = f"""{_path}, ed as (select case when node = '' then operator else node || '/' || operator end as node, visits from tr),
    t as (select tr.*, coalesce(ed.visits, sum(tr.visits) over (partition by tr.node)) as total, row_number() over (partition by tr.node order by mean desc, tr.visits desc, operator) as r from tr left join ed on ed.node = tr.node),
    un as (select n.node, min(o.style) as operator from (select distinct node from tr) n, (select distinct style from d) o where not exists (select 1 from tr x where x.node = n.node and x.operator = o.style) group by n.node)"""
_mv = lambda m: f"metrics['{m}']"
_cl = lambda x: f"greatest(0.0, least(1.0, {x}))"
_shadow = f"(1 - coalesce({_mv('shadow_mae')}, greatest(0.0, 1 - coalesce({_mv('alignment')}, 0.0))))"
_target = "1.0"
_strict_sql = _cl(f"1 - coalesce(1 - {_mv('strict_consistency')}, 1.0)")
_viewcols = {
    "global_best": "fitness",
    "research_score": f"fitness * (0.7 + 0.3 * {_strict_sql}) * (0.7 + 0.3 * {_cl(_shadow)})",
    "coverage": f"coalesce({_mv('coverage')}, 0.0)",
    "alignment": f"coalesce({_mv('alignment')}, 0.0)",
    "shadow_mae": _cl(_shadow),
    "consistency": "0.0",
    "axis_target": "0.0",
    "issue_rate": "0.0",
    "strict_consistency": _strict_sql,
    "diversity": f"coalesce({_mv('avg_dist')}, {_mv('coverage')}, 0.0)",
    "schema": f"coalesce({_mv('validity')}, 0.0)",
}
_view_sql = f"{C}, vw as (select candidate_id, parent_id, generation, {', '.join(f'{x}::double as {n}' for n, x in _viewcols.items())} from c where fitness is not null)"
_d = lambda m: f"(a.{m} - p.{m})"
_lost = lambda m: f"greatest(0.0, -{_d(m)})"
_plain = (
    " + ".join(f"{w} * {_d(m)}" for m, w in reports.GAIN.items())
    + "".join(f" - {w} * {_lost(m)}" for m, w in reports.LOSS.items())
    + "".join(f" - case when {_d(m)} > 0 then {w} * ({_lost('coverage')} + {_lost('diversity')}) else 0 end" for m, w in reports.BESIDE.items())
    + " + case when nb > 0 then 0.01 * nb else 0 end"
)
_rel = lambda m: f"{_d(m)} / greatest(abs(p.{m}), 1e-6)"
_guard = " + ".join(f"greatest(0.0, -({_rel(m)}) - 0.02)" for m in reports.GUARDS)
_defw = {m: f"{w} * (greatest(0.0, coalesce(bb.b_{m}, p.{m}, 0.0) - p.{m}) + 0.02)" for m, w in reports.WEIGHTS.items()}
_deft = "(" + " + ".join(_defw.values()) + ")"
_z = lambda m: f"coalesce({_mv(m)}, 0.0)"


def _role_sql(role: str, metric: str, way: str) -> str:
    v = "fitness" if metric == "fitness" else _mv(metric)
    key = f"coalesce({'' if way == 'min' else '-'}nullif({v}, 0.0), 'infinity'::double)"
    return f"(select '{role}' as role, '{metric}' as metric, candidate_id, nullif({v}, 0.0) as value, fitness from c where fitness is not null order by {key}, -fitness, generation, candidate_id limit 1)"


SQL = {
    "generation_report": f"with {_gen} select island_id, generation, n, mean_fitness, best_fitness, min_fitness, best_id, best_so_far from h",
    "first_reach": f"with {_gen}, f as (select island_id, max(best_so_far) as best, max(generation) as last_generation from h group by 1) select f.island_id, best, min(h.generation) as first_generation, last_generation, last_generation - min(h.generation) as stagnation from f join h on h.island_id = f.island_id and abs(h.best_so_far - best) < 1e-12 group by f.island_id, best, last_generation",
    "seed_report": f"with {C} select seed_name, {_grp('')}, {', '.join(f'''round(avg({_mv(m)}) + 1e-9, 6) as mean_{m}''' for m in ('coverage', 'alignment', 'validity'))} from c group by seed_name",
    "style_report": f"with {C}, s as (select {_st} as style, {_grp('')}, avg(fitness) as raw from c group by 1) select style, n, n_scored, mean, std, best, least, row_number() over (order by raw desc nulls last, style) as rank from s",
    "island_elites": f"with {_lg} select island_id, metric, arg_min(candidate_id, (-value, generation, candidate_id)) as candidate_id, max(value) as value from l group by all",
    "global_best": f"with {C} select generation, arg_min(candidate_id, (-coalesce(fitness, {_mv('coverage')}, 0.0), candidate_id)) as candidate_id, max(coalesce(fitness, {_mv('coverage')}, 0.0)) as value from c group by generation",
    "seed_baseline": f"with {C}, {_me}, n as (select seed_name, count(*) as n from c group by 1) select e.seed_name, metric, round(sum(value) / any_value(n.n) + 1e-9, 6) as mean from e join n using (seed_name) group by all",
    "metric_rollup": f"with {C}, {_me} select island_id, metric, count(*) as n, round(avg(value) + 1e-9, 6) as mean, round(stddev_pop(value) + 1e-9, 6) as std from e where island_id is not null group by all",
    "batch_rollup": f"with {C}, l as (select seed_name, x.key as metric, x.value as value from (select seed_name, unnest(list_concat(coalesce(map_entries(metrics), []), [{{'key': 'fitness', 'value': fitness}}])) as x from c) where x.value is not null and not isnan(x.value)) select seed_name, metric, count(*) as n, round(avg(value) + 1e-9, 6) as mean, round(stddev_pop(value) + 1e-9, 6) as std, round(stddev_pop(value) / sqrt(count(*)) + 1e-9, 6) as sem from l group by all",
    "sealed_rollup": f"with {C}, {_me} select metric, generation, cast(grouping(generation) as bigint) as over_all, count(*) as n, round(avg(value) + 1e-9, 6) as mean, round(stddev_pop(value) + 1e-9, 6) as std from e group by grouping sets ((metric, generation), (metric))",
    "elite_metric_stats": f"with {_lg}, b as (select generation, island_id, metric, max(value) as best from l group by all) select generation, metric, count(*) as n_islands, max(best) as best, min(best) as least, round(avg(best) + 1e-9, 6) as mean, round(median(best) + 1e-9, 6) as median, round(stddev_pop(best) + 1e-9, 6) as std from b group by all",
    "repeat_summary": "with r as (select distinct candidate_id, recorded_at, fitness from candidates where candidate_id is not null and fitness is not null and not isnan(fitness)) select candidate_id, count(*) as n, round(avg(fitness) + 1e-9, 6) as mean, round(coalesce(stddev_samp(fitness), 0) + 1e-9, 6) as std, round(coalesce(stddev_samp(fitness), 0) / sqrt(count(*)) + 1e-9, 6) as sem from r group by 1",
    "repeat_values": "with r as (select distinct candidate_id, recorded_at, fitness from candidates where candidate_id is not null and fitness is not null and not isnan(fitness)) select candidate_id, row_number() over (partition by candidate_id order by recorded_at, fitness) - 1 as repeat, fitness from r",
    "noise_floor": f"with {_lg}, t as (select seed_name, count(distinct generation) as runs from l group by 1) select l.seed_name, metric, count(*) as n, round(avg(value) + 1e-9, 6) as mean, round(coalesce(stddev_samp(value), 0) + 1e-9, 6) as std, round(min(value) + 1e-9, 6) as low, round(max(value) + 1e-9, 6) as high, round(max(value) - min(value) + 1e-9, 6) as range, round(2 * coalesce(stddev_samp(value), 0) + 1e-9, 6) as two_sigma from l join t using (seed_name) group by l.seed_name, metric having count(distinct generation) = any_value(runs)",
    "ablation": f"with {C}, s as (select *, {_st} as style from c), r as (select seed_name, avg(fitness) as ref from s where style = 'plain' group by 1), g as (select seed_name, style, {_grp('')}, avg(fitness) as raw from s group by all) select seed_name, style, n, n_scored, mean, std, best, round(raw - ref + 1e-9, 6) as gain, round(raw - ref + 1e-9, 6) > 0 as beats from g left join r using (seed_name)",
    "time_deltas": f"with {C}, g as (select island_id, generation, epoch_us(min(recorded_at)) as s from c where island_id is not null group by all) select island_id, generation, round((s - lag(s) over w) / 1e6, 3) as seconds, round((s - first(s) over w) / 6e7, 4) as minutes from g window w as (partition by island_id order by generation)",
    "reward_z": f"""with {_rw}, w as (select candidate_id, reward, count(*) over o as run_n, avg(reward) over o as m, coalesce(stddev_samp(reward) over o, 0) as s from rw window o as (partition by island_id order by generation, candidate_id rows unbounded preceding))
        select candidate_id, run_n, round(m + 1e-9, 5) as run_mean, round(s + 1e-9, 5) as run_std, round(greatest(-3.0, least(3.0, (reward - m) / greatest(s, 0.02))) + 1e-9, 5) as z from w""",
    "stale_counters": f"""with {_rw}, w as (select *, row_number() over o as run_n, max(fitness) over (partition by island_id order by generation, candidate_id rows between unbounded preceding and 1 preceding) as best_before from rw window o as (partition by island_id order by generation, candidate_id)),
        n as (select *, coalesce(fitness > best_before, true) as new_best from w)
        select candidate_id, run_n, best_before, new_best, run_n - max(case when new_best then run_n end) over (partition by island_id order by generation, candidate_id rows unbounded preceding) as stale, {list(search.ROLES)!r}[cast((run_n - 1) % {len(search.ROLES)} as int) + 1] as objective from n""",
    "phenotypes": f"with {C} select arg_min(candidate_id, (generation, candidate_id)) as candidate_id, min(generation) as generation, count(*) as n from c where genome is not null group by genome",
    "role_selection": f"with {C} " + " union all ".join(_role_sql(r, m, w) for r, (m, w) in ROLES.items()),
    "elite_children": f"with {C}, t as (select *, row_number() over (order by fitness desc, candidate_id) - 1 as r from c where fitness is not null) select k.child, t.candidate_id as parent, t.fitness from (select unnest(range(0, 20)) as child) k join t on t.r = k.child % 8",
    "extinction_plan": f"with {C}, b as (select island_id, max(fitness) as best from c where fitness is not null and island_id is not null group by 1), r as (select *, row_number() over (order by best, island_id desc) as r, count(*) over () as n from b) select island_id, best, r <= greatest(1, floor((n - 1) / 2.0)) and r < n as extinct from r",
    "extinction_merge": f"""with {_lg}, e as (select island_id, case metric when 'fitness' then 'global_best' else metric end as metric, arg_min(candidate_id, (-value, generation, candidate_id)) as candidate_id, max(value) as value from l group by all),
        r as (select island_id, row_number() over (order by value, island_id desc) as r, count(*) over () as n from e where metric = 'global_best'), b as (select e.metric, e.candidate_id, e.value from e join r using (island_id) where r.r = r.n)
        select e.island_id, e.metric, case when r <= greatest(1, (n - 1) // 2) and b.value > e.value then b.candidate_id else e.candidate_id end as candidate_id, case when r <= greatest(1, (n - 1) // 2) and b.value > e.value then b.value else e.value end as value
        from e join r using (island_id) left join b on b.metric = e.metric""",
    "metric_heads": f"with {C} select candidate_id, array_to_string(list_sort(map_keys(metrics))[1:3], ',') as names from c",
    "tree_stats": f"with {_path} select node, operator, visits, round(value_sum + 1e-9, 6) as value_sum, round(mean + 1e-9, 6) as mean from tr",
    "tree_choice": f"with {_choice}, u as (select *, mean + 1.4 * 2.2 * sqrt(ln(total + 1.0) / visits) as uct from t) select u.node, coalesce(any_value(un.operator), arg_min(u.operator, (-uct, u.operator))) as operator, round(case when any_value(un.operator) is null then max(uct) end + 1e-9, 6) as uct from u left join un on un.node = u.node group by u.node",
    "widened_choice": f"""with {_choice}, w as (select *, floor(sqrt(greatest(1, total))) + 1 as width, count(*) over (partition by node) as k from t), u as (select *, mean + 1.4 * sqrt(ln(total + 1.0) / visits) as uct from w where r <= width)
        select u.node, case when any_value(k) < any_value(width) and any_value(un.operator) is not null then any_value(un.operator) else arg_min(u.operator, (-uct, u.operator)) end as operator, round(case when any_value(k) < any_value(width) and any_value(un.operator) is not null then null else max(uct) end + 1e-9, 6) as uct from u left join un on un.node = u.node group by u.node""",
    "genome_hashes": f"""with {C}, g as (select candidate_id, cast(genome as json) as g from c), k as (select candidate_id, g, list_sort(json_keys(g)) as ks from g),
        v as (select candidate_id, case when g is not null then '{{' || array_to_string(list_transform(ks, lambda k: '"' || k || '":' || {_canonical}), ',') || '}}' end as t from k)
        select candidate_id, sha256(t) as code_hash, sha256(t) as phenotype_hash from v""",
    "genome_edits": f"""with {C}, g as (select lower(trim(candidate_id)) as k, candidate_id, lower(trim(parent_id)) as pk, {", ".join(f"json_extract_string(genome, '$.{k}') as g_{k}" for k in ("version", "style", "bias", "scenario"))} from c where genome is not null),
        e as (select a.candidate_id, list_filter([{", ".join(f"case when a.g_{k} is distinct from p.g_{k} then '{k}' end" for k in ("bias", "scenario", "style", "version"))}], lambda x: x is not null) as l from g a join g p on p.k = a.pk)
        select candidate_id, array_to_string(l, ',') as actual, array_to_string(list_filter(l, lambda x: x <> 'style'), ',') as undeclared, case when list_contains(l, 'style') then '' else 'style' end as phantom from e""",
    "operator_design": """with ops as (select printf('op%02d', k) as operator_id, case when k <= 15 then 'legacy' when k <= 21 then 'v3' else 'v4' end as family from (select unnest(range(1, 28)) as k)),
        modes as (select * from (values ('prompt_only', 0), ('operator_only', 1), ('mixed', 2), ('numeric_only', 3)) m (mode, mode_no)), d as (select operator_id, family, mode, mode_no, unnest([1, 2, 3]) as replicate from ops, modes where mode <> 'numeric_only' or family <> 'v4')
        select operator_id, family, mode, replicate, row_number() over (order by mode_no, operator_id, replicate) as run_no from d""",
    "lineage": f"with {C} select c.candidate_id, p.candidate_id as parent, c.island_id is distinct from p.island_id as migrated, round(c.fitness - p.fitness, 6) as gain from c join c p on lower(trim(p.candidate_id)) = lower(trim(c.parent_id))",
    "fitness_view": f"with {_view_sql} select candidate_id, {', '.join(f'round({n} + 1e-9, 6) as {n}' for n in _viewcols)} from vw",
    "parent_rewards": f"""with {_view_sql}, bb as (select candidate_id, {", ".join(f"max({m}) over w as b_{m}" for m in reports.WEIGHTS)} from vw window w as (order by generation, candidate_id rows between unbounded preceding and 1 preceding)),
        j as (select a, p, bb, greatest(0.0, coalesce(a.global_best - bb.b_global_best, 0.0)) as progress, {" + ".join(f"case when a.{m} > p.{m} then 1 else 0 end" for m in reports.WEIGHTS)} as nb from vw a join vw p on lower(trim(p.candidate_id)) = lower(trim(a.parent_id)) join bb on bb.candidate_id = a.candidate_id)
        select a.candidate_id as candidate_id, round({_plain} + 1e-9, 6) as plain,
            round(case when a.global_best <= 0 then -1.0 else {" + ".join(f"{w} * {_rel(m)}" for m, w in reports.WEIGHTS.items())} + 0.5 * progress - 0.5 * ({_guard}) + case when nb > 0 then 0.02 * nb else 0 end end + 1e-9, 5) as structured,
            round(case when a.global_best <= 0 then -1.0 else ({" + ".join(f"{w} * {_rel(m)}" for m, w in _defw.items())}) / {_deft} + 0.5 * progress - 0.5 * ({_guard}) + case when nb > 0 then 0.02 * nb else 0 end end + 1e-9, 5) as deficit from j""",
    "experiment_scores": f"with {C} select candidate_id, round({_z('validity')} * (0.5 + 0.5 * {_cl(_z('strict_consistency'))}) * (0.5 + 0.5 * {_cl(_z('coverage'))}) * (0.5 + 0.5 * {_cl(_z('alignment'))}) + 1e-9, 6) as gated, round(0.4 * {_z('coverage')} + 0.3 * {_z('alignment')} + 0.2 * {_z('avg_dist')} - 0.1 * {_z('shadow_mae')} + 1e-9, 6) as composite from c where metrics is not null",
    "heatmap": f"with {C}, {_me}, m as (select seed_name, metric, round(avg(value), 9) as v from e group by all), w as (select *, min(v) over (partition by metric) as lo, max(v) over (partition by metric) as hi from m) select seed_name, metric, round(case when hi = lo then 0.5 when metric = 'shadow_mae' then 1 - (v - lo) / (hi - lo) else (v - lo) / (hi - lo) end + 1e-9, 6) as scaled from w",
    "best_vs_baseline": f"with {C}, g as (select seed_name, arg_min({{'id': candidate_id, 'f': fitness}}, (generation, candidate_id)) as f, arg_min({{'id': candidate_id, 'f': fitness}}, (-fitness, candidate_id)) as b from c where fitness is not null group by 1) select seed_name, f.id as baseline, f.f as baseline_fitness, b.id as best, b.f as best_fitness, round(case when abs(f.f) >= 1e-12 then (b.f - f.f) / abs(f.f) * 100 end + 1e-9, 5) as percent from g",
    "normalised_genomes": f"with {C}, b as (select candidate_id, json_extract(genome, '$.bias') as b from c where genome is not null) select candidate_id, {', '.join(f'''case when json_extract(b, '$.{a}') is not null then round(greatest(-0.35, least(0.35, cast(json_extract(b, '$.{a}') as double))), 6) end as {a}''' for a in genome.AXES)} from b where b is not null",
    "patched_metrics": f"with {C} select candidate_id, 1.0::double as coverage, 0.5::double as bonus, {_mv('validity')} as validity, cast(len(list_distinct(list_concat(coalesce(map_keys(metrics), []), ['coverage', 'bonus']))) as bigint) as n_keys from c",
    "filled_grid": f"with {C}, s as (select island_id, unnest(range(0, max(generation) + 1)) as generation from c where island_id is not null and generation is not null group by island_id), m as (select island_id, generation, avg(fitness) as mean, count(*) as n from c where fitness is not null group by all) select s.island_id, s.generation, round(coalesce(mean, 0.0) + 1e-9, 6) as mean, coalesce(n, 0) as n from s left join m using (island_id, generation)",
    "latest_payloads": "select run_id, length(arg_max(payload, ingested_at)) as n_chars from experiment_runs where payload is not null and run_id is not null group by run_id",
    "metric_keys": f"with {C} select k as metric, count(*) as n from (select unnest(map_keys(metrics)) as k from c) group by k",
    "candidate_status": f"with {C} select case when not evaluated then 'waiting' when fitness is null then 'failed' when fitness <= 0 then 'stale' else 'eligible' end as status, count(*) as n from c group by 1",
    "stream_elites": "select island_id, max(fitness) as fitness, arg_min(candidate_id, (-fitness, candidate_id)) as candidate_id, count(*) as n from candidates where evaluated and fitness is not null and not isnan(fitness) and island_id is not null group by island_id",
}
