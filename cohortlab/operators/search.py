"""The island search: plan, mutate, evaluate, update elites, spread, checkpoint; one driver iteration per generation.

With a ``path`` every generation writes its elites, its results and its metrics there, and last a small file that names
it complete; a driver that is lost or killed goes on from the last complete generation in a new session, with the same
elites, history and learnt policy. Without a path the state is given back and lives as long as the session.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.functions.texts import genome_hash, phenotype_hash
from cohortlab.operators import genome as G
from cohortlab.operators import reports
from cohortlab.operators.policy import Policy
from cohortlab.operators.sampling import PRIMES, condition, radical_inverse
from cohortlab.workspace import drop, materialize, read_text, write_text

c = F.col
ROLES = ("global_best", "coverage", "alignment", "consistency", "diversity", "axis_target", "schema")


@dataclass(frozen=True)
class Config:
    islands: int = 4
    children: int = 2
    generations: int = 3
    seed: int = 7
    base_scale: float = 0.2
    extinction_every: int = 5
    extinction_seconds: float | None = None
    plateau: int = 4
    learn: bool = True
    widen: bool = False
    repeats: int = 1
    workers: int = 4
    family: str = "free"

    #: Settings that don't change results and may differ on resume.
    LOOSE = ("workers", "generations")

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps({k: v for k, v in sorted(asdict(self).items()) if k not in self.LOOSE}).encode()).hexdigest()


Evaluator = Callable[[DataFrame], DataFrame]


def unevaluated(children: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits children by what is known: (first of each new phenotype, all children with their phenotype hash).

    A phenotype is a genome without its lineage keys; ``cache`` has ``phenotype`` and its metrics.
    """
    h = children.withColumn("phenotype", phenotype_hash("child")).withColumn("code", genome_hash("child"))
    w = Window.partitionBy("phenotype").orderBy("generation", "island_id", "child_idx")
    new = h.join(cache.select("phenotype"), "phenotype", "left_anti").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return new, h


def merge_elites(elites: DataFrame, results: DataFrame) -> DataFrame:
    """Per island and metric the better of the elite and the new results; the elite wins ties, then the earlier child."""
    new = results.select("island_id", F.explode("metrics").alias("metric", "value"), "candidate_id", "child", "generation", "child_idx")
    old = elites.select("island_id", "metric", "value", "candidate_id", "child", F.lit(-1).alias("generation"), F.lit(-1).alias("child_idx"))
    best = F.min(F.struct((-c("value")).alias("v"), "generation", "child_idx", "candidate_id", "child"))
    return old.unionByName(new).where(c("value").isNotNull() & ~F.isnan("value")).groupBy("island_id", "metric").agg(best.alias("b")).select("island_id", "metric", (-c("b.v")).alias("value"), c("b.candidate_id").alias("candidate_id"), c("b.child").alias("child"))


def choose_parents(elites: DataFrame, plan: DataFrame, stagnation: int, plateau: int) -> DataFrame:
    """Gives each planned child its parent: on a plateau a role in turn by hash, every second child the operator's

    preferred metric, else the global best of its island. ``plan`` has island_id, child_idx, generation, preferred_metric.
    """
    turn = F.element_at(F.array(*map(F.lit, ROLES)), (F.pmod(F.xxhash64("generation", "island_id", "child_idx"), F.lit(len(ROLES))) + 1).cast("int"))
    want = turn if stagnation >= plateau else F.when(c("child_idx") % 2 == 1, c("preferred_metric")).otherwise("global_best")
    p = plan.withColumn("metric", want)
    exact = p.join(elites.select("island_id", "metric", c("child").alias("genome"), c("candidate_id").alias("parent_id")), ["island_id", "metric"], "left")
    fallback = elites.where(c("metric") == "global_best").select("island_id", c("child").alias("g0"), c("candidate_id").alias("p0"))
    return exact.join(fallback, "island_id").withColumn("genome", F.coalesce("genome", "g0")).withColumn("parent_id", F.coalesce("parent_id", "p0")).drop("g0", "p0")


def extinct(elites: DataFrame) -> DataFrame:
    """The max(1, (n - 1) // 2) worst islands, never the best, take over the best island's elites where those are better."""
    score = elites.where(c("metric") == "global_best")
    n = score.count()
    if n < 2:
        return elites
    w = Window.orderBy("value", F.desc("island_id"))
    ranked = score.withColumn("r", F.row_number().over(w)).select("island_id", "r")
    best = elites.join(ranked.where(c("r") == n).select("island_id"), "island_id").select("metric", c("value").alias("bv"), c("candidate_id").alias("bc"), c("child").alias("bg"))
    j = elites.join(ranked, "island_id").join(best, "metric", "left")
    take = (c("r") <= max(1, (n - 1) // 2)) & (c("bv") > c("value"))
    return j.select("island_id", "metric", F.when(take, c("bv")).otherwise(c("value")).alias("value"), F.when(take, c("bc")).otherwise(c("candidate_id")).alias("candidate_id"), F.when(take, c("bg")).otherwise(c("child")).alias("child"))


def plan(spark: SparkSession, config: Config, generation: int, operators: DataFrame, stagnation: int, policy: Policy | None = None) -> DataFrame:
    """One job per island and child: mode, scale and operator, which the policy chooses, or else comes in turn."""
    ops = G.family(operators, config.family)
    w = Window.orderBy("operator_id")
    ranked = ops.withColumn("k", F.row_number().over(w) - 1)
    jobs = spark.range(config.islands * config.children).select((c("id") % config.islands).cast("int").alias("island_id"), F.floor(c("id") / config.islands).cast("int").alias("child_idx"), F.lit(generation).alias("generation"))
    if policy is None:
        jobs = jobs.withColumn("k", F.pmod(F.lit(generation * 7) + c("island_id") * 3 + c("child_idx"), F.lit(ranked.count())).cast("int"))
        jobs = jobs.join(F.broadcast(ranked), "k").drop("k")  # 27 operators
    else:
        chosen = [(i, k, policy.choose(generation, i, k)) for i in range(config.islands) for k in range(config.children)]
        jobs = jobs.join(F.broadcast(spark.createDataFrame(chosen, "island_id int, child_idx int, operator_id string")), ["island_id", "child_idx"]).join(F.broadcast(ranked.drop("k")), "operator_id")  # one row per child
    table = F.create_map(*[F.lit(x) for kv in G.MODE_SCALE.items() for x in kv])
    jobs = jobs.withColumn("mode", G.mode_of(c("child_idx")))
    return jobs.withColumn("scale", G.mutation_scale(config.base_scale, F.lit(stagnation), F.lit(generation)) * F.element_at(table, c("mode")))


RESULT = "island_id int, child_idx int, generation int, child string, parent_id string, operator_id string, phenotype string, code string, metrics map<string,double>, candidate_id string, cache_hit boolean"
CACHE = "phenotype string, metrics map<string,double>"
ELITES = "island_id int, metric string, value double, candidate_id string, child string"


def run(spark: SparkSession, config: Config, first: list[str], evaluate: Evaluator, resume: dict | None = None, path: str | None = None) -> dict:
    """Search from seed genomes (one per island, in turn). Returns elites, history, results and the state to resume from.

    ``evaluate`` gives ``phenotype, metrics`` for rows of ``phenotype, child, repeat``; failures are rows with zero
    metrics. What would become an elite is evaluated ``config.repeats`` times before it does. ``path`` holds the search
    (any folder that all executors share); if it already has complete generations, the search goes on from them.
    """
    ops = G.catalogue(spark)
    if path and resume is None:
        resume = load(spark, path)
    if resume:
        if resume["fingerprint"] != config.fingerprint():
            raise ValueError("the configuration differs from that of the run to resume")
        elites, results, cache, history, start = (resume[k] for k in ("elites", "results", "cache", "history", "generation"))
        history, spread = [tuple(h) for h in history], resume["spread"]
        policy = Policy.restore(resume["policy"]) if resume["policy"] else None
    else:
        names = [r[0] for r in G.family(ops, config.family).select("operator_id").orderBy("operator_id").collect()]
        policy = Policy(names, widen=config.widen, plateau=config.plateau) if config.learn else None
        seeds = spark.createDataFrame([(i, 0, 0, first[i % len(first)], None, None) for i in range(config.islands)], "island_id int, child_idx int, generation int, child string, parent_id string, operator_id string")
        results, cache, elites = (spark.createDataFrame([], k) for k in (RESULT, CACHE, ELITES))
        new, fresh, elites = _evaluate(seeds, cache, elites, evaluate, config.repeats)
        history, start, spread = [(0, _best(elites))], 1, [0, time.time()]
        results, cache, elites = _keep(spark, path, 0, config, results, cache, new, fresh, elites, history, policy, spread)
    for g in range(start, config.generations + 1):
        stagnation = _stagnation(history)
        jobs = choose_parents(elites, plan(spark, config, g, ops, stagnation, policy), stagnation, config.plateau)
        children = G.mutate(jobs.select("island_id", "child_idx", "generation", "mode", "scale", "operator_id", "family", "axis", "stretch", "bias", "module", "genome", "parent_id"), config.seed)
        new, fresh, elites = _evaluate(children.select("island_id", "child_idx", "generation", "child", "parent_id", "operator_id"), cache, elites, evaluate, config.repeats)
        if extinction_due(config, g, spread[0], time.time() - spread[1]):
            elites, spread = materialize(extinct(elites), "elites"), [g, time.time()]
        history.append((g, _best(elites)))
        if policy:
            _learn(policy, g, new, results, history)
        results, cache, elites = _keep(spark, path, g, config, results, cache, new, fresh, elites, history, policy, spread)
    state = {"fingerprint": config.fingerprint(), "elites": elites, "results": results, "cache": cache, "history": history, "generation": max(start, config.generations + 1), "policy": policy.state() if policy else None, "spread": spread}
    return {"elites": elites, "results": results, "history": spark.createDataFrame(history, "generation int, best double"), "state": state, "policy": policy}


def extinction_due(config: Config, generation: int, last: int, seconds: float) -> bool:
    """Every so many generations, or after so many seconds, but never in the generation right after one."""
    due = generation % config.extinction_every == 0 or config.extinction_seconds is not None and seconds >= config.extinction_seconds
    return due and (last == 0 or generation - last > 1)


def _best(elites: DataFrame) -> float | None:
    return elites.where("metric = 'global_best'").agg(F.max("value")).first()[0]


def _evaluate(children: DataFrame, cache: DataFrame, elites: DataFrame, evaluate: Evaluator, repeats: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The children with their metrics, the metrics of new phenotypes, and the elites after them."""
    children = materialize(children, "children")
    new, hashed = unevaluated(children, cache)
    fresh = materialize(evaluate(new.select("phenotype", "child", F.lit(1).alias("repeat"))).select("phenotype", "metrics"), "metrics")

    def judged(metrics: DataFrame) -> DataFrame:
        known = cache.withColumn("cache_hit", F.lit(True)).unionByName(metrics.withColumn("cache_hit", F.lit(False)))
        return hashed.join(known, "phenotype").withColumn("candidate_id", F.substring("code", 1, 12)).select(*[x.split()[0] for x in RESULT.split(", ")])

    if repeats > 1:
        out = materialize(judged(fresh), "first")
        doubtful = confirm(out.where("not cache_hit"), merge_elites(elites, out), out.select("candidate_id").distinct(), repeats)
        again = doubtful.select(phenotype_hash("child").alias("phenotype"), "child", F.explode(F.sequence(F.lit(2), c("missing") + 1)).alias("repeat")).dropDuplicates(["phenotype", "repeat"])
        more = evaluate(again).select("phenotype", "metrics").unionByName(fresh.join(again.select("phenotype").distinct(), "phenotype", "left_semi"))
        mean = more.select("phenotype", F.explode("metrics").alias("k", "v")).groupBy("phenotype", "k").agg(F.avg("v").alias("v")).groupBy("phenotype").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metrics"))
        fresh = materialize(fresh.join(mean.select("phenotype"), "phenotype", "left_anti").unionByName(mean), "confirmed")
    out = materialize(judged(fresh), "evaluated")
    return out, fresh, materialize(merge_elites(elites, out), "elites")


def _learn(policy: Policy, generation: int, new: DataFrame, before: DataFrame, history: list) -> None:
    """Rewards of a generation's children over their parents go to the policy: one row per child."""
    parents = before.select(c("candidate_id").alias("parent_id"), c("metrics").alias("old")).dropDuplicates(["parent_id"])
    j = new.join(parents, "parent_id", "left")
    old, now = (lambda m: F.element_at("old", F.lit(m))), (lambda m: F.element_at("metrics", F.lit(m)))
    better = F.filter(F.map_keys("metrics"), lambda k: F.element_at("metrics", k) > F.coalesce(F.element_at("old", k), F.lit(0.0)))
    rows = j.select("island_id", "child_idx", reports.reward(old, now, F.when(F.size(better) > 0, better)).alias("reward"), (F.size(better) > 0).alias("improved"), now("global_best").alias("best")).orderBy("island_id", "child_idx").collect()
    so_far = max((b for _, b in history[:-1] if b is not None), default=float("-inf"))
    for r in rows:
        policy.record(generation, r["island_id"], r["child_idx"], r["reward"] or 0.0, bool(r["improved"]), r["best"] is not None and r["best"] > so_far)


def _keep(spark, path, g, config, results, cache, new, fresh, elites, history, policy, spread) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, metrics and elites up to a generation; durable if there is a path."""
    if not path:
        return results.unionByName(new), cache.unionByName(fresh), elites
    at = f"{path}/generation={g:05d}"
    for name, df in (("results", new), ("cache", fresh), ("elites", elites)):
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    state = {"fingerprint": config.fingerprint(), "history": history, "policy": policy.state() if policy else None, "spread": spread}
    write_text(spark, f"{at}/complete.json", json.dumps(state))
    for df in (new, fresh, elites):
        drop(df)
    kept = load(spark, path)
    return kept["results"], kept["cache"], kept["elites"]


def load(spark: SparkSession, path: str) -> dict | None:
    """The state of a search after its last complete generation, or None."""
    g, last = 0, None
    while (text := read_text(spark, f"{path}/generation={g:05d}/complete.json")) is not None:
        last, g = json.loads(text), g + 1
    if last is None:
        return None
    read = lambda name, kind: spark.read.schema(kind).parquet(*[f"{path}/generation={k:05d}/{name}" for k in range(g)])
    elites = spark.read.schema(ELITES).parquet(f"{path}/generation={g - 1:05d}/elites")
    return last | {"elites": elites, "results": read("results", RESULT), "cache": read("cache", CACHE), "generation": g}


def backfill(spark: SparkSession, path: str) -> DataFrame:
    """``generation, n, cached, best, mean``: the statistics of every generation, from the results kept in ``path``."""
    m = F.element_at("metrics", F.lit("global_best"))
    return load(spark, path)["results"].groupBy("generation").agg(F.count("*").cast("bigint").alias("n"), F.count_if("cache_hit").cast("bigint").alias("cached"), F.max(m).alias("best"), F.avg(m).alias("mean"))


def study(spark: SparkSession, config: Config, first: list[str], evaluate: Evaluator, sealed_evaluate: Evaluator, path: str) -> dict:
    """Search, then the sealed evaluation of its elites, then summaries and a manifest in ``path``; each step can be resumed."""
    done = run(spark, config, first, evaluate, path=path)
    test = sealed(done["elites"], sealed_evaluate)
    test.write.mode("overwrite").parquet(f"{path}/sealed")
    backfill(spark, path).write.mode("overwrite").parquet(f"{path}/summary")
    best = done["elites"].where("metric = 'global_best'").orderBy(F.desc("value"), "island_id").first()
    manifest = {"created_at": datetime.now(UTC).isoformat(timespec="seconds"), "config": asdict(config), "fingerprint": config.fingerprint(), "generations": config.generations, "best": {"candidate_id": best["candidate_id"], "value": best["value"], "island_id": best["island_id"]} if best else None, "tables": ["sealed", "summary", "generation=*/results", "generation=*/elites", "generation=*/cache"]}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return done | {"sealed": spark.read.parquet(f"{path}/sealed"), "summary": spark.read.parquet(f"{path}/summary"), "manifest": manifest}


def config_of(spark: SparkSession, path: str) -> Config:
    """The configuration that a manifest holds."""
    text = read_text(spark, f"{path}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"no manifest in {path}")
    return Config(**json.loads(text)["config"])


def _stagnation(history: list[tuple[int, float]]) -> int:
    best = max(history, key=lambda x: (x[1], -x[0]))
    return history[-1][0] - best[0]


def sealed(elites: DataFrame, evaluate: Evaluator) -> DataFrame:
    """Evaluates the distinct elites once on a sealed evaluator and ties the figures to their roles."""
    once = elites.select("candidate_id", "child").dropDuplicates(["candidate_id"]).withColumn("phenotype", phenotype_hash("child"))
    m = evaluate(once.select("phenotype", "child").dropDuplicates(["phenotype"]))
    return elites.select("island_id", "metric", "candidate_id").join(once.select("candidate_id", "phenotype"), "candidate_id").join(m, "phenotype").drop("phenotype")


def confirm(results: DataFrame, elites: DataFrame, repeats: DataFrame, required: int) -> DataFrame:
    """Candidates that are or would be elites and have fewer than ``required`` repeats, with what is missing."""
    some = results.join(elites.select("candidate_id").distinct(), "candidate_id", "left_semi").select("candidate_id", "child").distinct()
    n = repeats.groupBy("candidate_id").agg(F.count("*").alias("n"))
    return some.join(n, "candidate_id", "left").withColumn("missing", (F.lit(required) - F.coalesce("n", F.lit(0))).cast("int")).where("missing > 0").drop("n")


def rotate(order: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """The objective of a row by its number from 0."""
    return F.element_at(F.array(*map(F.lit, roles)), (F.pmod(order, F.lit(len(roles))) + 1).cast("int"))


def conditioned_evaluator(spark: SparkSession, n: int = 64) -> Evaluator:
    """A deterministic evaluator: points of a genome's conditioned slots, their cover of a 3-step grid, spread and balance."""
    def evaluate(rows: DataFrame) -> DataFrame:
        maps = rows.select("phenotype", F.from_json("child", "axis_bias map<string,double>, axis_stretch map<string,double>").alias("g"))
        at = maps.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
        at = at.withColumns({f"x{i}": radical_inverse(c("i"), PRIMES[i], 12) for i in range(3)})
        for i, a in enumerate(G.AXES):
            at = at.withColumn(a, condition(c(f"x{i}"), F.coalesce(F.element_at("g.axis_stretch", F.lit(a)), F.lit(1.0)), F.coalesce(F.element_at("g.axis_bias", F.lit(a)), F.lit(0.0))))
        cellno = sum((F.least(F.floor(c(a) * 3), F.lit(2)) * 3**i for i, a in enumerate(G.AXES)), F.lit(0))
        m = at.groupBy("phenotype").agg((F.count_distinct(cellno) / 27.0).alias("coverage"), *[F.stddev_pop(a).alias(f"s_{a}") for a in G.AXES], *[F.avg(F.abs(c(a) - c(f"x{i}"))).alias(f"d_{a}") for i, a in enumerate(G.AXES)])
        spread = (c("s_cognitive_core") + c("s_motivation_core") + c("s_regulation_core")) / 3 / 0.5
        off = (c("d_cognitive_core") + c("d_motivation_core") + c("d_regulation_core")) / 3
        best = (0.5 + 0.5 * c("coverage")) * (1.0 - off) * spread
        return m.select("phenotype", F.create_map(F.lit("global_best"), best, F.lit("coverage"), c("coverage"), F.lit("diversity"), spread, F.lit("axis_target"), 1.0 - off, F.lit("schema"), F.lit(1.0)).alias("metrics"))

    return evaluate
