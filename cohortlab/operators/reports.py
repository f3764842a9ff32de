"""Report operators over candidates: roll-ups, running bests, stagnation, role selection, archives and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.scalars import clip

c = F.col


def rollup(df: DataFrame, by: list[str], metrics: list[str], sample: bool = False) -> DataFrame:
    """Long table ``by..., metric, n, mean, std, sem``: deviation of the population, or of the sample (0 for one value).

    Missing and NaN values are skipped; a metric without any value has no row.
    """
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c(m).cast("double").alias("v")) for m in metrics])).alias("e")).select(*by, "e.metric", "e.v").where(c("v").isNotNull() & ~F.isnan("v"))
    return summary(long, [*by, "metric"], "v", sample)


def summary(long: DataFrame, by: list[str], value: str, sample: bool = True) -> DataFrame:
    """``by..., n, mean, std, sem`` of one value column."""
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0)) if sample else F.stddev_pop(value)
    out = long.groupBy(*by).agg(F.count(value).cast("bigint").alias("n"), F.avg(value).alias("mean"), std.alias("std"))
    return out.withColumn("sem", F.when(c("n") > 0, c("std") / F.sqrt(c("n").cast("double"))).otherwise(0.0))


def finite(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is a finite number."""
    v = c(value)
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def metric_rows(df: DataFrame, by: list[str], metrics: str = "metrics") -> DataFrame:
    """``by..., metric, value``: one row per finite entry of a metric map."""
    return finite(df.select(*by, F.explode(metrics).alias("metric", "value")), "value")


def noise_floor(long: DataFrame, run: str, by: list[str], value: str) -> DataFrame:
    """Per metric that is present in every run of its group: n, mean, sample deviation, min, max, range, two deviations."""
    total = long.groupBy(*by).agg(F.count_distinct(run).alias("runs"))
    a = long.groupBy(*by, "metric").agg(F.count_distinct(run).alias("have"), F.count("*").cast("bigint").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    return a.join(total, by).where("have = runs").select(*by, "metric", "n", "mean", "std", "low", "high", (c("high") - c("low")).alias("range"), (2 * c("std")).alias("two_sigma"))


def bootstrap(df: DataFrame, by: list[str], value: str, draws: int = 1000, seed: int = 12345) -> DataFrame:
    """``by..., n, mean, low, high``: a 95 % interval of the mean from a Poisson bootstrap.

    Every row takes part in each draw with a Poisson weight that a hash of (row, draw) decides, so the draws are partial
    sums that combine map-side; no group is gathered anywhere. One row: the interval is its value.
    """
    rows = df.where(c(value).isNotNull()).withColumn("_h", F.xxhash64(*by, value, *[x for x in df.columns if x not in (*by, value)]))
    each = rows.select(*by, c(value).alias("_v"), "_h", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_d"))
    u = (F.pmod(F.xxhash64("_h", "_d", F.lit(seed)), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)
    k = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    sums = each.withColumn("_k", k).groupBy(*by, "_d").agg(F.sum(c("_k") * c("_v")).alias("_s"), F.sum("_k").alias("_w"))
    ci = sums.where("_w > 0").groupBy(*by).agg(F.percentile(c("_s") / c("_w"), F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
    base = rows.groupBy(*by).agg(F.count("*").cast("bigint").alias("n"), F.avg(value).alias("mean"))
    one = c("n") == 1
    return base.join(ci, by, "left").select(*by, "n", "mean", F.when(one, c("mean")).otherwise(c("_p")[0]).alias("low"), F.when(one, c("mean")).otherwise(c("_p")[1]).alias("high"))


def generations(df: DataFrame, by: list[str]) -> DataFrame:
    """Per generation: candidates, mean, best and least fitness, the best candidate (smallest id on ties) and best so far.

    The running best runs over the few generations of a group, not over its candidates.
    """
    ok = finite(df, "fitness")
    g = ok.groupBy(*by, "generation").agg(F.count("*").cast("bigint").alias("n"), F.avg("fitness").alias("mean_fitness"), F.max("fitness").alias("best_fitness"), F.min("fitness").alias("min_fitness"), F.min(F.struct((-c("fitness")).alias("f"), c("candidate_id").alias("id"))).alias("b"))
    w = Window.partitionBy(*by).orderBy("generation").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.withColumn("best_id", c("b.id")).withColumn("best_so_far", F.max("best_fitness").over(w)).drop("b")


def first_reach(gens: DataFrame, by: list[str]) -> DataFrame:
    """First generation at which the running best is the final best (within 1e-12), and generations since then."""
    last = gens.groupBy(*by).agg(F.max("best_so_far").alias("final"), F.max("generation").alias("last"))
    return gens.join(last, by).where(F.abs(c("best_so_far") - c("final")) < 1e-12).groupBy(*by, "final", "last").agg(F.min("generation").alias("first")).withColumn("stagnation", c("last") - c("first"))


def groups_report(df: DataFrame, by: list[str], value: str = "fitness", means: tuple[str, ...] = ()) -> DataFrame:
    """Per group: rows, rows with a value, mean, population deviation, best and least; the mean skips missing values.

    ``means`` names further columns of which ``mean_<name>`` is given. A null group is a group.
    """
    v = F.when(~F.isnan(value), c(value))
    return df.groupBy(*by).agg(F.count("*").cast("bigint").alias("n"), F.count(v).cast("bigint").alias("n_scored"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(v).alias("best"), F.min(v).alias("least"), *[F.avg(m).alias(f"mean_{m}") for m in means])


def elites(long: DataFrame, by: list[str]) -> DataFrame:
    """Per group and metric the row of highest value; the earlier (``seq``) wins ties. ``long`` has metric, value, seq, id."""
    best = F.min(F.struct((-c("value")).alias("v"), c("seq").alias("s"), c("id").alias("id")))
    return finite(long, "value").groupBy(*by, "metric").agg(best.alias("b")).select(*by, "metric", c("b.id").alias("id"), (-c("b.v")).alias("value"))


def roles(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``role, metric, candidate_id, value, fitness``: the best row per role, ties by fitness, then earliest generation.

    ``wanted`` maps a role to (metric, ``max`` or ``min``). A metric that is missing or exactly 0 loses against any other.
    All roles are found in one aggregation, as minima of sort keys.
    """
    keys = []
    for role, (metric, way) in wanted.items():
        v = F.nullif(F.element_at("metrics", F.lit(metric)), F.lit(0.0)) if metric != "fitness" else F.nullif(c("fitness"), F.lit(0.0))
        rank = F.coalesce(v if way == "min" else -v, F.lit(float("inf")))
        keys.append(F.min(F.struct(rank.alias("r"), (-c("fitness")).alias("f"), c("generation").alias("g"), c("candidate_id").alias("id"))).alias(role))
    row = finite(df, "fitness").agg(*keys)
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(m).alias("metric"), F.lit(w).alias("way"), c(r).alias("k")) for r, (m, w) in wanted.items()])).alias("e")).where("e.k is not null").select("e.role", "e.metric", c("e.k.id").alias("candidate_id"), F.when(c("e.k.r") == float("inf"), None).when(c("e.way") == "min", c("e.k.r")).otherwise(-c("e.k.r")).alias("value"), (-c("e.k.f")).alias("fitness"))


def occupancy(cells: DataFrame, by: list[str], total: int) -> DataFrame:
    """Distinct cells, their share of all, footprint minimum, upper median and maximum. ``cells`` has by..., owner, cell."""
    distinct = cells.select(*by, "cell").distinct().groupBy(*by).agg(F.count("*").cast("bigint").alias("n_cells"))
    foot = cells.select(*by, "owner", "cell").distinct().groupBy(*by, "owner").agg(F.count("*").cast("bigint").alias("k"))
    ranks = foot.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("k", "owner"))).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    f = ranks.groupBy(*by).agg(F.min("k").alias("foot_min"), F.max(F.when(c("r") == F.floor(c("n") / 2) + 1, c("k"))).alias("foot_median"), F.max("k").alias("foot_max"))
    return distinct.join(f, by).withColumn("share", c("n_cells") / float(total))


def cumulative_cells(cells: DataFrame, by: list[str], step: str) -> DataFrame:
    """Distinct cells seen up to each step: a cell counts at its first step, then the counts run."""
    first = cells.groupBy(*by, "cell").agg(F.min(step).alias(step)).groupBy(*by, step).agg(F.count("*").alias("new_cells"))
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.select(*by, step, c("new_cells").cast("bigint").alias("new_cells"), F.sum("new_cells").over(w).cast("bigint").alias("cells_so_far"))


def projections(cells: DataFrame, axes: list[str]) -> DataFrame:
    """Occupied cells of every pair of axes, whatever the third: one aggregation with grouping sets."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1 :]]
    each = cells.select(*axes).distinct()
    out = each.groupingSets([[c(a), c(b)] for a, b in pairs], *[c(a) for a in axes]).agg(F.count("*").cast("bigint").alias("n_cells"))
    return out


#: Ranges of a radar; the last two are losses, of which 0 is best and the value given worst.
RADAR = {"coverage": (0.0, 1.0), "convex_hull": (0.0, 0.5), "avg_dist": (0.0, 1.0), "min_dist": (0.0, 0.5)}
LOSSES = {"dispersion": 2.0, "kl_divergence": 3.0}


def radar(metric: Column, value: Column) -> Column:
    """A metric's place in its fixed range, clipped to 0..1; 0..1 is the range of all others."""
    out = None
    for name, (low, high) in RADAR.items():
        here = (value - low) / (high - low)
        out = F.when(metric == name, here) if out is None else out.when(metric == name, here)
    for name, worst in LOSSES.items():
        out = out.when(metric == name, 1.0 - F.abs(value) / worst)
    return clip(out.otherwise(value))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``key, a, b, delta`` of what both sides have as a finite number."""
    one, two = finite(a, value).select(key, c(value).alias("a")), finite(b, value).select(key, c(value).alias("b"))
    return one.join(two, key).withColumn("delta", c("b") - c("a"))


def improved(child: Column, parent: Column) -> Column:
    return F.coalesce(child - parent, F.lit(0.0))


# Weights of the metric changes in the plain reward, penalties for losses, and losses beside a gain.
GAIN = {"global_best": 1.0, "coverage": 0.16, "alignment": 0.10, "shadow_mae": 0.14, "consistency": 0.08, "strict_consistency": 0.12, "axis_target": 0.08, "issue_rate": 0.05, "research_score": 0.10, "schema": 0.08, "diversity": 0.14}
LOSS = {"coverage": 0.35, "diversity": 0.35, "alignment": 0.20, "shadow_mae": 0.25, "consistency": 0.20, "strict_consistency": 0.25}
BESIDE = {"strict_consistency": 0.20, "shadow_mae": 0.10}
# Fixed values of the structured reward.
WEIGHTS = {"global_best": 0.30, "shadow_mae": 0.20, "axis_target": 0.15, "strict_consistency": 0.15, "research_score": 0.10, "alignment": 0.05, "consistency": 0.05, "schema": 0.05, "issue_rate": 0.05, "coverage": 0.05, "diversity": 0.05}
GUARDS, TOLERANCE, GUARD_WEIGHT, FLOOR = ("coverage", "diversity"), 0.02, 0.5, 0.02


def reward(parent, child, improved_metrics: Column) -> Column:
    """Plain reward of a child over its parent; ``parent`` and ``child`` map a metric name to a column.

    Weighted changes, penalties for losses, further ones for losing coverage or diversity beside a gain in strictness or
    shadow error, and 0.01 for each improved metric (at least one if the list isn't null).
    """
    d = {m: F.coalesce(child(m), F.lit(0.0)) - F.coalesce(parent(m), F.lit(0.0)) for m in GAIN}
    lost = lambda m: F.greatest(F.lit(0.0), -d[m])
    out = sum((w * d[m] for m, w in list(GAIN.items())[1:]), d["global_best"] * 1.0)
    for m, w in LOSS.items():
        out = out - w * lost(m)
    for m, w in BESIDE.items():
        out = out - F.when(d[m] > 0, w * (lost("coverage") + lost("diversity"))).otherwise(0.0)
    return out + F.when(improved_metrics.isNotNull(), 0.01 * F.greatest(F.lit(1), F.size(improved_metrics))).otherwise(0.0)


def structured_reward(parent, child, improved_metrics: Column, progress: Column, weights=None) -> Column:
    """Reward by relative changes: -1 for a child of no worth; else weighted relative changes plus half the progress

    beyond the best so far, less half of guard losses beyond the tolerance, plus 0.02 per improved metric.
    ``weights`` (metric to column) replaces the fixed ones, for the deficit mode of :func:`deficit_weights`.
    """
    p = {m: F.coalesce(parent(m), F.lit(0.0)) for m in WEIGHTS}
    k = {m: F.coalesce(child(m), F.lit(0.0)) for m in WEIGHTS}
    base = {m: F.greatest(F.abs(p[m]), F.lit(1e-6)) for m in WEIGHTS}
    w = weights or {m: F.lit(v) for m, v in WEIGHTS.items()}
    names = list(WEIGHTS)
    out = sum((w[m] * (k[m] - p[m]) / base[m] for m in names[1:]), w[names[0]] * (k[names[0]] - p[names[0]]) / base[names[0]])
    drop = sum((F.greatest(F.lit(0.0), (p[m] - k[m]) / base[m] - TOLERANCE) for m in GUARDS[1:]), F.greatest(F.lit(0.0), (p[GUARDS[0]] - k[GUARDS[0]]) / base[GUARDS[0]] - TOLERANCE))
    out = out + 0.5 * F.coalesce(progress, F.lit(0.0)) - GUARD_WEIGHT * drop
    out = out + F.when(improved_metrics.isNotNull(), 0.02 * F.greatest(F.lit(1), F.size(improved_metrics))).otherwise(0.0)
    return F.when(k["global_best"] <= 0, -1.0).otherwise(out)


def deficit_weights(parent, best) -> dict[str, Column]:
    """Weights in proportion to how far a parent lags the best so far on each metric, plus a floor; they sum to 1."""
    raw = {m: w * (F.greatest(F.lit(0.0), F.coalesce(best(m), parent(m), F.lit(0.0)) - F.coalesce(parent(m), F.lit(0.0))) + FLOOR) for m, w in WEIGHTS.items()}
    total = sum(list(raw.values())[1:], list(raw.values())[0])
    return {m: v / total for m, v in raw.items()}


def tree_stats(actions: DataFrame, depth: int = 3) -> DataFrame:
    """``node, operator, visits, value_sum, mean``: every prefix of a path gets the reward; ``actions`` has path (array), reward.

    The path's last ``depth`` steps count, as in the policy (:mod:`policy`), and all their prefixes. ``node`` is the prefix before the operator, joined by ``/``.
    """
    p = actions.select(F.slice("path", F.greatest(F.lit(1), F.size("path") - depth + 1), F.lit(depth)).alias("path"), "reward").where(F.size("path") > 0)
    each = p.select(F.posexplode("path").alias("k", "operator"), "path", "reward").select(F.array_join(F.slice("path", 1, c("k")), "/").alias("node"), "operator", "reward")
    return each.groupBy("node", "operator").agg(F.count("*").cast("bigint").alias("visits"), F.sum("reward").alias("value_sum")).withColumn("mean", c("value_sum") / c("visits"))


def uct(stats: DataFrame, exploration: float = 1.4, stagnation: int = 0, plateau: int = 4, widen: bool = False, operators: list[str] | None = None) -> DataFrame:
    """``node, operator, uct``: the operator that each node of :func:`tree_stats` takes next.

    Of ``operators`` the smallest that the node has not tried (``uct`` is then null); else the best by mean + c sqrt(ln(N +
    1) / n), where N counts the visits of the node, also those that end there. On a plateau c grows by a fifth per
    generation up to eight. ``widen`` admits only floor(sqrt N) + 1 operators, the best-known first, then untried ones.
    Ties go to the smaller id.
    """
    names = sorted(operators or [])
    n = Window.partitionBy("node")  # as many rows as there are operators
    factor = exploration * (1.0 + 0.2 * min(stagnation, 8)) if stagnation >= plateau else exploration
    into = stats.select(F.when(c("node") == "", c("operator")).otherwise(F.concat_ws("/", "node", "operator")).alias("node"), c("visits").alias("_into"))
    s = stats.join(into, "node", "left").withColumn("total", F.coalesce("_into", F.sum("visits").over(n)))
    s = s.withColumn("_width", F.floor(F.sqrt(F.greatest(c("total"), F.lit(1)).cast("double"))) + 1 if widen else F.lit(1 << 30))
    s = s.withColumn("_r", F.row_number().over(n.orderBy(F.desc("mean"), F.desc("visits"), "operator")))
    score = F.when(c("_r") <= c("_width"), c("mean") + factor * F.sqrt(F.ln(c("total") + 1.0) / c("visits")))
    best = F.min(F.when(c("_r") <= c("_width"), F.struct((-score).alias("u"), c("operator").alias("o"))))
    g = s.groupBy("node").agg(best.alias("b"), F.count("*").alias("k"), F.max("_width").alias("w"), F.array_min(F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), F.collect_set("operator"))).alias("free"))
    free = c("free").isNotNull() & (c("k") < F.least(c("w"), F.lit(len(names))))
    return g.select("node", F.when(free, c("free")).otherwise(c("b.o")).alias("operator"), F.when(~free, -c("b.u")).alias("uct"))


def fitness_view(m, fitness: Column) -> dict[str, Column]:
    """The eleven elite metrics of an evaluation payload; ``m`` maps a metric name to a column or null."""
    alt = lambda name, other: F.coalesce(m(name), other)
    cov = alt("coverage", F.lit(0.0))
    shadow = 1.0 - alt("shadow_mae", F.greatest(F.lit(0.0), 1.0 - alt("alignment", F.lit(0.0))))
    target = alt("axis_target_mae", F.greatest(F.lit(0.0), 1.0 - alt("axis_alignment", F.lit(0.0))))
    strict = clip(1.0 - alt("strict_consistency", target))
    return {
        "global_best": fitness,
        "research_score": fitness * (0.70 + 0.30 * strict) * (0.70 + 0.30 * clip(shadow)),
        "coverage": cov,
        "alignment": alt("alignment", F.lit(0.0)),
        "shadow_mae": clip(shadow),
        "consistency": alt("consistency", F.lit(0.0)),
        "axis_target": clip(1.0 - target),
        "issue_rate": clip(1.0 - alt("issue_rate", F.lit(1.0))),
        "strict_consistency": strict,
        "diversity": F.coalesce(m("balanced_diversity"), m("avg_dist"), cov),
        "schema": alt("validity", F.lit(0.0)),
    }


def gated(schema: Column, consistency: Column, coverage: Column, alignment: Column, rate: Column) -> Column:
    """schema * product of (0.5 + 0.5 clip(x)) over consistency, coverage and alignment * generation rate."""
    gate = lambda x: 0.5 + 0.5 * clip(x)
    return schema * gate(consistency) * gate(coverage) * gate(alignment) * rate
