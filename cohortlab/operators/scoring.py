"""Survey scoring: from answers to item, construct and axis scores, behaviour means and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.scalars import clip, likert

c = F.col


def items(df: DataFrame) -> DataFrame:
    """One row per item: repeated rows count once."""
    return df.where("item_id is not null").groupBy("item_id").agg(F.max_by(F.struct("survey_id", "item_pos", "split", "construct", "text", "direction", "axis_weights", "instrument"), "added_at").alias("r")).select("item_id", "r.*")


def answers(simulations: DataFrame) -> DataFrame:
    """One row per (simulation, item): ``sim_id, persona_id, survey_id, item_id, response``; repeated deliveries count once."""
    last = simulations.groupBy("sim_id").agg(F.max_by(F.struct("persona_id", "survey_id", "responses"), "ingested_at").alias("r")).select("sim_id", "r.*")
    return last.select("sim_id", "persona_id", "survey_id", F.explode("responses").alias("item_id", "response"))


def item_scores(answer_rows: DataFrame, item_rows: DataFrame) -> DataFrame:
    """Answers 1..5 with their item: ``score`` in 0..1. Unknown items and other answers drop out of all means."""
    return answer_rows.join(item_rows.select("item_id", "construct", "direction", "axis_weights"), "item_id").withColumn("score", likert("response", "direction")).where("score is not null")


def construct_scores(scored: DataFrame) -> DataFrame:
    """Plain mean of the item scores of each simulation and construct."""
    return scored.where("construct is not null").groupBy("sim_id", "construct").agg(F.avg("score").alias("score"), F.count("*").cast("bigint").alias("n_items"))


def axis_scores(scored: DataFrame, all_sims: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """``sim_id, axis, score``: weighted mean of the item scores, 0.5 for an axis without a weighted answer.

    The axes are a fixed short list, so each is a conditional sum in one aggregation: no explode, no second shuffle.
    """
    weight = {a: F.element_at("axis_weights", F.lit(a)) for a in axes}
    sums = [F.sum(c("score") * w).alias(f"s_{a}") for a, w in weight.items()] + [F.sum(F.abs(w)).alias(f"w_{a}") for a, w in weight.items()]
    wide = all_sims.select("sim_id").distinct().join(scored.groupBy("sim_id").agg(*sums), "sim_id", "left")
    return wide.select("sim_id", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.try_divide(c(f"s_{a}"), c(f"w_{a}")), F.lit(0.5)).alias("score")) for a in axes])).alias("e")).select("sim_id", "e.axis", "e.score")


def remapped_weights(weights: str | Column, roles: dict[str, str]) -> Column:
    """Axis weights under other axis names; weights that meet under one name add up."""
    m = c(weights) if isinstance(weights, str) else weights
    name = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), k), k)
    keys = F.array_distinct(F.transform(F.map_keys(m), name))
    total = lambda k: F.aggregate(F.filter(F.map_entries(m), lambda e: name(e["key"]) == k), F.lit(0.0), lambda a, e: a + e["value"])
    return F.map_from_arrays(keys, F.transform(keys, total))


def behaviour(sim_axes: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """``persona_id`` and one mean per axis over the persona's simulations; ``sim_axes`` has persona_id, axis, score."""
    return sim_axes.groupBy("persona_id").agg(*[F.avg(F.when(c("axis") == a, c("score"))).alias(a) for a in axes])


def behaviour_report(personas: DataFrame, means: DataFrame, axes: tuple[str, ...], by: list[str]) -> DataFrame:
    """Mean absolute error per axis between personas' axes and their behaviour (0.5 where a persona has none), and alignment.

    ``personas`` has persona_id and the axes; the overall error is the mean of the axis errors.
    """
    m = means.select("persona_id", *[c(a).alias(f"m_{a}") for a in axes])
    j = personas.join(m, "persona_id", "left")
    out = j.groupBy(*by).agg(F.count("*").cast("bigint").alias("n_personas"), *[F.avg(F.abs(c(a) - F.coalesce(c(f"m_{a}"), F.lit(0.5)))).alias(f"mae_{a}") for a in axes])
    mae = sum((c(f"mae_{a}") for a in axes[1:]), c(f"mae_{axes[0]}")) / len(axes)
    return out.withColumn("mae", mae).withColumn("alignment", clip(1.0 - c("mae")))


def quality(answer_rows: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Response quality: expected, present and valid answers, completeness, histogram 1..5, entropy, neutral and extreme rates.

    ``expected`` has one row per (simulation, item) that should be answered, with the columns of ``by``.
    """
    j = expected.join(answer_rows.select("sim_id", "item_id", "response"), ["sim_id", "item_id"], "left")
    ok = c("response").between(1, 5)
    counts = [F.count_if(c("response") == k).cast("bigint").alias(f"n{k}") for k in range(1, 6)]
    out = j.groupBy(*by).agg(F.count("*").cast("bigint").alias("expected"), F.count("response").cast("bigint").alias("present"), F.count_if(ok).cast("bigint").alias("valid"), *counts)
    p = [F.try_divide(c(f"n{k}").cast("double"), c("valid")) for k in range(1, 6)]
    entropy = sum((F.when(x > 0, -x * F.ln(x)).otherwise(0.0) for x in p[1:]), F.when(p[0] > 0, -p[0] * F.ln(p[0])).otherwise(0.0)) / F.ln(F.lit(5.0))
    return out.withColumns({"completeness": F.coalesce(F.try_divide(c("valid").cast("double"), c("expected")), F.lit(0.0)), "entropy": F.when(c("valid") > 0, entropy).otherwise(0.0), "neutral_rate": F.coalesce(p[2], F.lit(0.0)), "extreme_rate": F.coalesce(p[0] + p[4], F.lit(0.0))})


def stability(answer_rows: DataFrame) -> DataFrame:
    """Per pair of simulations of one persona and survey: shared items and mean 1 - |difference| / 4.

    Repeats of a key are joined on (persona, survey, item); a key has few repeats, and each pair comes once.
    """
    r = answer_rows.where(c("response").between(1, 5))
    a, b = (r.select("persona_id", "survey_id", "item_id", c("sim_id").alias(f"sim_{x}"), c("response").alias(f"r_{x}")) for x in "ab")
    return a.join(b, ["persona_id", "survey_id", "item_id"]).where("sim_a < sim_b").groupBy("persona_id", "survey_id", "sim_a", "sim_b").agg(F.count("*").cast("bigint").alias("n_items"), F.avg(1.0 - F.abs(c("r_a") - c("r_b")) / 4.0).alias("stability"))


def correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson correlation, 0 for fewer than two rows or no variance."""
    r = F.corr(x, y)
    return df.where(c(x).isNotNull() & c(y).isNotNull()).groupBy(*by).agg(F.count("*").cast("bigint").alias("n"), F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("r"))


def running(df: DataFrame, by: list[str], order: list[str], value: str, floor: float = 0.02, limit: float = 3.0) -> DataFrame:
    """Running mean, sample deviation (0 for one row) and clipped z-score of each value, the row itself included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("run_mean", F.avg(value).over(w)).withColumn("run_std", F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)))
    return out.withColumn("z", clip((c(value) - c("run_mean")) / F.greatest(c("run_std"), F.lit(floor)), -limit, limit))
