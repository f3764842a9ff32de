"""Running values over groups of any size.

A plain window gathers a group in one task. Here rows are range-partitioned by (group, order), windows run inside the
partitions, and what came before a partition is added from one small row per (partition, group). A group that holds a
third of all rows is thus spread over a third of the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.scalars import clip
from cohortlab.workspace import materialize

c = F.col


def _spread(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return materialize(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "spread")


def _before(parts: DataFrame, by: list[str], sums: dict) -> DataFrame:
    """Per (partition, group) what the partitions before it hold, by (aggregate, combine) pairs."""
    one = parts.groupBy("_p", *by).agg(*[a.alias(n) for n, (a, _) in sums.items()])
    w = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return one.select("_p", *by, *[f(c(n)).over(w).alias(f"_b_{n}") for n, (_, f) in sums.items()])


def _join(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    keys = ["_p", *by]
    on = [a[k].eqNullSafe(b[k]) for k in keys]
    out = a.join(b, on, "left")
    for k in keys:
        out = out.drop(b[k])
    return out


def _merged(a: Column, b: Column) -> Column:
    """(n, mean, m2) of two sets of rows together."""
    n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
    part = F.try_divide(b["n"], n)
    return F.struct(n.alias("n"), (a["mean"] + F.coalesce(gap * part, F.lit(0.0))).alias("mean"), (a["m2"] + b["m2"] + F.coalesce(gap * gap * a["n"] * part, F.lit(0.0))).alias("m2"))


def running(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``run_n, run_mean, run_std`` (sample, 0 for one row) up to and with each row; ``value`` must not be null.

    Counts, means and squared deviations are merged, so values far from zero lose no digits.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    state = lambda f: F.struct(f(F.count("*")).cast("double").alias("n"), f(F.avg(value)).alias("mean"), (f(F.var_pop(value)) * f(F.count("*"))).alias("m2"))
    parts = _spread(df, by, order)
    one = parts.groupBy("_p", *by).agg(state(lambda x: x).alias("_own"))
    w = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = one.select("_p", *by, F.aggregate(F.collect_list("_own").over(w), zero, _merged).alias("_before"))  # one entry per partition
    w = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = _join(parts.withColumn("_own", state(lambda x: x.over(w))), before, by)
    all_ = j.withColumn("_all", _merged(F.coalesce("_before", zero), c("_own")))
    std = F.when(c("_all.n") > 1, F.sqrt(c("_all.m2") / (c("_all.n") - 1))).otherwise(0.0)
    return all_.withColumns({"run_n": c("_all.n").cast("bigint"), "run_mean": c("_all.mean"), "run_std": std}).drop("_p", "_own", "_before", "_all")


def z_scores(df: DataFrame, by: list[str], order: list[str], value: str, floor: float = 0.02, limit: float = 3.0) -> DataFrame:
    """Adds ``z``: each value against the running mean and deviation, the row included, clipped."""
    return running(df, by, order, value).withColumn("z", clip((c(value) - c("run_mean")) / F.greatest(c("run_std"), F.lit(floor)), -limit, limit))


def bests(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``run_n``, ``best_before``, ``new_best`` and ``stale``, the rows since the value last beat all before it."""
    parts = _spread(df, by, order)
    w = Window.partitionBy("_p", *by).orderBy(*order)
    upto, prior = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    before = _before(parts, by, {"n": (F.count("*"), F.sum), "m": (F.max(value), F.max)})
    j = _join(parts.withColumns({"_n": F.count("*").over(upto), "_m": F.max(value).over(prior)}), before, by)
    j = j.withColumns({"run_n": c("_n") + F.coalesce("_b_n", F.lit(0)), "best_before": F.greatest("_m", "_b_m")}).drop("_n", "_m", "_b_n", "_b_m")
    j = materialize(j.withColumn("new_best", F.coalesce(c(value) > c("best_before"), F.lit(True))), "bests")
    hit = F.max(F.when(c("new_best"), c("run_n")))
    last = _before(j, by, {"k": (hit, F.max)})
    out = _join(j.withColumn("_k", hit.over(upto)), last, by)
    return out.withColumn("stale", (c("run_n") - F.greatest("_k", "_b_k")).cast("bigint")).drop("_p", "_k", "_b_k")


def best_before(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Adds ``b_<value>``, the largest value of the rows before each row of its group, or null; ``by`` may be empty."""
    parts = _spread(df, by, order)
    w = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = _before(parts, by, {v: (F.max(v), F.max) for v in values})
    j = _join(parts.withColumns({f"_m_{v}": F.max(v).over(w) for v in values}), before, by)
    return j.withColumns({f"b_{v}": F.greatest(f"_m_{v}", f"_b_{v}") for v in values}).drop("_p", *[f"{x}_{v}" for v in values for x in ("_m", "_b")])
