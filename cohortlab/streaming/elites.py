"""Streams of candidates: elites per island, windowed counts with late rows, and running reward statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def island_elites(stream: DataFrame) -> DataFrame:
    """Best finite fitness per island so far and who has it; state is one row per island."""
    ok = stream.where(c("evaluated") & c("fitness").isNotNull() & ~F.isnan("fitness") & c("island_id").isNotNull())
    return ok.groupBy("island_id").agg(F.min(F.struct((-c("fitness")).alias("f"), c("candidate_id").alias("id"))).alias("b"), F.count("*").alias("n")).select("island_id", c("b.id").alias("candidate_id"), (-c("b.f")).alias("fitness"), "n")


def windowed(stream: DataFrame, time: str, late: str = "3 days", size: str = "1 day") -> DataFrame:
    """Candidates and mean fitness per day and island; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), "island_id").agg(F.count("*").alias("n"), F.avg(F.when(~F.isnan("fitness"), c("fitness"))).alias("mean_fitness")).select(c("w.start").alias("day"), "island_id", "n", "mean_fitness")


def first_deliveries(stream: DataFrame, key: list[str], time: str, late: str = "10 days") -> DataFrame:
    """Repeated deliveries dropped within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def _welford(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
    for f in frames:
        for x in f["reward"].dropna():
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
    state.update((n, mean, m2))
    yield pd.DataFrame({"operator_id": [key[0]], "n": [n], "mean": [mean], "std": [(m2 / (n - 1)) ** 0.5 if n > 1 else 0.0]})


def running_rewards(stream: DataFrame) -> DataFrame:
    """Count, mean and sample deviation of the rewards of each operator, kept as three numbers of state."""
    return stream.groupBy("operator_id").applyInPandasWithState(_welford, "operator_id string, n bigint, mean double, std double", "n bigint, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)
