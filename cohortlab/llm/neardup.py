"""Groups of texts that share most of their words: signature trees in blocks of equal MinHash bands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import setjoin, sigtree
from cohortlab.workspace import drop, materialize

#: Bands and rows. A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 22 = 0.00016, one of 0.85
#: with 0.000006; verification is exact, so these are the only misses.
BANDS, ROWS = 22, 5


def band_keyer(flat: np.ndarray, offsets: np.ndarray, sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the MinHash bands of each set."""
    keys = sigtree.band_keys(sigtree.minhash(sets, bounds, BANDS * ROWS), ROWS)
    return keys.reshape(-1), np.arange(len(keys) + 1) * BANDS


def near_pairs(rows: DataFrame, t: float = 0.8, min_words: int = 12, copies: int | None = setjoin.COPIES) -> DataFrame:
    """Pairs of ids of one space with similarity >= ``t``; ``rows``, ``copies`` and result as in :func:`setjoin.similar`, without sides."""
    return setjoin.similar(rows.withColumn("side", F.lit(0)), t, band_keyer, min_words=min_words, copies=copies)


def near_profiles(rows: DataFrame, t: float = 0.8, min_words: int = 12) -> tuple[DataFrame, DataFrame]:
    """:func:`near_pairs` as profiles and their pairs, from which pairs of ids can be counted; see :func:`setjoin.profiles`."""
    return setjoin.profiles(rows.withColumn("side", F.lit(0)), t, band_keyer, min_words=min_words)


def groups(pairs: DataFrame) -> DataFrame:
    """``space, id, class_id, links``: connected groups of the pairs; the smallest id names a group.

    Labels move to the smallest neighbour and then on to that neighbour's label, so rounds grow with the logarithm of a
    chain. Each round is an aggregation and a join of all linked ids; ids without links have no row.
    """
    both = pairs.select("space", F.col("id_a").alias("x"), F.col("id_b").alias("y")).unionByName(pairs.select("space", F.col("id_b").alias("x"), F.col("id_a").alias("y"))).distinct()
    edges = materialize(both, "edges")
    labels = edges.groupBy("space", "x").agg(F.least(F.col("x"), F.min("y")).alias("c"))
    before, old = None, []
    while True:
        labels = materialize(labels.select("space", "x", "c"), "labels")
        for x in old:
            drop(x)
        state = labels.agg(F.sum(F.xxhash64("space", "x", "c").cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
        before = state
        seen = edges.join(labels.select("space", F.col("x").alias("y"), F.col("c").alias("cy")), ["space", "y"]).groupBy("space", "x").agg(F.min("cy").alias("low"))
        step = labels.join(seen, ["space", "x"]).select("space", "x", F.least("c", "low").alias("c"))
        step, old = materialize(step, "step"), [labels]
        old.append(step)
        labels = step.join(step.select("space", F.col("x").alias("c"), F.col("c").alias("cc")), ["space", "c"], "left").select("space", "x", F.least("c", "cc").alias("c"))
    degree = edges.groupBy("space", "x").agg(F.count("*").alias("links"))
    return labels.join(degree, ["space", "x"]).select("space", F.col("x").alias("id"), F.col("c").alias("class_id"), "links")


def linked(rows: DataFrame, t: float = 0.8, min_words: int = 12) -> DataFrame:
    """``space, id, class_id, links`` of all ids with a near copy; ``links`` counts every similar id, whatever the copies."""
    ids, similar = near_profiles(rows, t, min_words)
    size = materialize(ids.groupBy("space", "profile").agg(F.count("*").alias("n"), F.min("id").alias("first")), "sizes")
    of = lambda x, *more: size.select(F.col("profile").alias(x), F.col("n").alias(f"n{x}"), F.col("first").alias(f"f{x}"), *more)
    pairs = materialize(similar.where("p <> q").join(of("p", "space"), "p").join(of("q"), "q"), "links")
    # The first id of a profile stands for all its ids.
    classes = groups(pairs.select("space", F.col("fp").alias("id_a"), F.col("fq").alias("id_b"))).select("space", F.col("id").alias("first"), "class_id")
    others = pairs.select(F.col("p").alias("profile"), F.col("nq").alias("n")).unionByName(pairs.select(F.col("q").alias("profile"), F.col("np").alias("n"))).groupBy("profile").agg(F.sum("n").alias("others"))
    each = size.join(classes, ["space", "first"], "left").join(others, "profile", "left")
    each = each.select("space", "profile", F.coalesce("class_id", "first").alias("class_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("bigint").alias("links"))
    return ids.join(each, ["space", "profile"]).select("space", "id", "class_id", "links")
