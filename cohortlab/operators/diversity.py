"""Diversity of point populations: pairwise distances, coverage, dispersion, hull volume, divergence from uniform.

All measures take rows ``pop, id, point`` (array of doubles). Sums over pairs never expand the pairs as rows: a
population's points are cut into blocks, and blocks are compared as matrices inside one task each, so the largest unit
of work is a pair of blocks whatever the population's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.scalars import cell, clip

c = F.col
#: Points of a block in the pairwise kernels.
BLOCK = 2048


def _blocks(points: DataFrame, size: int) -> DataFrame:
    """``pop, block, n_blocks, flat``: points packed into blocks of at most ``size``, by a hash of the id."""
    counts = points.groupBy("pop").agg(F.count("*").alias("n"))
    at = points.join(counts, "pop").withColumn("n_blocks", F.ceil(c("n") * 2 / size).cast("int"))
    at = at.withColumn("block", F.pmod(F.xxhash64("id"), c("n_blocks")).cast("int"))
    return at.groupBy("pop", "block", "n_blocks").agg(F.flatten(F.collect_list("point")).alias("flat"), F.max(F.size("point")).alias("dims"))


def _pair_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y, same, dims in zip(*(batch.column(n).to_pylist() for n in ("flat_a", "flat_b", "same", "dims")), strict=True):
            a, b = (np.array(v, np.float64).reshape(-1, dims) for v in (x, y))
            total, count, least = 0.0, 0, np.inf
            for s in range(0, len(a), 512):
                d = np.sqrt(((a[s : s + 512, None] - b[None]) ** 2).sum(2))
                if same:
                    mask = np.arange(s, s + len(d))[:, None] < np.arange(len(b))[None]
                    d = d[mask]
                if d.size:
                    total, count, least = total + float(d.sum()), count + d.size, min(least, float(d.min()))
            out.append((total, count, least if count else None))
        cols = list(zip(*out, strict=True)) if out else ([], [], [])
        yield pa.record_batch([batch.column("pop"), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["pop", "total", "count", "least"])


def pairwise(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """``pop, n_pairs, avg_dist, min_dist`` over all pairs of a population; a single point has no pairs and zeros."""
    blocks = _blocks(points, block)
    kind = points.schema["pop"].dataType.simpleString()
    a = blocks.select("pop", c("block").alias("ba"), c("flat").alias("flat_a"), "dims", F.explode(F.sequence(c("block"), c("n_blocks") - 1)).alias("bb"))
    b = blocks.select("pop", c("block").alias("bb"), c("flat").alias("flat_b"))
    pairs = a.join(b, ["pop", "bb"]).select("pop", "flat_a", "flat_b", (c("ba") == c("bb")).alias("same"), "dims")
    parts = pairs.mapInArrow(_pair_kernel, f"pop {kind}, total double, count bigint, least double")
    return parts.groupBy("pop").agg(F.sum("count").cast("bigint").alias("n_pairs"), F.coalesce(F.try_divide(F.sum("total"), F.sum("count")), F.lit(0.0)).alias("avg_dist"), F.coalesce(F.min("least"), F.lit(0.0)).alias("min_dist"))


def reference_points(dims: int, salt: int, count: int = 1000, seed: int = 20260613) -> np.ndarray:
    """Fixed random points of the unit cube."""
    return np.random.default_rng(seed + dims * 1009 + salt).random((count, dims))


def nearest(points: DataFrame, refs: np.ndarray) -> DataFrame:
    """``pop, ref, dist``: distance of each reference point to the population's nearest point.

    The references (a thousand rows of a fixed size) go to the tasks; every task keeps one minimum per population and
    reference, so the shuffle carries no points.
    """
    kind = points.schema["pop"].dataType.simpleString()

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for f in frames:
            for pop, g in f.groupby("pop", dropna=False):
                z = np.stack(g["point"].to_numpy())
                for s in range(0, len(z), 1024):
                    d = np.sqrt(((refs[:, None] - z[None, s : s + 1024]) ** 2).sum(2)).min(1)
                    best[pop] = np.minimum(best[pop], d) if pop in best else d
        for pop, d in best.items():
            yield pd.DataFrame({"pop": [pop] * len(d), "ref": np.arange(len(d)), "dist": d})

    return points.select("pop", "point").mapInPandas(kernel, f"pop {kind}, ref bigint, dist double").groupBy("pop", "ref").agg(F.min("dist").alias("dist"))


def coverage(points: DataFrame, dims: int, radius: float) -> DataFrame:
    """``pop, coverage``: share of reference points within the radius of a point."""
    return nearest(points, reference_points(dims, 1)).groupBy("pop").agg(F.avg((c("dist") <= radius).cast("double")).alias("coverage"))


def dispersion(points: DataFrame, dims: int) -> DataFrame:
    """``pop, dispersion``: the largest distance of a reference point to the population."""
    return nearest(points, reference_points(dims, 2)).groupBy("pop").agg(F.max("dist").alias("dispersion"))


def calibrated_radius(n: int, dims: int, trials: int = 30, target: float = 0.99, count: int = 1000) -> float:
    """Radius at which ``n`` low-discrepancy points cover a share of reference points, as a mean over trials.

    The smallest radius that covers a share is an order statistic of the nearest distances, so no search is needed.
    """
    z = np.stack([_halton(n, p) for p in (2, 3, 5, 7, 11, 13)[:dims]], 1)
    out = []
    for t in range(trials):
        refs = np.random.default_rng(20260613 + dims * 1009 + n * 9176 + t).random((count, dims))
        d = np.sort(np.sqrt(((refs[:, None] - z[None]) ** 2).sum(2)).min(1))
        out.append(d[int(np.ceil(target * count)) - 1])
    return float(np.mean(out))


def _halton(n: int, base: int) -> np.ndarray:
    i, f, out = np.arange(1, n + 1), 1.0, np.zeros(n)
    while i.any():
        f /= base
        out += f * (i % base)
        i //= base
    return out


def kl_uniform(points: DataFrame, dims: int) -> DataFrame:
    """``pop, n, bins, kl``: divergence of the histogram over the unit cube from uniform, with 1e-10 for empty bins.

    Bins per axis are max(3, floor(n^(1/dims))) with values clipped to 0..1 and 1 in the last bin. Only filled bins are
    counted; the empty ones enter in closed form.
    """
    sizes = points.groupBy("pop").agg(F.count("*").cast("bigint").alias("n"))
    root = F.pow(c("n").cast("double"), 1.0 / dims)
    sizes = sizes.withColumn("b", F.greatest(F.lit(3), F.floor(root)).cast("bigint"))
    at = points.join(sizes, "pop").select("pop", "n", "b", F.transform("point", lambda v: F.least(F.floor(clip(v) * c("b")), c("b") - 1)).alias("bin"))
    filled = at.groupBy("pop", "n", "b", "bin").agg(F.count("*").alias("k"))
    cells = F.pow(c("b").cast("double"), float(dims))
    total = c("n") + cells * 1e-10
    p = (c("k") + 1e-10) / total
    some = filled.groupBy("pop", "n", "b").agg(F.sum(p * F.ln(p * cells)).alias("s"), F.count("*").alias("f"))
    q = F.lit(1e-10) / total
    return some.select("pop", "n", F.pow(c("b").cast("double"), float(dims)).cast("bigint").alias("bins"), (c("s") + (cells - c("f")) * q * F.ln(q * cells)).alias("kl"))


def hull_points(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in two or three dimensions (a superset in degenerate cases)."""
    p = np.unique(p, axis=0)
    if len(p) <= p.shape[1] + 1:
        return p
    if p.shape[1] == 2:
        return _hull2(p)
    faces = _hull3(p)
    return p if faces is None else p[np.unique(faces)]


def hull_volume(p: np.ndarray) -> float:
    """Area or volume of the hull; 0 for flat or too few points."""
    p = np.unique(p, axis=0)
    if len(p) <= p.shape[1]:
        return 0.0
    if p.shape[1] == 2:
        h = _hull2(p)
        x, y = h[:, 0], h[:, 1]
        return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)
    faces = _hull3(p)
    if faces is None:
        return 0.0
    mid = p.mean(0)
    a, b, d = (p[faces[:, k]] - mid for k in range(3))
    return float(np.abs(np.einsum("ij,ij->i", a, np.cross(b, d))).sum() / 6)


def _hull2(p: np.ndarray) -> np.ndarray:
    """Monotone chain."""
    p = p[np.lexsort((p[:, 1], p[:, 0]))]

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def _hull3(p: np.ndarray) -> np.ndarray | None:
    """Faces of the hull by adding points one at a time; None for flat input."""
    a = int(np.argmin(p[:, 0]))
    b = int(np.argmax(((p - p[a]) ** 2).sum(1)))
    line = np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1)
    d = int(np.argmax(line))
    normal = np.cross(p[b] - p[a], p[d] - p[a])
    e = int(np.argmax(np.abs((p - p[a]) @ normal)))
    if line[d] < 1e-12 or abs((p[e] - p[a]) @ normal) < 1e-14:
        return None
    mid = (p[a] + p[b] + p[d] + p[e]) / 4

    def face(i, j, k):
        n = np.cross(p[j] - p[i], p[k] - p[i])
        return (i, j, k) if n @ (p[i] - mid) > 0 else (i, k, j)

    faces = [face(a, b, d), face(a, b, e), face(a, d, e), face(b, d, e)]
    order = np.argsort(-((p - mid) ** 2).sum(1))  # far points first: most others then lie inside
    for q in order:
        f = np.array(faces)
        n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
        seen = np.einsum("ij,ij->i", n, p[q] - p[f[:, 0]]) > 1e-12
        if not seen.any():
            continue
        edges: set[tuple[int, int]] = set()
        for i, j, k in f[seen]:
            for x, y in ((i, j), (j, k), (k, i)):
                if (y, x) in edges:
                    edges.discard((y, x))
                else:
                    edges.add((x, y))
        faces = [tuple(t) for t in f[~seen]] + [face(x, y, q) for x, y in edges]
    return np.array(faces)


def hull(points: DataFrame) -> DataFrame:
    """``pop, hull``: volume of the convex hull. Tasks reduce their points to corners before the last step."""
    kind = points.schema["pop"].dataType.simpleString()

    def corners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for pop, g in f.groupby("pop", dropna=False):
                z = np.stack(g["point"].to_numpy())
                held[pop] = hull_points(np.concatenate([held[pop], z]) if pop in held else z)
        for pop, z in held.items():
            yield pd.DataFrame({"pop": [pop] * len(z), "point": list(z)})

    def volume(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pop": [f["pop"].iloc[0]], "hull": [hull_volume(np.stack(f["point"].to_numpy()))]})

    return points.select("pop", "point").mapInPandas(corners, f"pop {kind}, point array<double>").groupBy("pop").applyInPandas(volume, f"pop {kind}, hull double")


def balanced(coverage_, kl, avg_dist, min_dist):
    """0.45 coverage + 0.25 exp(-KL) + 0.20 average / sqrt 3 + 0.10 minimum / 0.25, each clipped to 0..1."""
    return 0.45 * clip(coverage_) + 0.25 * clip(F.exp(-kl)) + 0.20 * clip(avg_dist / F.sqrt(F.lit(3.0))) + 0.10 * clip(min_dist / 0.25)


def combined(validity, duplicates, coverage_, avg_dist, min_dist, dims: int):
    """validity * (1 - duplicates) * (0.65 coverage + 0.25 average / sqrt d + 0.10 minimum / sqrt d)."""
    root = F.sqrt(F.lit(float(dims)))
    return validity * (1.0 - duplicates) * (0.65 * clip(coverage_) + 0.25 * clip(avg_dist / root) + 0.10 * clip(min_dist / root))


def grid_archive(points: DataFrame, buckets: int, quality: str) -> DataFrame:
    """``pop, cell, best_id, best_quality, n``: the best point of each grid cell; ties keep the smallest id."""
    at = points.withColumn("cell", F.array_join(F.transform("point", lambda v: cell(v, buckets).cast("string")), "-"))
    best = F.min(F.struct((-c(quality)).alias("q"), c("id").alias("id")))
    out = at.groupBy("pop", "cell").agg(best.alias("b"), F.count("*").cast("bigint").alias("n"))
    return out.select("pop", "cell", c("b.id").alias("best_id"), (-c("b.q")).alias("best_quality"), "n")
