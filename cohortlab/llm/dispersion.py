"""A varied subset of given size: max-sum dispersion by local search over composable core-sets.

Space is cut into regions (a grid with at most ``regions`` cells). Every block of rows keeps, for each region, at most
``k`` (or ``keep``, if more) points that are farthest from each other; core-sets of core-sets are core-sets, so blocks and
partitions merge without limit. The last step, one task a kind, searches ``keep`` of them a region, more only where that
gives fewer than ``k`` in all, in memory that grows with their number and not with its square. The search starts with one point of every
occupied region and the farthest others, then swaps a selected for an unselected point while the total pairwise distance
grows. A swap may neither empty a region nor fill one above its share: plain max-sum dispersion would take the corners
only, and the crowded regions would rule by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.workspace import materialize, width


def farthest(points: np.ndarray, keep: int, order: np.ndarray) -> np.ndarray:
    """Positions of up to ``keep`` points by farthest-first traversal from the first in ``order``; repeats are left out."""
    first = int(order[0])
    chosen, gap = [first], np.linalg.norm(points - points[first], axis=1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    while len(chosen) < min(keep, len(points)):
        far = gap.max()
        if far <= 0:
            break
        ties = np.flatnonzero(gap == far)
        nxt = int(ties[np.argmin(rank[ties])])
        chosen.append(nxt)
        gap = np.minimum(gap, np.linalg.norm(points - points[nxt], axis=1))
    return np.array(chosen)


def core(ids: np.ndarray, cells: np.ndarray, points: np.ndarray, keep: int) -> np.ndarray:
    """Positions of a core-set: in each cell the farthest-first points, starting with the smallest id."""
    out = []
    by = np.argsort(cells, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(cells[by])) + 1):
        if len(part):
            out.append(part[farthest(points[part], keep, np.argsort(ids[part], kind="stable"))])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def local_search(points: np.ndarray, cells: np.ndarray, k: int, share: float = 1.5) -> np.ndarray:
    """Positions of ``k`` points (or all) that no allowed swap makes more dispersed.

    Memory is one number a point and one distance a selected point, whatever ``k`` is. Each swap raises the total
    distance, so the search ends by itself, and only where a whole sweep over the candidates finds no gain.
    """
    n = len(points)
    if n <= k:
        return np.arange(n)
    away = lambda i: np.linalg.norm(points - points[i], axis=1)
    kinds, code, count = np.unique(cells, return_inverse=True, return_counts=True)
    quota = max(1, int(np.ceil(share * k / len(kinds))))
    while (room := np.minimum(count, quota).sum()) < k:  # small regions can't fill their share
        quota += max(1, int((k - room) // len(kinds)))
    chosen = [int(np.flatnonzero(code == c)[0]) for c in range(len(kinds))]
    if len(chosen) > k:  # more regions than places: the farthest regions
        chosen = [chosen[i] for i in farthest(points[chosen], k, np.arange(len(chosen)))]
        chosen += [c for c in range(n) if c not in set(chosen)][: k - len(chosen)]
    inside = np.zeros(n, bool)
    inside[chosen] = True
    held = np.bincount(code[inside], minlength=len(kinds))
    gap, total = np.full(n, np.inf), np.zeros(n)
    for i in np.flatnonzero(inside):
        d = away(i)
        gap, total = np.minimum(gap, d), total + d
    while inside.sum() < k:
        free = ~inside & (held[code] < quota)
        nxt = int(np.argmax(np.where(free, gap, -1)))
        inside[nxt] = True
        held[code[nxt]] += 1
        d = away(nxt)
        gap, total = np.minimum(gap, d), total + d
    least = 1e-9 * (1 + total[inside].sum())
    moved = True
    while moved:
        moved = False
        for b in np.argsort(np.where(inside, -np.inf, total), kind="stable")[::-1][: n - k]:
            if inside[b]:
                continue
            a = np.flatnonzero(inside)
            if total[b] - total[a].min() <= least:
                continue
            gain = total[b] - np.linalg.norm(points[a] - points[b], axis=1) - total[a]
            allowed = (code[a] == code[b]) | ((held[code[a]] > 1) & (held[code[b]] < quota))
            gain = np.where(allowed, gain, -np.inf)
            best = int(np.argmax(gain))
            if gain[best] <= least:
                continue
            out = a[best]
            inside[out], inside[b], moved = False, True, True
            held[code[out]] -= 1
            held[code[b]] += 1
            total += away(b) - away(out)
    return np.flatnonzero(inside)


def spread(points: np.ndarray) -> tuple[float, float]:
    """Mean and least distance of two points, a row of distances at a time."""
    total, least = 0.0, float("inf")
    for i in range(len(points) - 1):
        d = np.linalg.norm(points[i + 1 :] - points[i], axis=1)
        total, least = total + float(d.sum()), min(least, float(d.min()))
    pairs = len(points) * (len(points) - 1) / 2
    return (total / pairs, least) if pairs else (0.0, 0.0)


def grid(dims: int, regions: int) -> int:
    """Steps per axis of the finest grid of at most ``regions`` cells."""
    steps = 1
    while (steps + 1) ** dims <= regions:
        steps += 1
    return steps


CORE = "id string, kind string, cell bigint, point array<double>, rank int"


def _table(batch_ids, kinds, cells, points, pick) -> pa.RecordBatch:
    """The picked rows; ``rank`` numbers them within their kind and cell."""
    pick = np.asarray(pick, np.int64)
    seen: dict[tuple, int] = {}
    rank = []
    for i in pick:
        rank.append(seen.get((kinds[i], int(cells[i])), 0))
        seen[kinds[i], int(cells[i])] = rank[-1] + 1
    return pa.record_batch([pa.array([batch_ids[i] for i in pick], pa.string()), pa.array([kinds[i] for i in pick], pa.string()), pa.array(cells[pick], pa.int64()), pa.array(points[pick].tolist(), pa.list_(pa.float64())), pa.array(rank, pa.int32())], ["id", "kind", "cell", "point", "rank"])


def _cores(keep: int, block: int):
    def reduce(ids: list, kinds: list, cells: list, points: list) -> tuple[list, list, list, list]:
        c, p = np.array(cells, np.int64), np.array(points, np.float64)
        names, code = np.unique(np.array(kinds, object).astype(str), return_inverse=True)
        pick = core(np.array(ids, object).astype(str), code * (int(c.max()) + 1) + c, p, keep)
        return [ids[i] for i in pick], [kinds[i] for i in pick], [cells[i] for i in pick], [points[i] for i in pick]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            for h, c in zip(held, batch.columns[:4], strict=True):
                h += c.to_pylist()
            if len(held[0]) >= block:
                held = reduce(*held)
        if held[0]:
            held = reduce(*held)
            yield _table(held[0], held[1], np.array(held[2], np.int64), np.array(held[3], np.float64), range(len(held[0])))

    return run


def share_of_each(counts: list[int], k: int, keep: int) -> int:
    """How many points a region may send to the search, so that there are ``k`` in all, but no fewer than ``keep``."""
    most, n = keep, np.array(counts, np.int64)
    while most < k and (room := np.minimum(n, most).sum()) < min(k, n.sum()):
        most += max(1, int((k - room) // max(1, len(n))))
    return most


def _search(k: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)]
        for kind in sorted({r[1] for r in rows}):
            own = sorted(r for r in rows if r[1] == kind)
            points, cells = np.array([r[3] for r in own], np.float64), np.array([r[2] for r in own], np.int64)
            most = share_of_each(np.unique(cells, return_counts=True)[1].tolist(), k, keep)
            pick = np.sort(core(np.array([r[0] for r in own], object).astype(str), cells, points, most))
            own, points, cells = [own[i] for i in pick], points[pick], cells[pick]
            yield _table([r[0] for r in own], [kind] * len(own), cells, points, local_search(points, cells, k))

    return run


def axis_point(axes: Column, names: list[str], default: float = 0.5) -> Column:
    """The point of an axis map. Names match without outer blanks and case, with blanks and hyphens as underscores.

    A missing, null, NaN or out-of-range value is ``default``. Of several spellings of one axis the largest value counts.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")

    def value(name: str) -> Column:
        own = F.filter(F.map_entries(axes), lambda e: (plain(e["key"]) == name) & e["value"].between(0.0, 1.0) & ~F.isnan(e["value"]))
        return F.coalesce(F.array_max(F.transform(own, lambda e: e["value"])), F.lit(default))

    return F.array(*[value(n) for n in names])


def regions_of(points: DataFrame, dims: int, regions: int) -> DataFrame:
    """Adds ``cell``, the grid cell of ``point``."""
    steps = grid(dims, regions)
    cell = F.aggregate("point", F.lit(0).cast("bigint"), lambda acc, v: acc * steps + F.least(F.floor(v * steps), F.lit(steps - 1)))
    return points.withColumn("cell", cell)


def varied(points: DataFrame, k: int, dims: int, *, regions: int | None = None, keep: int = 16, block: int = 100_000) -> DataFrame:
    """``id, kind, cell, point`` of ``k`` varied points of every kind (all, if there are fewer different ones).

    ``points`` has ``id`` and ``kind`` (strings) and ``point`` (array of doubles in 0..1). Null ids are left out;
    repeated rows and equal points of one region count once. Kinds are few and known: each is searched in one step of
    bounded size.
    """
    spark = points.sparkSession
    regions = regions or max(1, k // 2)  # so that every occupied region finds a place
    cells = regions_of(points.where("id is not null and point is not null"), dims, regions).select("id", "kind", "cell", "point")
    cores = cells.mapInArrow(_cores(max(keep, k), block), CORE)
    merged = materialize(cores.repartition(width(spark), "kind", "cell").mapInArrow(_cores(max(keep, k), block), CORE), "cores")
    # At most max(keep x regions, k + regions) points of a kind reach its search; their order in a core is farthest first.
    held: dict[str, list[int]] = {}
    for r in merged.groupBy("kind", "cell").agg(F.count("*").alias("n")).collect():  # kinds x regions rows
        held.setdefault(r["kind"], []).append(r["n"])
    most = F.coalesce(*[F.when(F.col("kind") == kind, share_of_each(n, k, keep)) for kind, n in held.items()]) if held else F.lit(keep)
    few = merged.where(F.col("rank") < most).repartition(max(1, len(held)), "kind")
    return few.mapInArrow(_search(k, keep), CORE).drop("rank")


def quality(points: DataFrame, chosen: DataFrame, dims: int, regions: int) -> DataFrame:
    """Per kind: rows, occupied regions and how many of them the choice covers, the largest region's share of the rows and

    of the choice, mean and least distance of two chosen points, and those of as many rows taken by hash.
    """
    cells = regions_of(points.where("id is not null and point is not null"), dims, regions)
    per = cells.groupBy("kind", "cell").agg(F.count("*").alias("n"))
    of = lambda df, n: df.groupBy("kind").agg(F.sum("n").cast("bigint").alias(f"n_{n}"), F.count("*").cast("bigint").alias(f"regions_{n}"), F.round(F.max("n") / F.sum("n"), 6).alias(f"largest_{n}"))
    sizes = chosen.groupBy("kind").agg(F.count("*").alias("k"))
    drawn = cells.join(sizes, "kind").withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.lit(1 << 20)) < F.greatest(F.lit(64), (F.lit(4 << 20) * F.col("k") / F.lit(max(1, points.count()))).cast("int")))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "id"))
    random = drawn.withColumn("r", rank).where("r <= k").select("kind", "point", F.lit("random").alias("way"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            for kind, point, way in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault((kind, way), []).append(point)
        for (kind, way), p in held.items():
            mean, least = spread(np.array(p, np.float64))
            yield pa.record_batch([pa.array([kind]), pa.array([way]), pa.array([mean]), pa.array([least])], ["kind", "way", "mean", "least"])

    both = chosen.select("kind", "point", F.lit("chosen").alias("way")).unionByName(random).repartition("kind", "way").mapInArrow(measure, "kind string, way string, mean double, least double")
    at = lambda way, c: F.round(F.max(F.when(F.col("way") == way, F.col(c))), 6).alias(f"{c}_distance_{way}")
    figures = both.groupBy("kind").agg(at("chosen", "mean"), at("chosen", "least"), at("random", "mean"), at("random", "least"))
    selected = chosen.groupBy("kind", "cell").agg(F.count("*").alias("n"))
    return of(per, "rows").join(of(selected, "chosen"), "kind").join(figures, "kind")


def variety_report(points: DataFrame, chosen: DataFrame, dims: int, regions: int) -> DataFrame:
    """Per kind and region: rows, their share, selected points and their share."""
    all_ = regions_of(points.where("id is not null and point is not null"), dims, regions).groupBy("kind", "cell").agg(F.count("*").cast("bigint").alias("n_rows"))
    sel = chosen.groupBy("kind", "cell").agg(F.count("*").cast("bigint").alias("n_selected"))
    both = all_.join(sel, ["kind", "cell"], "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)).cast("bigint"))
    w = Window.partitionBy("kind")
    return both.select("kind", "cell", "n_rows", F.round(F.col("n_rows") / F.sum("n_rows").over(w), 6).alias("row_share"), "n_selected", F.round(F.col("n_selected") / F.sum("n_selected").over(w), 6).alias("selected_share"))
