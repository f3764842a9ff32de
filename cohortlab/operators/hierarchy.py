"""Parent-child links of unknown depth: root, depth, path, descendants and loops.

Weighted disjoint-set forests are built partition by partition: each node keeps an anchor, its distance to it and the
smallest id on the way, with path compression by pointer jumping on arrays. Only the *boundary* nodes, to which other
blocks refer, go on. They are a forest of the same kind, with longer links, and are merged hierarchically: neighbouring
blocks together into blocks of the next level, until one block of bounded size holds what is left. Then ends are handed
down level by level, and each node's result is the composition of its offset with that of its anchor.

If the rows have no locality at all, merging neighbours leaves most boundary nodes on the boundary. Such a level is
composed by shuffled joins instead, in which every chain halves with each round. Nodes that never reach a root lead into
a loop.

Memory: no task holds more than ``block_rows`` links, whatever the size of a tree. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.workspace import drop, materialize

OPEN, ROOTED, LOOP = 0, 1, 2


def _compress(parent: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted forest over one block.

    ``parent`` holds positions, -1 for a local top; ``weight`` the length of the link to it. Returns each node's top, its
    distance, the smallest rank from the node up to the top inclusive, and whether it leads into a loop (then the
    smallest rank is that of the loop only).
    """
    n = len(parent)
    top = np.where(parent < 0, np.arange(n), parent)
    far = np.where(parent >= 0, weight, 0)
    low = np.where(parent >= 0, np.minimum(rank, rank[top]), rank)
    for _ in range(max(1, int(n).bit_length())):
        if np.array_equal(top[top], top):
            break
        low = np.minimum(low, low[top])
        far = far + far[top]
        top = top[top]
    looped = parent[top] >= 0
    if looped.any():
        # After n or more steps every pointer stands on its loop: the tops that were reached are the loop's nodes.
        on = np.unique(top[looped])
        step, best = parent.copy(), rank.copy()
        while True:
            better = best.copy()
            better[on] = np.minimum(best[on], best[step[on]])
            after = step.copy()
            after[on] = step[step[on]]
            if np.array_equal(better, best):
                break
            best, step = better, after
        low = np.where(looped, best[top], low)
    return top, far, low, looped


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of exactly ``rows`` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


FOREST = "node string, anchor string, hops bigint, state int, least string, block bigint"


def _forest(block_rows: int, with_path: bool):
    """Input and output: :data:`FOREST` (and ``path``, the nodes from a node up to its anchor, the anchor left out).

    An open row links its node to its anchor; what ends inside the block, or leaves it, is known afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for block in _blocks(batches, block_rows):
            names, anchors, lows = (block.column(c).to_pylist() for c in ("node", "anchor", "least"))
            hops, state = (np.array(block.column(c).to_pylist(), np.int64) for c in ("hops", "state"))
            at = {x: i for i, x in enumerate(names)}
            parent = np.fromiter((at.get(x, -1) if s == OPEN else -1 for x, s in zip(anchors, state.tolist(), strict=True)), np.int64, len(names))
            order = sorted(range(len(names)), key=lows.__getitem__)
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            top, far, low, looped = _compress(parent, rank, hops)
            least = [lows[order[k]] for k in low.tolist()]
            ends = np.where(looped | (state[top] == LOOP), LOOP, state[top])
            far = np.where(ends == LOOP, -1, far + hops[top])
            # A loop is named by its smallest id, which an end that was known before has as its anchor.
            anchor = [x if c else anchors[t] for x, c, t in zip(least, looped.tolist(), top.tolist(), strict=True)]
            columns = [pa.array(names, pa.string()), pa.array(anchor, pa.string()), pa.array(far), pa.array(ends.astype(np.int32)), pa.array(least, pa.string()), pa.array(np.full(len(names), number), pa.int64())]
            fields = [x.split()[0] for x in FOREST.split(", ")]
            if with_path:
                own = block.column("path").to_pylist()
                paths: list[list[str] | None] = []
                for i in range(len(names)):
                    chain: list[str] | None = None
                    if ends[i] != LOOP:
                        chain, k = [], i
                        while k >= 0:
                            chain += own[k]
                            k = int(parent[k])
                    paths.append(chain)
                columns.append(pa.array(paths, pa.list_(pa.string())))
                fields.append("path")
            yield from pa.table(columns, fields).to_batches(max_chunksize=10_000)
            number += 1

    return run


def linked(df: DataFrame, node: str, parent: str, key=lambda c: c, locality: tuple[str, ...] = ()) -> DataFrame:
    """One row ``node, parent`` per distinct node, with the parent's own spelling or null.

    ``key`` turns an id into the form in which ids are compared. Null nodes are left out. Several parents of one node:
    the smallest counts. A parent that no row has is null. Extra columns are ignored.
    """
    wanted = [F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent")]
    rows = df.select(*wanted, *[F.col(c).alias(f"near{i}") for i, c in enumerate(locality)]).where("node is not null")
    near = [F.min(f"near{i}").alias(f"near{i}") for i in range(len(locality))]
    nodes = rows.groupBy("node").agg(F.min("parent").alias("parent"), *near)
    known = nodes.groupBy(key(F.col("node")).alias("k")).agg(F.min("node").alias("known"))
    return nodes.withColumn("k", key(F.col("parent"))).join(known, "k", "left").select("node", F.col("known").alias("parent"), *[f"near{i}" for i in range(len(locality))])


def resolve(df: DataFrame, node: str, parent: str, *, key=lambda c: c, locality: tuple[str, ...] = (), block_rows: int = 200_000, with_path: bool = False) -> DataFrame:
    """Root and depth of every distinct node; with ``with_path`` also the path from the root to the node.

    Result: ``node, root, depth`` and perhaps ``path`` (array, root first). Nodes on or below a loop have depth -1, the
    smallest id of that loop as root, and a null path. A null, blank (if ``key`` makes it so) or unknown parent makes a
    root of depth 0. Repeated rows count once. ``locality`` names columns by which parents tend to be near their
    children; they only save work. An empty table gives an empty result.
    """
    links = linked(df, node, parent, key, locality)
    if locality:
        near = [f"near{i}" for i in range(len(locality))]
        links = links.repartitionByRange(*near, "node").sortWithinPartitions(*near, "node")  # a hot value is split, too
    open_ = F.col("parent").isNotNull()
    start = links.select("node", F.coalesce("parent", "node").alias("anchor"), open_.cast("bigint").alias("hops"), F.when(open_, OPEN).otherwise(ROOTED).cast("int").alias("state"), F.col("node").alias("least"), F.lit(0).cast("bigint").alias("block"), *([F.array("node").alias("path")] if with_path else []))
    schema = FOREST + ", path array<string>" * with_path
    local = materialize(start.mapInArrow(_forest(block_rows, with_path), schema), "forest")
    ends = _merge(local, max(1, block_rows // 10) if with_path else block_rows, with_path)  # ends have whole paths
    out = local.where(F.col("state") != OPEN).unionByName(_handed_down(local, ends, with_path))
    path = [F.when(F.col("state") == ROOTED, F.reverse("path")).alias("path")] if with_path else []
    return out.select("node", F.col("anchor").alias("root"), F.col("hops").alias("depth"), *path)


def _handed_down(level: DataFrame, ends: DataFrame, with_path: bool) -> DataFrame:
    """The open rows of a level, which end where their boundary nodes end."""
    e = ends.select(F.col("node").alias("anchor"), F.col("anchor").alias("a2"), F.col("hops").alias("h2"), F.col("state").alias("s2"), *([F.col("path").alias("p2")] if with_path else []))
    return level.where(F.col("state") == OPEN).join(e, "anchor").select(
        "node",
        F.col("a2").alias("anchor"),
        F.when(F.col("s2") == LOOP, F.lit(-1)).otherwise(F.col("hops") + F.col("h2")).cast("bigint").alias("hops"),
        F.col("s2").alias("state"),
        "least",
        "block",
        *([F.when(F.col("s2") != LOOP, F.concat("path", "p2")).alias("path")] if with_path else []),
    )


def _boundary(level: DataFrame) -> DataFrame:
    """The nodes of a level at which open rows of other blocks end."""
    targets = level.where(F.col("state") == OPEN).select(F.col("anchor").alias("node")).distinct()
    return materialize(level.join(targets, "node", "left_semi"), "boundary")


def _merge(local: DataFrame, block_rows: int, with_path: bool) -> DataFrame:
    """Ends of the boundary nodes of the first level: no row of the result is open."""
    schema = local.schema
    levels: list[DataFrame] = []
    now = _boundary(local)
    while True:
        n, left = now.agg(F.count("*"), F.count_if(F.col("state") == OPEN)).first()
        if left == 0:
            ends = now
            break
        if n <= block_rows:  # one block holds all that is left
            ends = materialize(now.repartition(1).mapInArrow(_forest(block_rows, with_path), schema), "ends")
            break
        groups = -(-2 * n // block_rows)
        merged = materialize(now.repartitionByRange(groups, "block").mapInArrow(_forest(block_rows, with_path), schema), "level")
        above = _boundary(merged)
        if above.count() > 0.7 * n:  # neighbours hardly refer to each other
            drop(above), drop(merged)
            ends = _doubled(now, with_path)
            break
        levels.append(merged)
        now = above
    for level in reversed(levels):  # a level holds all rows of the boundary below it
        ends = materialize(level.where(F.col("state") != OPEN).unionByName(_handed_down(level, ends, with_path)), "ends")
    return ends


def _doubled(start: DataFrame, with_path: bool) -> DataFrame:
    """Ends of boundary nodes by composing every open node with its anchor's anchor, round after round."""
    now, open_before = start, None
    while True:
        left = now.where(F.col("state") == OPEN).count()
        if left == 0:
            return now
        if left == open_before:
            # No node ended although all looked twice as far: the rest never ends.
            stuck = now.where(F.col("state") == OPEN)
            z = _loops(start, stuck).withColumnRenamed("least", "loop")
            caught = stuck.join(z, "node").select("node", F.col("loop").alias("anchor"), F.lit(-1).cast("bigint").alias("hops"), F.lit(LOOP).alias("state"), "least", "block", *([F.lit(None).cast("array<string>").alias("path")] if with_path else []))
            return materialize(now.where(F.col("state") != OPEN).unionByName(caught), "ends")
        open_before = left
        nxt = materialize(_compose(now, with_path), "round")
        if now is not start:
            drop(now)
        now = nxt


def _compose(now: DataFrame, with_path: bool) -> DataFrame:
    """Every open node takes over its anchor's anchor."""
    return now.where(F.col("state") != OPEN).unionByName(_handed_down(now, now, with_path))


def _loops(start: DataFrame, stuck: DataFrame) -> DataFrame:
    """(node, least) for boundary nodes that never end: the smallest id on the loop they reach."""
    reach = materialize(stuck.select("node", "anchor"), "stuck")
    size = None
    while True:  # until one more doubling reaches no fewer nodes: then exactly the loops are reached
        on = reach.select(F.col("anchor").alias("node")).distinct()
        now = on.count()
        if now == size:
            break
        size, old = now, reach
        reach = materialize(reach.join(reach.select(F.col("node").alias("anchor"), F.col("anchor").alias("a2")), "anchor").select("node", F.col("a2").alias("anchor")), "reach")
        drop(old)
    ring = materialize(start.join(on, "node", "left_semi").select("node", "anchor", "least"), "ring")
    while True:  # the smallest id over a window that doubles
        wider = materialize(
            ring.join(ring.select(F.col("node").alias("anchor"), F.col("anchor").alias("a2"), F.col("least").alias("l2")), "anchor").select("node", F.col("a2").alias("anchor"), F.least("least", "l2").alias("least"), (F.col("l2") < F.col("least")).alias("moved")),
            "ring",
        )
        ring = wider.select("node", "anchor", "least")
        if not wider.where("moved").limit(1).count():
            break
    return reach.join(ring.select(F.col("node").alias("anchor"), "least"), "anchor").select("node", "least")


def descendants(paths: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` (>= 1) from the result of :func:`resolve` with paths; loops have none."""
    steps = paths.where("path is not null").select(F.col("node").alias("descendant"), F.posexplode("path").alias("i", "ancestor"), F.size("path").alias("n"))
    return steps.where(F.col("i") < F.col("n") - 1).select("ancestor", "descendant", (F.col("n") - 1 - F.col("i")).cast("bigint").alias("distance"))
