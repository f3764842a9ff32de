"""Items into containers of fixed capacity by best-fit decreasing.

A segment tree over remaining capacities finds the tightest open container in logarithmic time. Partitions of the items
(by hash, so each sees the same mix of sizes) are packed on their own; each then gives up its loosest containers, at
most ``carry`` of them, and their items are packed again in fewer partitions, down to one. A partition works through
blocks of bounded size, so no task holds more than ``block`` items.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.workspace import materialize, width

#: Pre-tokens of the byte-level vocabularies; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Capacities:
    """Open containers by remaining capacity; ``tightest(size)`` gives the one with the least room that still fits."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.n)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, container: int) -> None:
        self.open[room].append(container)
        i = room + self.n
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def _pop(self, room: int) -> int:
        out = self.open[room].pop()
        if not self.open[room]:
            i = room + self.n
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return out

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(room, container) taken out of the tree, or None."""
        i = size + self.n
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # up until a right sibling holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.n
        return room, self._pop(room)


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container of each item, and the room left in each container. No size exceeds the capacity; equal sizes keep their order."""
    where, left, tree = [0] * len(sizes), [], Capacities(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found is None:
            room, c = capacity, len(left)
            left.append(capacity)
        else:
            room, c = found
        where[i], left[c] = c, room - sizes[i]
        tree.push(left[c], c)
    return where, left


ITEM = "item string, part int, tokens int, container string, room int"


def _pack(capacity: int, level: int, last: bool, carry: int, block: int):
    def packed(items: list[tuple], n: int) -> pa.RecordBatch:
        items.sort(key=lambda r: (-r[2], r[0] is not None, r[0] or "", r[1]))
        where, left = best_fit_decreasing([r[2] for r in items], capacity)
        loose = set() if last else set(sorted((c for c in range(len(left)) if left[c] > 0), key=lambda c: (-left[c], c))[:carry])
        at = TaskContext.get().partitionId()
        name = [None if c in loose else f"{level}-{at}-{n}-{c}" for c in where]
        room = [None if c in loose else left[c] for c in where]
        return pa.record_batch([pa.array([r[0] for r in items], pa.string()), pa.array([r[1] for r in items], pa.int32()), pa.array([r[2] for r in items], pa.int32()), pa.array(name, pa.string()), pa.array(room, pa.int32())], [x.split()[0] for x in ITEM.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple] = []
        n = 0
        for batch in batches:
            items += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(items) >= block:
                yield packed(items, n)
                items, n = [], n + 1
        if items:
            yield packed(items, n)

    return run


def pack(sizes: DataFrame, item: str, tokens: str, capacity: int = 2048, *, carry: int = 32, block: int = 500_000, fold: int = 16) -> DataFrame:
    """``item, part, tokens, container, room``: every item in a container of ``capacity``.

    Only an item larger than the capacity is split: into full parts, each a container of its own, and a rest that is
    packed like an item. Null sizes count as 0; items of size 0 are placed, too; repeated rows are placed each. ``room``
    is what the container leaves unused.
    """
    spark = sizes.sparkSession
    n = F.coalesce(F.col(tokens).cast("bigint"), F.lit(0))
    rows = sizes.select(F.col(item).cast("string").alias("item"), n.alias("n"))
    full = F.floor(F.col("n") / capacity).cast("int")
    parts = rows.select("item", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1))).alias("part"), full.alias("full"))
    parts = parts.select("item", "part", F.when(F.col("part") < F.col("full"), F.lit(capacity)).otherwise(F.col("n") - F.col("part") * capacity).cast("int").alias("tokens"))
    width_now, level, todo, done = width(spark), 0, parts, []
    while True:
        last = width_now == 1
        out = materialize(todo.repartition(width_now, F.xxhash64("item", "part")).mapInArrow(_pack(capacity, level, last, carry, block), ITEM), f"pack{level}")
        done.append(out if last else out.where("container is not null"))
        if last:
            break
        todo = out.where("container is null").select("item", "part", "tokens")
        width_now, level = max(1, width_now // fold), level + 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def _counter(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            counts = [0 if not t else len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int32())], ["item", "tokens"])

    return run


def token_counts(df: DataFrame, item: str, text: str, vocabulary: str) -> DataFrame:
    """``item, tokens``: tokens of each whole text by a byte-level BPE vocabulary file in rank format. Null texts have 0."""
    with open(vocabulary, "rb") as f:
        data = f.read()  # under a megabyte: the vocabulary goes to the tasks, which need no such file
    return df.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(_counter(data), "item string, tokens int")
