"""The first N items of every group by sorted runs and a loser tree.

Each task writes sorted runs: rows ordered by (bucket, group, score descending, tie ascending), cut to N rows a group
while they stream by, one blob per bucket. A bucket's runs are merged by a loser tree; as soon as a group has given N
rows, every run seeks to its next group. A group of any size thus sends at most N rows per run over the network.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.workspace import width


class LoserTree:
    """Tournament over run cursors: the root knows the winner, inner nodes the losers of their matches."""

    def __init__(self, keys: list):
        """``keys`` hold each run's current key, None for an exhausted run."""
        self.k = max(1, len(keys))
        self.keys = list(keys)
        self.losers = [-1] * self.k
        for run in range(len(keys)):
            self._up(run, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _up(self, run: int, building: bool = False) -> None:
        node = (run + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                if building:
                    self.losers[node] = run
                    return
            elif self._before(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def winner(self) -> int:
        return self.losers[0]

    def replace(self, run: int, key) -> None:
        """Give the winning run its next key."""
        self.keys[run] = key
        self._up(run)


def _kept(group_cols: list, carry: tuple, n: int) -> tuple[np.ndarray, tuple]:
    """Mask of the rows that are among the first ``n`` of their group; ``carry`` is the last group and its rows so far."""
    rows = len(group_cols[0])
    same = np.ones(rows, bool)
    same[0] = False
    for c in group_cols:
        v = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        codes = v.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        same[1:] &= codes[1:] == codes[:-1]
    first = tuple(c[0].as_py() for c in group_cols)
    starts = np.flatnonzero(~same)
    rank = np.arange(rows) - np.repeat(starts, np.diff(np.append(starts, rows)))
    if carry and carry[0] == first:
        end = starts[1] if len(starts) > 1 else rows
        rank[:end] += carry[1]
    last = tuple(c[-1].as_py() for c in group_cols)
    return rank < n, (last, int(rank[-1]) + 1)


def _write_runs(groups: int, n: int):
    """Input: bucket, groups..., score, tie, sorted. Output: bucket, run (Arrow stream of the rows kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        carry: tuple = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            mask, carry = _kept([table.column(i) for i in range(1 + groups)], carry, n)
            table = table.filter(pa.array(mask))
            bucket = table.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if b > a:
                    held.setdefault(int(bucket[a]), []).append(table.slice(a, b - a).drop_columns(table.column_names[:1]))
            for done in [k for k in held if k != carry[0][0]]:
                yield _blob(done, held.pop(done))
        for k in list(held):
            yield _blob(k, held.pop(k))

    return run


def _blob(bucket: int, parts: list[pa.Table]) -> pa.RecordBatch:
    table = pa.concat_tables(parts).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "run"])


class _Run:
    """A cursor over one sorted run that can skip to its next group."""

    def __init__(self, blob: bytes, groups: int):
        t = pa.ipc.open_stream(blob).read_all().combine_chunks()
        cols = [c.to_pylist() for c in t.columns]
        self.group = list(zip(*[[(v is not None, v) for v in c] for c in cols[:groups]], strict=True))
        self.score, self.tie, self.i = cols[groups], cols[groups + 1], 0
        self.next = [0] * len(self.score)
        after = len(self.score)
        for k in range(len(self.score) - 1, -1, -1):
            if k + 1 < len(self.score) and self.group[k + 1] != self.group[k]:
                after = k + 1
            self.next[k] = after

    def key(self):
        if self.i >= len(self.score):
            return None
        tie = self.tie[self.i]
        return self.group[self.i], -self.score[self.i], (tie is None, tie)


def _merge_runs(groups: int, n: int):
    """Input: bucket, run. Output: groups..., score, tie, rank."""

    def merged(blobs: list[bytes]) -> Iterator[tuple]:
        runs = [_Run(b, groups) for b in blobs]
        tree = LoserTree([r.key() for r in runs])
        group, given = None, 0
        while True:
            w = tree.winner()
            if tree.keys[w] is None:
                return
            r = runs[w]
            if r.group[r.i] != group:
                group, given = r.group[r.i], 0
            if given == n:
                r.i = r.next[r.i]  # seek: this run has nothing more to give to the group
            else:
                given += 1
                yield (*(v for _, v in group), r.score[r.i], r.tie[r.i], given)
                r.i += 1
            tree.replace(w, r.key())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(k, []).append(blob)
        for k in sorted(by):
            rows = list(merged(by[k]))
            like = pa.ipc.open_stream(by[k][0]).schema
            if rows:
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, [*like.types, pa.int32()], strict=True)]
                yield pa.record_batch(arrays, [*like.names, "rank"])

    return run


def top_n(df: DataFrame, groups: list[str], score: str, tie: str, n: int, buckets: int | None = None) -> DataFrame:
    """``groups..., score, tie, rank`` (1 to ``n``) of the ``n`` rows of highest ``score`` in every group.

    Equal scores are ordered by ``tie`` ascending, null ties last; rows that repeat in all these columns count each.
    Rows whose score is null or NaN are no items. A null group value forms a group of its own. Fewer than ``n`` items:
    all of them. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    buckets = buckets or 4 * width(spark)
    names = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(c).alias(x) for c, x in zip(groups, names, strict=True)], F.col(score).cast("double").alias("score"), F.col(tie).alias("tie"))
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
    rows = rows.select(F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int").alias("bucket"), *names, "score", "tie")
    types = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    runs = rows.sortWithinPartitions("bucket", *names, F.desc("score"), F.asc_nulls_last("tie")).mapInArrow(_write_runs(len(groups), n), "bucket int, run binary")
    out = runs.repartition(min(buckets, width(spark)), "bucket").mapInArrow(_merge_runs(len(groups), n), ", ".join([*types, "rank int"]))
    return out.select(*[F.col(x).alias(c) for c, x in zip(groups, names, strict=True)], F.col("score").alias(score), F.col("tie").alias(tie), "rank")


def latest(df: DataFrame, key: str, columns: list[str], when: list[str]) -> DataFrame:
    """One row per key: the row that is last by ``when``, a repeated row once. Null keys form one group."""
    order = F.struct(*[F.col(c) for c in when])
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in columns])
