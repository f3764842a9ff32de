"""Exact similarity self-join of token sets within groups, by parts of their tokens.

Two sets of n and m tokens and similarity t differ in at most (n + m) (1 - t) / (1 + t) tokens. Pairs are parted into
classes by the size of their larger set; of a class up to size u, all pairs differ in at most d = 2 u (1 - t) / (1 + t)
tokens. Tokens are dealt by hash to d + 1 parts, so two similar sets agree wholly in one part at least, whatever its
tokens; the hash of each part is a key. A set is in one or two classes, mostly, and has some 50 keys for 80 tokens.

Only packed records travel: a set's bitmap, size and 32-bit keys, once for each partition that gets keys of it. Pairs are
made where records with equal keys meet, and leave the task only if their bitmaps and sizes allow the similarity; what
leaves is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.scalars import jaccard
from cohortlab.workspace import materialize, width

c = F.col
#: 64-bit words of a bitmap, and pairs a task holds before it writes them.
WORDS, HELD = 4, 500_000
RECORD = np.dtype([("ref", "<i8"), ("bits", "<u8", (WORDS,)), ("size", "<i4"), ("low", "<i4"), ("keys", "<i4")])


def _mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _classes(t: float, most: int) -> list[int]:
    """Ends of the size classes, from 0 up to ``most``: a class has the pairs whose larger set is above one end and not above the next."""
    ends = [0]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, int(ends[-1] / max(t, 0.5))))
    return ends


def _keys(h: np.ndarray, owner: np.ndarray, sets: int, parts: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets and the set of each: of every part, or of every token (no ``parts``). ``owner`` is the set of each token."""
    if parts is None:
        return _mix(h), owner
    part = (_mix(h ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
    sums = np.zeros(sets * parts, np.uint64)
    np.add.at(sums, owner * parts + part, _mix(h))
    return _mix(sums ^ _mix(np.tile(np.arange(1, parts + 1, dtype=np.uint64), sets))), np.repeat(np.arange(sets), parts)


def _pack(t: float, partitions: int):
    """Input: ref, room (hash of the group), h (hashes of the tokens). Output: part, records, keys."""
    spread = np.uint64(-(-partitions // 8))  # partitions that get keys of one group and class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ref, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            if not len(ref):
                continue
            room = batch.column(1).to_numpy()[first].view(np.uint64)
            at = batch.column(2).offsets.to_numpy().astype(np.int64)
            n, starts = np.diff(at)[first], at[:-1][first]
            owner = np.repeat(np.arange(len(n)), n)
            h = batch.column(2).values.to_numpy()[np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)].view(np.uint64)
            bits = np.zeros(len(n) * WORDS, np.uint64)
            bit = (h >> np.uint64(7)) % np.uint64(64 * WORDS)
            np.bitwise_or.at(bits, owner * WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            bits = bits.reshape(-1, WORDS)
            ends = _classes(t, int(n.max() / max(t, 0.01)) + 1)
            for k, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
                own = (n <= high) & (n >= t * (low + 1) - 1e-9)
                if not own.any():
                    continue
                who, held = np.flatnonzero(own), own[owner]
                parts = int((1 - t) / (1 + t) * 2 * high + 1e-9) + 1
                key, its = _keys(h[held], (np.cumsum(own) - 1)[owner[held]], len(who), parts if parts <= high else None)
                key = _mix(key ^ _mix(room[who] + np.uint64(k))[its])
                to = (_mix(room[who][its] + key % spread * np.uint64(1021) + np.uint64(k)) % np.uint64(partitions)).astype(np.int64)
                order = np.lexsort((its, to))
                to, its, key = to[order], its[order], (key[order] >> np.uint64(32)).astype("<u4")
                cuts = np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (its[1:] != its[:-1])))
                rows = np.empty(len(cuts), RECORD)
                x = who[its[cuts]]
                rows["ref"], rows["bits"], rows["size"], rows["low"], rows["keys"] = ref[x], bits[x], n[x], low, np.diff(np.append(cuts, len(to)))
                some = np.unique(to)
                a, b = np.searchsorted(to[cuts], some), np.searchsorted(to[cuts], some, "right")
                i, j = np.searchsorted(to, some), np.searchsorted(to, some, "right")
                blobs = [[r[p:q].tobytes() for p, q in zip(f, g, strict=True)] for r, f, g in ((rows, a, b), (key, i, j))]
                yield pa.record_batch([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["part", "records", "keys"])

    return run


def _meet(t: float):
    """Input: part, records, keys. Output: a, b (a < b): refs of records of an equal key that may reach ``t``."""

    def batch_of(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*held, strict=True)], axis=1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, keys = [], []
        for batch in batches:
            records += [np.frombuffer(x, RECORD) for x in batch.column(1).to_pylist()]
            keys += [np.frombuffer(x, "<u4") for x in batch.column(2).to_pylist()]
        if not records:
            return
        r, key = np.concatenate(records), np.concatenate(keys)
        its = np.repeat(np.arange(len(r)), r["keys"])
        ref, bits, size, low = (np.ascontiguousarray(r[x]) for x in ("ref", "bits", "size", "low"))
        order = np.lexsort((low[its], ref[its], key))
        key, its = key[order], its[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (ref[its][1:] != ref[its][:-1]) | (low[its][1:] != low[its][:-1]))
        key, its = key[fresh], its[fresh]  # copies are one record
        slack = size - np.bitwise_count(bits).sum(-1).astype(np.int32)
        held, count, step, at = [], 0, 1, np.arange(len(key))
        while len(at):  # each record of a block with the next one, the next but one, ...
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            i, j = its[at], its[at + step]
            ok = (np.minimum(size[i], size[j]) >= t * np.maximum(size[i], size[j]) - 1e-9) & (np.maximum(size[i], size[j]) > low[i])
            i, j = i[ok], j[ok]
            most = np.minimum(slack[i], slack[j])
            for w in range(WORDS):
                most = most + np.bitwise_count(bits[i, w] & bits[j, w])
            ok = most >= t / (1 + t) * (size[i] + size[j]) - 1e-9
            a, b = ref[i[ok]], ref[j[ok]]
            if len(a):
                held.append((np.minimum(a, b), np.maximum(a, b)))
                count += len(a)
            if count > HELD:
                yield batch_of(held)
                held, count = [], 0
            step += 1
        if held:
            yield batch_of(held)

    return run


def similar_pairs(rows: DataFrame, t: float) -> DataFrame:
    """``grp, a, b, similarity`` with a < b and similarity >= ``t`` (above 0); ``rows`` has ``grp, id, tokens`` (distinct arrays).

    Two empty sets of a group are alike (similarity 1). Null ids and arrays match nothing, repeated rows count once.
    """
    rows = rows.where("id is not null and tokens is not null").select("grp", "id", "tokens")
    parts = width(rows.sparkSession)
    sets = rows.where(F.size("tokens") > 0).withColumn("ref", F.xxhash64("grp", "id", "tokens"))
    hashed = sets.select("ref", F.xxhash64("grp").alias("room"), F.transform("tokens", lambda w: F.xxhash64(w)).alias("h"))
    blobs = hashed.mapInArrow(_pack(t, parts), "part int, records binary, keys binary")
    cand = materialize(blobs.repartitionById(parts, "part").mapInArrow(_meet(t), "a bigint, b bigint").distinct(), "pairs")
    needed = cand.select(c("a").alias("ref")).union(cand.select("b")).distinct()
    texts = materialize(sets.join(needed, "ref", "left_semi").dropDuplicates(["ref"]), "sets")
    whole = lambda x: texts.select(c("ref").alias(x), *[c(k).alias(f"{k}_{x}") for k in ("grp", "id", "tokens")])
    both = cand.join(whole("a"), "a").join(whole("b"), "b").where("grp_a = grp_b and id_a <> id_b").withColumn("similarity", jaccard("tokens_a", "tokens_b")).where(c("similarity") >= t)
    found = both.select(c("grp_a").alias("grp"), F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")
    empty = rows.where(F.size("tokens") == 0).select("grp", "id")
    twins = empty.select("grp", c("id").alias("a")).join(empty.select("grp", c("id").alias("b")), "grp").where("a < b").select("grp", "a", "b", F.lit(1.0).alias("similarity"))
    return found.unionByName(twins)


def pair_counts(rows: DataFrame, t: float) -> DataFrame:
    """``grp, n_pairs``: pairs of ids with similarity >= ``t``, counted without expanding copies.

    Ids of one token set are one row of a weight; copies count n (n - 1) / 2 and two similar sets the product of theirs.
    """
    sets = rows.where("id is not null and tokens is not null").select("grp", F.sort_array("tokens").alias("tokens")).withColumn("id", F.xxhash64("tokens"))
    sizes = materialize(sets.groupBy("grp", "id").agg(F.count("*").alias("n")), "sizes")
    own = sizes.where("n > 1").select("grp", F.expr("n * (n - 1) div 2").alias("k"))
    size = lambda x: sizes.select("grp", c("id").alias(x), c("n").alias(f"n{x}"))
    apart = similar_pairs(sets.where(F.size("tokens") > 0), t).join(size("a"), ["grp", "a"]).join(size("b"), ["grp", "b"]).select("grp", F.expr("na * nb").alias("k"))
    return own.unionByName(apart).groupBy("grp").agg(F.sum("k").alias("k"))


def duplicate_rate(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``grp, n, n_pairs, rate``: near-duplicate pairs over all pairs of a group; 0 for groups of one.

    ``pairs`` are those of :func:`similar_pairs`, or counts of :func:`pair_counts`.
    """
    n = rows.where("id is not null").groupBy("grp").agg(F.count("*").cast("bigint").alias("n"))
    p = pairs if "k" in pairs.columns else pairs.groupBy("grp").agg(F.count("*").alias("k"))
    j = n.join(p, "grp", "left").withColumn("n_pairs", F.coalesce("k", F.lit(0)).cast("bigint"))
    return j.select("grp", "n", "n_pairs", F.coalesce(F.try_divide(c("n_pairs").cast("double"), c("n") * (c("n") - 1) / 2), F.lit(0.0)).alias("rate"))
