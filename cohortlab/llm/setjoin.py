"""Exact-verified similarity join of texts by their word sets, over hashed blocks of signature trees.

1. Each task turns its texts into records (hash of the text, bitmap, size) under block keys, one packed blob per target
   partition. Exact copies inside a task are one record; a text's words never travel. The number of partitions follows
   the size of the input, so that a partition's records stay near ``TARGET`` bytes however large the table is.
2. A partition joins its blocks by signature trees and gives pairs of text hashes that can reach the threshold. A block
   of more than ``HOT`` records (a phrase that very many texts share) isn't joined in one task: its texts are keyed anew
   by the words of their prefixes under a fixed order from rare to frequent, which is exact: two sets of similarity t
   share a word among the first n - ceil(t n) + 1 of each. A prefix block that is still too large is cut into chunks of
   records in tree order; pairs of chunks whose size ranges and OR-combined bitmaps allow a match are joined by tasks of
   their own (the uppermost level of a signature tree, spread over the cluster). So no task joins more than ``HOT`` records.
3. Only texts that occur in such a pair are fetched, once each, and compared word by word.
4. Pairs of texts become pairs of ids. Texts with very many copies may be linked through their first ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import sigtree
from cohortlab.llm.words import Memo, distinct, hashed, inside, mix, once, rolling, words
from cohortlab.workspace import drop, materialize, width

#: Texts, and characters, a task holds before it writes its blobs.
HELD, CHARS = 50_000, 64 << 20
#: Records of a block above which it is split by prefixes, and then by chunks.
HOT = 4096
#: Bytes of records that a partition should hold.
TARGET = 16 << 20
#: Copies of one text up to which all pairs of ids are given; see :func:`similar`.
COPIES = 1000
#: Texts from which frequent words and grams are learnt. They order keys and never decide whether a pair is found.
SAMPLE = 20_000
RECORD = np.dtype([("key", "<u4"), ("ref", "<i8"), ("bits", "<u8", (sigtree.WORDS,)), ("size", "<u4"), ("side", "i1")])

#: Gives block keys: (hashes of all words, offsets, distinct hashes, their offsets) -> (keys in a row, offsets).
Keyer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _pack(keyer: Keyer, partitions: int, min_words: int):
    """Input: ref, space, side, text. Output: part, blob."""

    def blobs(ref, space, side, texts, memo) -> Iterator[pa.RecordBatch]:
        flat, offsets = hashed(texts, memo)
        length = np.diff(offsets)
        enough = np.flatnonzero(length >= max(1, min_words))
        if not len(enough):
            return
        flat = flat[np.repeat(length >= max(1, min_words), length)]
        offsets = np.concatenate([[0], np.cumsum(length[enough])])
        ref, space, side = ref[enough], space[enough], side[enough]
        sets, bounds = distinct(flat, offsets)
        keys, ends = keyer(flat, offsets, sets, bounds)
        text = np.repeat(np.arange(len(ref)), np.diff(ends))
        keys = keys ^ (space[text].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        bits, size = sigtree.bitmaps(sets, bounds), np.diff(bounds)
        part = (keys % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        out = np.empty(len(keys), RECORD)
        t = text[order]
        out["key"], out["ref"], out["bits"], out["size"], out["side"] = (keys[order] >> np.uint64(32)).astype(np.uint32), ref[t], bits[t], size[t], side[t]
        edges = np.searchsorted(part[order], np.arange(partitions + 1))
        some = [p for p in range(partitions) if edges[p + 1] > edges[p]]
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([out[edges[p] : edges[p + 1]].tobytes() for p in some], pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, seen, chars = Memo(), [[], [], [], []], set(), 0
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                if row[0] not in seen:
                    seen.add(row[0])
                    chars += len(row[3])
                    for h, x in zip(held, row, strict=True):
                        h.append(x)
            if len(held[0]) >= HELD or chars > CHARS:
                yield from blobs(*(np.array(h, np.int64) for h in held[:3]), held[3], memo)
                held, seen, chars = [[], [], [], []], set(), 0
        if held[0]:
            yield from blobs(*(np.array(h, np.int64) for h in held[:3]), held[3], memo)

    return run


FOUND = "a bigint, b bigint, block bigint, i int, j int, blob binary"


def _found(**columns) -> pa.RecordBatch:
    """A batch of :data:`FOUND`; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    kinds = {"a": pa.int64(), "b": pa.int64(), "block": pa.int64(), "i": pa.int32(), "j": pa.int32(), "blob": pa.binary()}
    return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))


def _chunks(rows: np.ndarray, block: int, t: float, two_sides: bool, hot: int) -> Iterator[pa.RecordBatch]:
    """A block too large for one task: its chunks (block, i, blob), and the pairs of them that may match (block, i, j)."""
    rows = rows[np.lexsort((*rows["bits"].T, rows["size"], rows["side"]))]
    cuts = np.arange(0, len(rows), max(1, hot // 2))
    if two_sides:  # no chunk holds both sides
        cuts = np.unique(np.append(cuts, np.searchsorted(rows["side"], 1)))
        cuts = cuts[cuts < len(rows)]
    ends = np.append(cuts[1:], len(rows))
    for c in range(0, len(cuts), 100):
        some = range(c, min(len(cuts), c + 100))
        yield _found(block=[block] * len(some), i=list(some), blob=[rows[cuts[k] : ends[k]].tobytes() for k in some])
    r = sigtree.Records(rows["ref"], rows["bits"], rows["size"], rows["side"])
    top = sigtree.summary(r, cuts)
    side = rows["side"][cuts]
    for i in range(len(cuts)):
        j = np.arange(len(cuts)) if two_sides else np.arange(i, len(cuts))
        if two_sides:
            j = j[(side[j] == 1) & (side[i] == 0)]
        j = j[sigtree.reachable(top, top, np.full(len(j), i), j, t)]
        if len(j):
            yield _found(block=[block] * len(j), i=[i] * len(j), j=j)


def _ordered(r: sigtree.Records, pairs: Iterator[tuple[np.ndarray, np.ndarray]], two_sides: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of positions as pairs of refs: side 0 first, else the smaller first."""
    held, count = [], 0
    for i, j in pairs:
        if len(i):
            a, b = r.ref[i], r.ref[j]
            if two_sides:
                flip = r.side[i] > r.side[j]
                a, b = np.where(flip, b, a), np.where(flip, a, b)
            else:
                a, b = np.minimum(a, b), np.maximum(a, b)
            held.append((a, b))
            count += len(a)
        if count > 500_000:
            yield _pairs(held)
            held, count = [], 0
    if held:
        yield _pairs(held)


def _join(t: float, two_sides: bool, hot: int, anew: bool):
    """Input: part, blob. Output: :data:`FOUND`: pairs of texts, each once a partition.

    Of a block of more than ``hot`` records: its texts with a null ``b`` if they are to be keyed ``anew``, else chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, blobs = [], []
        for batch in batches:
            parts += batch.column(0).to_pylist()
            blobs += [np.frombuffer(x, RECORD) for x in batch.column(1).to_pylist()]
        if not blobs:
            return
        rows = np.concatenate(blobs)
        key = np.repeat(np.array(parts, np.uint64), [len(b) for b in blobs]) << np.uint64(32) | rows["key"].astype(np.uint64)
        blobs.clear()
        order = np.lexsort((rows["ref"], key))
        rows, key = rows[order], key[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (rows["ref"][1:] != rows["ref"][:-1]))
        rows, key = rows[fresh], key[fresh]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(starts, len(key)))
        size = np.repeat(n, n)
        if (size > hot).any():
            if anew:
                far = np.unique(rows["ref"][size > hot])
                yield _found(a=far)
            else:
                for s, m in zip(starts[n > hot], n[n > hot], strict=True):
                    yield from _chunks(rows[s : s + m], int(key[s].view(np.int64)), t, two_sides, hot)
        some = (size > 1) & (size <= hot)
        rows, key = rows[some], key[some]
        r = sigtree.Records(rows["ref"], rows["bits"], rows["size"], rows["side"])
        yield from _ordered(r, sigtree.block_pairs(key, r, t, two_sides), two_sides)

    return run


def _join_chunks(t: float, two_sides: bool):
    """Input: i, j, blob_i, blob_j. Output: :data:`FOUND` with pairs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = np.frombuffer(x, RECORD)
                rows = one if i == j else np.concatenate([one, np.frombuffer(y, RECORD)])
                r = sigtree.Records(rows["ref"], rows["bits"], rows["size"], rows["side"])
                left = sigtree.Tree(r, np.arange(len(one)))
                right = left if i == j else sigtree.Tree(r, np.arange(len(one), len(rows)))
                yield from _ordered(r, sigtree.dual(r, left, right, t), two_sides)

    return run


def _pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return _found(a=a[fresh], b=b[fresh])


def _verify(t: float, min_words: int, more: Callable | None):
    """Input: a, b, text_a, text_b. Output: a, b, similarity, and what ``more`` adds, for pairs that reach ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            cache: dict[str, tuple] = {}
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for z in (x, y):
                    if z not in cache:
                        w = words(z)
                        cache[z] = (w, frozenset(w))
                (wx, sx), (wy, sy) = cache[x], cache[y]
                if len(wx) < max(1, min_words) or len(wy) < max(1, min_words):
                    continue
                common = len(sx & sy)
                if common / (len(sx) + len(sy) - common) < t:
                    continue
                extra = more(wx, wy) if more else (None, None)
                for o, v in zip(out, (a, b, common / (len(sx) + len(sy) - common), *extra), strict=True):
                    o.append(v)
            yield pa.record_batch([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["a", "b", "similarity", "cover_a", "cover_b"])

    return run


def _texts(rows: DataFrame, refs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per wanted text: that of its smallest id, so that no key of the join holds the copies of a text."""
    owners = materialize(refs.join(groups.select("ref", F.col("first").alias("id")), "ref"), "owners")  # of known size: Spark may broadcast it
    return rows.join(owners, ["id", "ref"], "left_semi").dropDuplicates(["ref"])


def frequent(rows: DataFrame, grams: tuple[int, ...] = (1,), share: float = 0.0005, sample: int = SAMPLE) -> dict[int, dict[int, int]]:
    """For each length, hash to count of the word grams that at least a share of a bounded sample of texts holds.

    The result is bounded by ``1 / share`` times the words of a text, whatever the size of the table.
    """
    total = max(1, rows.count())
    some = rows.where(F.pmod(F.xxhash64("ref", F.lit(1)), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, sample / total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            flat, offsets = hashed(batch.column(0).to_pylist(), memo)
            for g in grams:
                values = rolling(flat, g) if g > 1 else flat
                ok, text = inside(offsets, g, len(values))
                values, _ = once(values[ok], text[ok])
                h, n = np.unique(values, return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(h), g)), pa.array(h.astype(np.int64)), pa.array(n)], ["g", "h", "n"])

    counts = some.select("text").mapInArrow(run, "g bigint, h bigint, n bigint").groupBy("g", "h").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {g: {} for g in grams}
    for r in counts.where(F.col("n") >= max(3, int(share * min(total, sample)))).collect():
        out[r[0]][r[1] & (1 << 64) - 1] = r[2]
    return out


def prefix_keyer(t: float, order: dict[int, int]) -> Keyer:
    """Keys of the rarest words of each set, as many as two sets of similarity ``t`` must have one in common."""
    known = np.array(sorted(order), np.uint64)
    counts = np.array([order[int(k)] for k in known], np.int64)

    def keyer(flat: np.ndarray, offsets: np.ndarray, sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        df = np.zeros(len(sets), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, sets), len(known) - 1)
            df = np.where(known[at] == sets, counts[at], 0)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        by = np.lexsort((sets, df, text))
        place = np.arange(len(sets)) - bounds[:-1][text]
        size = np.diff(bounds)
        keep = place < (size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)[text]
        return mix(sets[by][keep]), np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(size)))]).astype(np.int64)

    return keyer


def _bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a table; it decides numbers of partitions only."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0  # no estimate


def _matched(rows: DataFrame, t: float, keyer: Keyer, min_words: int, two_sides: bool, more: Callable | None, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified pairs of text hashes (in a self-join each text with copies is paired with itself), ids of each text, texts with their numbers of ids."""
    spark = rows.sparkSession
    parts = max(width(spark), 4 * _bytes(rows) // TARGET)
    rows = rows.where("id is not null and length(text) > 0").withColumn("side", F.col("side").cast("tinyint"))
    rows = rows.withColumn("ref", F.xxhash64("space", "side", "text")).withColumn("room", F.xxhash64("space"))

    def joined(some: DataFrame, keys: Keyer, anew: bool) -> DataFrame:
        blobs = some.select("ref", "room", F.col("side").cast("bigint"), "text").mapInArrow(_pack(keys, parts, min_words), "part int, blob binary")
        return blobs.repartitionById(parts, "part").mapInArrow(_join(t, two_sides, hot, anew), FOUND).distinct()

    found = materialize(joined(rows, keyer, True), "found")
    members = materialize(rows.select("ref", "id", "space", "side", F.hash("text").alias("check")).distinct(), "members")
    groups = members.groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.first("space").alias("space"))
    pairs = found.where("b is not null").select("a", "b")
    far = found.where("b is null").select(F.col("a").alias("ref"))
    if far.limit(1).count():
        order = frequent(rows)[1]
        second = materialize(joined(_texts(rows, far, groups), prefix_keyer(t, order), False), "split")
        chunks = second.where("blob is not null")
        at = lambda x: chunks.select("block", F.col("i").alias(x), F.col("blob").alias(f"blob_{x}"))
        tiles = second.where("j is not null").select("block", "i", "j").join(at("i"), ["block", "i"]).join(at("j"), ["block", "j"])
        tiled = tiles.select("i", "j", "blob_i", "blob_j").mapInArrow(_join_chunks(t, two_sides), FOUND)
        pairs = pairs.unionByName(second.where("b is not null").select("a", "b")).unionByName(tiled.select("a", "b")).distinct()
    if not two_sides:
        copies = groups.where("n > 1").select(F.col("ref").alias("a"), F.col("ref").alias("b"))
        pairs = pairs.unionByName(copies)
    pairs = materialize(pairs, "pairs")
    drop(found)
    needed = pairs.select(F.col("a").alias("ref")).union(pairs.select("b")).distinct()
    texts = materialize(_texts(rows, needed, groups).select("ref", "text"), "texts")
    both = pairs.join(texts.select(F.col("ref").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("ref").alias("b"), F.col("text").alias("text_b")), "b")
    good = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(t, min_words, more), "a bigint, b bigint, similarity double, cover_a double, cover_b double"), "good")
    drop(texts), drop(pairs)
    return good, members, groups


def similar(rows: DataFrame, t: float, keyer: Keyer, *, min_words: int = 1, two_sides: bool = False, more: Callable | None = None, copies: int | None = COPIES, hot: int = HOT) -> DataFrame:
    """``id_a, id_b, space, similarity, cover_a, cover_b, link``: ids whose texts have similarity >= ``t``.

    ``rows`` has ``id`` (string), ``space`` (string; only texts of one space are compared), ``side`` (0 or 1) and
    ``text``. Self-join: the smaller id first. Two sides: side 0 first.

    Every pair of ids is given (``link`` is ``pair``), but for texts of more than ``copies`` ids, whose pairs would grow
    as the square of the rows: each of these ids is linked to the first id of its own text and of every similar text,
    however many these are, and the first id to every id of the similar texts (``link`` is ``first``). No link between
    different texts is lost, and the ids left out are copies of the first. ``copies=None`` gives all pairs of ids.

    Null ids and texts, and texts of fewer than ``min_words`` words or none, match nothing; repeated rows count once. Two
    ids that are similar by several texts give one row, of the highest similarity.
    """
    good, members, groups = _matched(rows, t, keyer, min_words, two_sides, more, hot)
    side = lambda x: groups.select(F.col("ref").alias(x), F.col("n").alias(f"n{x}"), F.col("first").alias(f"f{x}"), *(["space"] if x == "a" else []))
    g = good.join(side("a"), "a").join(side("b"), "b")
    small = F.lit(True) if copies is None else (F.col("na") <= copies) & (F.col("nb") <= copies)
    m = lambda x, y: members.select(F.col("ref").alias(x), F.col("id").alias(y))
    rest = ["space", "similarity", "cover_a", "cover_b"]
    out = g.where(small).join(m("a", "ia"), "a").join(m("b", "ib"), "b").select("ia", "ib", *rest, F.lit("pair").alias("link"))
    if copies is not None:  # the first id of a text with many copies stands for them
        left = g.where(~small).join(m("a", "ia"), "a").select("ia", F.col("fb").alias("ib"), *rest)
        right = g.where(~small).join(m("b", "ib"), "b").select(F.col("fa").alias("ia"), "ib", *rest)
        out = out.unionByName(left.unionByName(right).withColumn("link", F.lit("first")))
    out = out.where("ia <> ib")
    if not two_sides:
        flip = F.col("ia") > F.col("ib")
        out = out.select(F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib"), "space", "similarity", F.when(flip, F.col("cover_b")).otherwise(F.col("cover_a")).alias("cover_a"), F.when(flip, F.col("cover_a")).otherwise(F.col("cover_b")).alias("cover_b"), "link")
    best = out.groupBy("ia", "ib", "space").agg(F.max(F.struct("similarity", "cover_a", "cover_b", "link")).alias("r"))
    return best.select(F.col("ia").alias("id_a"), F.col("ib").alias("id_b"), "space", "r.*")


def profiles(rows: DataFrame, t: float, keyer: Keyer, *, min_words: int = 1, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``space, id, profile`` of all ids with a similar id, and ``p, q`` (p <= q): profiles whose ids are similar.

    Ids with the same texts have one profile, so pairs of ids can be counted in full from pairs of profiles and numbers
    of ids, and copies are never multiplied. ``p = q`` stands for the pairs of ids of one profile.
    """
    good, members, _ = _matched(rows, t, keyer, min_words, False, None, hot)
    linked = good.select(F.col("a").alias("ref")).union(good.select("b")).distinct()
    own = members.join(linked, "ref", "left_semi").groupBy("space", "id").agg(F.sort_array(F.collect_set("ref")).alias("refs"))  # the texts of one id
    own = materialize(own.select("space", "id", "refs", F.xxhash64("refs").alias("profile")), "profiles")
    held = own.select("profile", F.explode("refs").alias("ref")).distinct()
    of = lambda x, y: held.select(F.col("ref").alias(x), F.col("profile").alias(y))
    pairs = good.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).distinct()
    return own.select("space", "id", "profile"), materialize(pairs, "similar")
