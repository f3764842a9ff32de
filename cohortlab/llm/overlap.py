"""Same or nearly same records across splits: winnowed fingerprints, chained seeds and alignment.

Every record keeps the minima of its rolling word-gram hashes over sliding windows, so two records that share a run of
``GRAM + WINDOW - 1`` words share a fingerprint. Grams that are frequent in a bounded sample come last in the order of
the minima, so a window is rarely represented by a stock phrase; the order is the same for all records.

Records whose words were put into another order share no such run, nor do very densely edited ones. They are met by a
second family of keys, the rarest words of each record, which is exact: two sets of similarity t share one of the first
n - ceil(t n) + 1 words in any order. Records of both sides meet in the blocks of their keys, where pairs that can't
reach the similarity are dropped by bitmap and size; a key that very many records share is thus no product of its sides.
For the pairs found all common grams are chained in one order, the chain is extended word by word, and the covered part
of each record is reported (``cover=True``; the similarity doesn't need it).
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import setjoin
from cohortlab.llm.words import inside, mix, once, rolling

GRAM, WINDOW = 3, 8
#: Highest bit of a gram hash, set for frequent grams: they are chosen only where a window has no other.
COMMON = np.uint64(1 << 63)
#: Keeps keys of words apart from fingerprints of grams.
PREFIX = np.uint64(0xA0761D6478BD642F)


def winnow_keyer(common: dict[int, int], order: dict[int, int], t: float):
    """Keyer of the minima of each window of ``WINDOW`` word grams, and of the prefix words for ``t``.

    ``common`` and ``order`` are counts of grams and of words in a sample. A text too short for a window has all its grams.
    """
    prefix = setjoin.prefix_keyer(t, order)
    known = np.array(sorted(common), np.uint64)

    def ranked(grams: np.ndarray) -> np.ndarray:
        out = grams & ~COMMON
        if len(known):
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            out = np.where(known[at] == grams, out | COMMON, out)
        return out

    def keyer(flat: np.ndarray, offsets: np.ndarray, sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        low = ranked(rolling(flat, GRAM))
        wide = len(low) - WINDOW + 1
        keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if wide > 0:
            m = low[:wide].copy()
            for k in range(1, WINDOW):
                m = np.minimum(m, low[k : k + wide])
            full, who = inside(offsets, GRAM + WINDOW - 1, wide)
            keys.append(m[full]), owner.append(who[full])
        lengths = np.diff(offsets)
        for i in np.flatnonzero(lengths < GRAM + WINDOW - 1):
            s, e = offsets[i], offsets[i + 1]
            own = ranked(rolling(flat[s:e], min(GRAM, e - s)))
            keys.append(own), owner.append(np.full(len(own), i))
        words, ends = prefix(flat, offsets, sets, bounds)
        keys.append(words ^ PREFIX), owner.append(np.repeat(np.arange(n), np.diff(ends)))
        k, o = once(np.concatenate(keys), np.concatenate(owner))
        return mix(k), np.concatenate([[0], np.cumsum(np.bincount(o, minlength=n))]).astype(np.int64)

    return keyer


def chain(a: list[str], b: list[str], gram: int = GRAM) -> tuple[float, float]:
    """Share of each record that lies in the best chain of common grams, extended by alignment."""
    at: dict[tuple, list[int]] = {}
    for j in range(len(b) - gram + 1):
        at.setdefault(tuple(b[j : j + gram]), []).append(j)
    seeds = [(i, j) for i in range(len(a) - gram + 1) for j in sorted(at.get(tuple(a[i : i + gram]), ()), reverse=True)]
    # Longest strictly increasing chain in both places.
    tails: list[int] = []
    link: list[int] = []
    ends: list[int] = []
    for k, (_, j) in enumerate(seeds):
        p = bisect_left(tails, j)
        link.append(ends[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j), ends.append(k)
        else:
            tails[p], ends[p] = j, k
    ca, cb = [False] * len(a), [False] * len(b)
    k = ends[-1] if ends else -1
    path = []
    while k >= 0:
        path.append(seeds[k])
        k = link[k]
    for i, j in path:
        for d in range(gram):
            ca[i + d] = cb[j + d] = True
    # Extend each chained run to both sides while the words agree and neither side runs into another run.
    for i, j in path:
        x, y = i - 1, j - 1
        while x >= 0 and y >= 0 and not ca[x] and not cb[y] and a[x] == b[y]:
            ca[x] = cb[y] = True
            x, y = x - 1, y - 1
        x, y = i + gram, j + gram
        while x < len(a) and y < len(b) and not ca[x] and not cb[y] and a[x] == b[y]:
            ca[x] = cb[y] = True
            x, y = x + 1, y + 1
    return sum(ca) / max(1, len(a)), sum(cb) / max(1, len(b))


def across(df: DataFrame, id: str, text: str, split: str, train: str = "train", held: tuple[str, ...] = ("validation", "test"), t: float = 0.75, cover: bool = True, copies: int | None = setjoin.COPIES) -> DataFrame:
    """``id_train, id_held, similarity, cover_train, cover_held, link`` for records of the two sides with similarity >= ``t``.

    Splits are compared without outer blanks and case; records of no named split, null ids and texts without a word take
    no part; repeated rows count once; an empty side gives an empty result. ``copies`` and ``link`` are those of
    :func:`setjoin.similar`; without ``cover`` no chain is built and the covers are null.
    """
    s = F.lower(F.trim(split))
    rows = df.select(F.col(id).cast("string").alias("id"), F.lit("").alias("space"), F.when(s == train, 0).when(s.isin(*held), 1).alias("side"), F.col(text).alias("text")).where("side is not null")
    known = setjoin.frequent(rows.where("length(text) > 0").withColumn("ref", F.xxhash64("text")), (1, GRAM))
    out = setjoin.similar(rows, t, winnow_keyer(known[GRAM], known[1], t), two_sides=True, more=chain if cover else None, copies=copies)
    return out.select(F.col("id_a").alias("id_train"), F.col("id_b").alias("id_held"), "similarity", F.col("cover_a").alias("cover_train"), F.col("cover_b").alias("cover_held"), "link")


def overlap_report(df: DataFrame, found: DataFrame, id: str, split: str, source: str, cover: bool = True) -> DataFrame:
    """Per split and source: held-out records, those that occur in train, their share and, with ``cover``, mean coverage."""
    s = F.lower(F.trim(split))
    items = df.select(F.col(id).cast("string").alias("id"), s.alias("split"), F.col(source).alias("source")).where(s.isin("validation", "test")).groupBy("id").agg(F.min(F.struct("split", "source")).alias("r")).select("id", "r.*")
    best = found.groupBy(F.col("id_held").alias("id")).agg(F.max("cover_held").alias("cover"), F.lit(1).alias("hit"))
    out = items.join(best, "id", "left").groupBy("split", "source").agg(
        F.count("*").cast("bigint").alias("n_items"), F.count("hit").cast("bigint").alias("n_overlapping"), F.round(F.count("hit") / F.count("*"), 6).alias("share"), F.round(F.avg("cover"), 6).alias("mean_cover")
    )
    return out if cover else out.drop("mean_cover")
