"""Held-out passages inside a corpus, by MinHash over windows of one size and exact shingles.

Whole-document MinHash can't see a short passage in a long text: the Jaccard similarity vanishes as the text grows. So
both sides are partitioned into windows of one size, ``span`` words. A text that contains a passage of ``span`` words
contains a window whose shingle set equals the passage's; containment has become equality, on which any MinHash agrees
with certainty. A text keeps the minima of its windows (about ``2 / (span - shingle + 2)`` of its words), and only
windows whose minimum may be one of an item's are compared. Texts shorter than ``span`` words are pruned by size.

The corpus is read once, whatever the number of items. The items' windows are a distributed table. What goes to the
tasks is a Bloom filter of the items' minima, of at most ``bits`` bits, built in Spark; a text sends on the 128-bit
hashes of the windows that pass it, and these are joined with the items' windows. A false hit of the filter costs a row,
never a result, and no true window is ever stopped by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.lookalike import transducer
from cohortlab.llm.words import MULTIPLIER, Memo, hashed, inside, mix, rolling
from cohortlab.workspace import materialize


def window_minima(flat: np.ndarray, span: int, shingle: int) -> np.ndarray:
    """Smallest shingle hash of every window of ``span`` words."""
    s = rolling(flat, shingle)
    n = len(flat) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low, size, want = s.copy(), 1, span - shingle + 1
    while size * 2 <= want:  # minima over windows that double
        low[: len(low) - size] = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = want - size
    return np.minimum(low[:n], low[rest : rest + n])


#: Bits of the filter at most (32 MB), and for each minimum.
BITS, EACH = 1 << 28, 1 << 10
#: Multiplier of the second hash of a window.
SECOND = np.uint64(0xD1342543DE82EF95)


def _grams(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row of word hashes."""
    one, two = np.zeros(len(windows), np.uint64), np.full(len(windows), SECOND)
    for k in range(windows.shape[1]):
        one = one * MULTIPLIER + windows[:, k]
        two = mix(two ^ windows[:, k]) * SECOND
    return mix(one).view(np.int64), two.view(np.int64)


def _item_windows(span: int, shingle: int):
    """Input: item, text. Output: item, low, gram, check: one row per window of an item."""
    form = transducer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            flat, offsets = hashed(batch.column(1).to_pylist(), memo, form)
            low = window_minima(flat, span, shingle)
            ok, text = inside(offsets, span, len(low))
            at = np.flatnonzero(ok)
            if len(at):
                gram, check = _grams(flat[at[:, None] + np.arange(span)])
                yield pa.record_batch([batch.column(0).take(pa.array(text[at])), pa.array(low[at].view(np.int64)), pa.array(gram), pa.array(check)], ["item", "low", "gram", "check"])

    return run


def _places(low, m: int):
    """The two places of a minimum in a filter of ``m`` bits, from 1."""
    return F.pmod(low, F.lit(m)) + 1, F.pmod(F.shiftrightunsigned(low, 33), F.lit(m)) + 1


def _filter(windows: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of the minima as bytes; Spark builds it in pieces of 4 KB."""
    lows = windows.select("low").distinct()
    n = lows.count()
    m = 1 << 15
    while m < min(bits, EACH * n):
        m *= 2
    place = lows.select(F.explode(F.array(*_places(F.col("low"), m))).alias("p"))
    out = np.zeros(m // 8, np.uint8)
    for piece, part in place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p"))).collect():
        out[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(part, np.uint8)
    return out


def _passes(filter: np.ndarray, low: np.ndarray) -> np.ndarray:
    mask = np.uint64(8 * len(filter) - 1)
    out = np.ones(len(low), bool)
    for place in (low & mask, (low >> np.uint64(33)) & mask):
        out &= (filter[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _search(filter: np.ndarray, span: int, shingle: int):
    """Input: doc, text. Output: doc, gram, check of the windows that may be an item's, once a text."""
    form = transducer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            flat, offsets = hashed(batch.column(1).to_pylist(), memo, form)
            low = window_minima(flat, span, shingle)
            ok, text = inside(offsets, span, len(low))
            fresh = np.ones(len(low), bool)
            fresh[1:] = low[1:] != low[:-1]
            starts = np.flatnonzero(fresh)
            hit = np.repeat(_passes(filter, low[starts]), np.diff(np.append(starts, len(low)))) & ok
            at = np.flatnonzero(hit)
            if len(at):
                gram, check = _grams(flat[at[:, None] + np.arange(span)])
                yield pa.record_batch([batch.column(0).take(pa.array(text[at])), pa.array(gram), pa.array(check)], ["doc", "gram", "check"])

    return run


def contains(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, *, span: int = 13, shingle: int = 5, bits: int = BITS) -> DataFrame:
    """``doc, item, windows``: texts that hold at least ``span`` consecutive words of an item, as a reader sees them.

    ``windows`` counts the different windows of the item that the document holds (a passage of ``span`` words is one).
    Case, punctuation, line breaks and look-alike characters don't matter. Null ids, null and empty texts, and texts or
    items of fewer than ``span`` words match nothing. Repeated rows count once. No items: an empty result.
    """
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc is not null and length(text) > 0")
    wanted = items.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null and length(text) > 0").distinct()
    windows = materialize(wanted.mapInArrow(_item_windows(span, shingle), "item bigint, low bigint, gram bigint, check bigint").distinct(), "windows")
    hits = rows.mapInArrow(_search(_filter(windows, bits), span, shingle), f"doc {kind}, gram bigint, check bigint").distinct()
    found = hits.join(windows.select("item", "gram", "check"), ["gram", "check"]).select("doc", "item", "gram").distinct()
    return found.groupBy("doc", "item").agg(F.count("*").alias("windows")).select(F.col("doc").alias(doc), F.col("item").alias(item), "windows")


def leak_report(found: DataFrame, docs: DataFrame, doc: str, source: str, item: str) -> DataFrame:
    """Per item and source: number of texts that leak it and the longest leak in windows."""
    return found.join(docs.select(F.col(doc), F.col(source)), doc).groupBy(item, source).agg(F.countDistinct(doc).cast("bigint").alias("n_docs"), F.max("windows").cast("bigint").alias("most_windows"))
