"""Texts that lost their tail: a hashed logistic regression that trains itself on artificial cuts.

Statistics come from all rows: how often each source ends a field with a full stop, which short values are fillers, and
which lengths are limits (a length at which values without a full stop pile up against their neighbours). A bounded
sample of intact values is cut at random places to make positives; negatives are the values themselves and, so that
sources without final full stops are judged fairly, prefixes that end with a sentence whose full stop was taken away.
Features are the closing characters and words, crossed with the opening of the last sentence, the source's habit, the
distance to a limit, and whether a value is a filler. Every value of every row is scored by the model; the table is read
once for the endings and their statistics and once for the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.workspace import materialize

#: Buckets of the hashed features; the model's size is fixed by it.
DIMS = 1 << 18
#: Intact values, taken by smallest hash, from which the training examples are made.
TRAIN = 12_000
#: Characters of the ending that are looked at.
TAIL = 240
#: Share of rows with a final full stop from which a source counts as writing one.
HABIT = 0.5

MARKER = re.compile(r"(?:…|\.\.\.|\[(?:more|cont[^\]]*)\]?|\(cont(?:inued|\.|)\)?|�+)\s*$")
STOP = re.compile(r"[.!?。！？]+[\"'”’»)\]]*$")
BOUNDARY = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+")
#: The same test in Spark; a text that ends so ends with a sentence, unless a marker follows.
STOP_SQL = r"[.!?。！？]+[\"'”’»)\]]*\s*$"
MARKER_SQL = r"(…|\.\.\.|\[more\]|\(cont[^)]{0,8}\)?|�)\s*$"


def _h(*parts) -> int:
    return xxhash.xxh32_intdigest("\x1f".join(map(str, parts))) % DIMS


def features(tail: str, writes_stop: bool, at_limit: bool, filler: bool = False) -> list[int]:
    """Hashed features of an ending; a filler, or a value without a letter, has no other."""
    if filler or not any(map(str.isalpha, tail)):
        return [_h("bias"), _h("filler")]
    text = tail.rstrip()
    space = len(text) < len(tail)
    mark = MARKER.search(text)
    if mark:
        text = text[: mark.start()].rstrip()
    stop = STOP.search(text)
    last = text[-1:]
    kind = ("mark" if mark else "") + ("stop" if stop else "word" if last.isalnum() else "soft" if last in ",;:-–—(" else "other")
    out = [_h("bias"), _h("k", kind), _h("k", kind, space), _h("k", kind, writes_stop), _h("k", kind, at_limit), _h("k", kind, writes_stop, at_limit)]
    if stop and not mark:
        return out
    sentence = BOUNDARY.split(text)[-1]
    w = sentence.split()
    if stop or not w:
        return out
    w1, w2, w3 = w[-1], w[-2] if len(w) > 1 else "^", w[-3] if len(w) > 2 else "^"
    s = " ".join(w[:2]) if len(w) > 2 else "^"
    n = min(len(w), 30)
    out += [_h("w1", w1), _h("w21", w2, w1), _h("w2", w2), _h("w32", w3, w2), _h("sn", s, n), _h("sw1", s, w1), _h("sw2", s, w2), _h("sw32", s, w3, w2), _h("n", n), _h("e", w1[-3:]), _h("s0w2", w[0], w2, w1[-2:]), _h("cap", w1[:1].isupper(), s, w2)]
    return out


def examples(texts: list[str], seed: int = 5) -> tuple[list[list[int]], list[int]]:
    """Training examples from intact values."""
    rng = np.random.default_rng(seed)
    x, y = [], []

    def add(tail: str, writes: bool, limit: bool, label: int, filler: bool = False) -> None:
        x.append(features(tail[-TAIL:], writes, limit, filler))
        y.append(label)

    for text in texts:
        add(text, True, False, 0, True)
        add(text, True, rng.random() < 0.02, 0)
        add(text, False, rng.random() < 0.02, 0)
        ends = [m.start() for m in BOUNDARY.finditer(text)] + [len(text)]
        for end in rng.choice(ends, min(3, len(ends)), replace=False):
            bare = STOP.sub("", text[:end].rstrip())
            if len(bare) > 10:
                add(bare, False, rng.random() < 0.03, 0)
        for k in range(4):
            cut = int(rng.integers(max(8, len(text) // 8), len(text)))
            if k == 1:
                cut = text.rfind(" ", 0, cut)
            part = text[: max(cut, 1)]
            if STOP.search(part.rstrip()) or len(part) < 8:
                continue
            mark = rng.random()
            part += "" if mark > 0.12 else ("…", "...", " [more]", " (cont", "�")[int(rng.integers(5))]
            add(part, bool(k % 2 == 0), rng.random() < 0.4, 1)
    return x, y


def train(x: list[list[int]], y: list[int], epochs: int = 6, rate: float = 0.3, seed: int = 3) -> np.ndarray:
    """Weights by minibatch AdaGrad with a little shrinkage."""
    most = max(map(len, x), default=1)
    idx = np.full((len(x), most), DIMS, np.int64)  # the last bucket stays zero
    for i, f in enumerate(x):
        idx[i, : len(f)] = f
    target = np.array(y, np.float64)
    w, g2, rng = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-2), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 256):
            b = order[s : s + 256]
            p = 1 / (1 + np.exp(-np.clip(w[idx[b]].sum(1), -30, 30)))
            flat = idx[b].reshape(-1)
            u, inv = np.unique(flat, return_inverse=True)
            g = np.bincount(inv, np.repeat(p - target[b], most)) + 1e-5 * w[u]
            g2[u] += g * g
            w[u] -= rate * g / np.sqrt(g2[u])
            w[DIMS] = 0
    return w.astype(np.float32)


def _score(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(*r) for r in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6)), strict=True)]
            flat = np.array([f for r in rows for f in r], np.int64)
            starts = np.cumsum([0, *map(len, rows)])[:-1]
            z = np.add.reduceat(w[flat], starts) if len(rows) else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(z.astype(np.float64))], ["id", "source", "field", "score"])

    return run


def values(df: DataFrame, id: str, source: str, fields: dict[str, Column]) -> DataFrame:
    """``id, source, field, text``: one row per value that isn't null or blank."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c.alias("text")) for k, c in fields.items()])).alias("v")
    return df.select(F.col(id).cast("string").alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), each).select("id", "source", "v.field", "v.text").where("id is not null and length(trim(text)) > 0")


def scored(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``id, source, field, score, cut`` for every value of :func:`values`; ``cut`` says that the value lost its tail.

    Fillers (short values of one wording in at least three rows, or without a letter) aren't cut. A value that ends with
    a sentence isn't cut, nor is a text with an unusual but whole ending. A null source is a source of its own.
    """
    ending = lambda c: c.rlike(STOP_SQL) & ~c.rlike(MARKER_SQL)
    draw = F.xxhash64("id", "field")
    v = rows.select("id", "source", "field", F.length("text").alias("n"), F.right("text", F.lit(TAIL)).alias("tail")).withColumn("stop", ending(F.col("tail")))
    v = materialize(v.withColumn("low", F.when(F.col("n") < 40, F.lower(F.trim("tail")))), "endings")
    habit = v.groupBy("source").agg((F.avg(F.col("stop").cast("double")) >= HABIT).alias("writes"))
    short = v.where("n < 40").groupBy("low").agg(F.count_distinct("id", "field").alias("k")).where("k >= 3").select("low", F.lit(True).alias("filler"))
    tall = v.where("not stop").groupBy("source", "field", "n").agg(F.count("*").alias("c"))
    near = Window.partitionBy("source", "field").orderBy("n").rangeBetween(-12, 12)
    peaks = tall.withColumn("around", (F.sum("c").over(near) - F.col("c")) / 24.0).where("c >= 5 and c >= 4 * (around + 1)")
    limits = peaks.select("source", "field", F.explode(F.sequence(F.col("n") - 3, F.col("n"))).alias("n")).distinct().withColumn("limited", F.lit(True))
    intact = v.where("n >= 60 and stop").count()
    part = min(1_000_000, int(1_300_000 * TRAIN / max(1, intact)) + 1)  # so that no task sends more than its share to the driver
    sample = rows.where((F.length("text") >= 60) & (F.pmod(F.xxhash64(draw), F.lit(1_000_000)) <= part) & ending(F.right("text", F.lit(TAIL)))).select("text", draw.alias("h"))
    texts = [r[0] for r in sample.orderBy("h", "text").limit(TRAIN).select("text").collect()] if intact else []
    w = train(*examples(texts)) if texts else np.zeros(DIMS + 1, np.float32)
    known = v.join(habit, "source").join(limits, ["source", "field", "n"], "left").join(short, "low", "left")
    judged = known.select("id", "source", "field", "tail", "writes", F.coalesce("limited", F.lit(False)).alias("limited"), F.coalesce("filler", F.lit(False)).alias("filler"))
    return judged.mapInArrow(_score(w), "id string, source string, field string, score double").withColumn("cut", F.col("score") > threshold)


def cut_report(s: DataFrame) -> DataFrame:
    """Per source and field: values, cut values and their share; a repeated value counts once."""
    once = s.groupBy("id", "source", "field").agg(F.max("cut").alias("cut"))
    return once.groupBy("source", "field").agg(F.count("*").cast("bigint").alias("n_values"), F.count_if("cut").cast("bigint").alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))
