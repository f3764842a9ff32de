"""One consistent form for texts that look the same.

A transducer over grapheme clusters is compiled once: a table maps every single character that needs it (other widths
and styles, joined letters, other spaces, invisible characters, look-alike letters, singleton accents), and one compiled
pattern over character classes, leftmost and greedy, takes the longest cluster at each place that either holds such a
character or a base with separate marks. A text is rewritten in one pass; a text without such places is returned as it
is after one scan. Compiling checks that no character gets two images and that every image is in its final form, so the
rewriting is idempotent.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.workspace import materialize

#: Characters that are drawn like a Latin letter or an ASCII mark, by script, as in Unicode's public table
#: of confusable characters. What Unicode's own data say (styled mathematical letters and digits, widths, joined letters,
#: Roman numerals) isn't listed but derived in ``_rules``.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ԍ": "G",
}
GREEK = {
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v", "ρ": "p", "α": "a", "ι": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ϻ": "M",
}
ARMENIAN = {"օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ո": "n", "Ս": "U", "Օ": "O", "Տ": "S"}
CHEROKEE = {"Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B"}
COPTIC = {"ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X"}
LISU = {
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H",
    "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
LATIN = {"ɡ": "g", "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "𐐄": "O", "𐐬": "o", "𐐕": "C", "𐐽": "c"}
MARKS = {"\u2010": "-", "\u2011": "-", "\u02bc": "\u2019", "\u2024": ".", "\u2236": ":", "\ua789": ":", "\u01c3": "!"}
ALIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC | LISU | LATIN | MARKS
#: Joined Latin letters, by range: ligatures, digraphs and Roman numerals.
JOINED = ((0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F))
#: Format characters that are drawn.
DRAWN = {*map(chr, range(0x600, 0x606)), "۝", "܏", "࢐", "࢑", "࣢", "\U000110bd", "\U000110cd"}
#: Invisible though no format characters: joiner of marks, fillers, variation selectors.
UNSEEN = {"͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ", *map(chr, range(0x180B, 0x180E)), *map(chr, range(0xFE00, 0xFE10))}

#: Ids of one form up to which all pairs are given, and ids of a larger one that are paired in one group.
COPIES, BLOCK = 1000, 1024


class Conflict(ValueError):
    """Two rules give one character different images, or an image isn't in its final form."""


def _rules() -> dict[str, str]:
    table: dict[str, str] = {}

    def rule(key: str, image: str) -> None:
        if table.setdefault(key, image) != image:
            raise Conflict(f"U+{ord(key):04X}: {table[key]!r} or {image!r}")

    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if c in UNSEEN or (kind == "Cf" and c not in DRAWN):
            rule(c, "")
        elif kind == "Zs" and c not in "  ":
            rule(c, " ")
        else:
            tag = unicodedata.decomposition(c).split(" ", 1)[0]
            plain = unicodedata.normalize("NFKC", c)
            if tag in ("<wide>", "<narrow>") or any(a <= code <= b for a, b in JOINED) and plain != c or tag == "<font>" and len(plain) == 1 and plain.isalnum():
                rule(c, plain)
    for c, image in ALIKE.items():
        rule(c, image)
    return table


class Transducer:
    """Rewrites texts; see the module's head."""

    def __init__(self) -> None:
        base = _rules()
        base = {k: "".join(base.get(x, x) for x in v) for k, v in base.items()}
        self.base = base
        single, marks = dict(base), []
        for code in range(sys.maxunicode + 1):
            if 0xD800 <= code < 0xE000:
                continue
            c = chr(code)
            if unicodedata.combining(c):
                marks.append(c)
            elif c not in base and unicodedata.decomposition(c) and (to := self._compose(c)) != c:
                single[c] = to
        for c, image in single.items():
            if any(x in single for x in image):
                raise Conflict(f"U+{ord(c):04X}: image {image!r} isn't final")
        marks += [x for x, y in base.items() if y and all(map(unicodedata.combining, y))]  # marks of another width
        unseen = _either(x for x, y in base.items() if not y)
        mark = _either(marks)
        special = _either(x for x in single if not unicodedata.combining(x))
        self.single = single
        jamo = "\u1100-\u11ff\uffa1-\uffdc"  # parts of syllables, of either width
        self.need = re.compile(f"{special}|{mark}|[\r{jamo}]")
        self.cluster = re.compile(f"\r\n?|(?=[\uac00-\ud7a3{jamo}]|{unseen})[\uac00-\ud7a3]?{unseen}*[{jamo}](?:[{jamo}]|{unseen})*|(?!{mark}|{unseen}|[\r\n])(?s:.){unseen}*(?:{mark}{unseen}*)+|{special}")
        self.memo: dict[str, str] = {"\r\n": "\n", "\r": "\n"}

    def _compose(self, cluster: str) -> str:
        """The image of a cluster: unseen parts out, bases mapped, marks in canonical order and joined to the base."""
        parts = unicodedata.normalize("NFD", "".join(self.base.get(c, c) for c in cluster))
        return unicodedata.normalize("NFC", "".join(self.base.get(c, c) for c in parts))

    def _image(self, m: re.Match) -> str:
        c = m.group()
        to = self.memo.get(c)
        if to is None:
            to = self.single.get(c)
            if to is None:
                to = self._compose(c)
            if len(self.memo) < 100_000:
                self.memo[c] = to
        return to

    def __call__(self, text: str) -> str:
        if (text.isascii() and "\r" not in text) or not self.need.search(text):
            return text
        return self.cluster.sub(self._image, text)


def _class(chars) -> str:
    """Inside of a character class, as ranges."""
    codes = sorted({ord(c) for c in chars})
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08x}-\\U{codes[j]:08x}" if j > i else f"\\U{codes[i]:08x}")
        i = j + 1
    return "".join(out)


def _either(chars) -> str:
    """A pattern for one of some characters. Those beyond the basic plane are looked at only there: they are many ranges."""
    chars = set(chars)
    far = {c for c in chars if ord(c) > 0xFFFF}
    near = f"[{_class(chars - far)}]"
    return f"(?:{near}|(?=[\U00010000-\U0010ffff])[{_class(far)}])" if far else near


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def _rewriter(out_text: bool):
    form = transducer()  # compiled here and sent along, not once a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            forms = [None if t is None else form(t) for t in texts]
            if out_text:
                yield pa.record_batch([ids, pa.array(forms, pa.string()), pa.array([None if t is None else t != f for t, f in zip(texts, forms, strict=True)], pa.bool_())], ["id", "form", "changed"])
            else:
                digest = [None if t is None else blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in forms]
                raw = [d if t is None or t == f else blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t, f, d in zip(texts, forms, digest, strict=True)]
                yield pa.record_batch([ids, pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["id", "class", "raw"])

    return run


def consistent(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id, form, changed``: every row's text in its consistent form, in one pass without a shuffle.

    Null stays null with ``changed`` null; empty stays empty; repeated rows stay repeated; other columns are ignored.
    """
    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(_rewriter(True), f"id {kind}, form string, changed boolean").withColumnRenamed("id", id)


def classes(df: DataFrame, id: str, text: str) -> DataFrame:
    """``id, class, raw``: 128-bit hashes of each text's consistent form and of its characters. Null and empty texts are left out."""
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null and length(text) > 0")
    return rows.mapInArrow(_rewriter(False), f"id {kind}, class binary, raw binary")


def alike(df: DataFrame, id: str, text: str, copies: int | None = COPIES) -> DataFrame:
    """``id_a, id_b, link`` (smaller id first): texts of one form that differ in their characters.

    Every pair of ids with different texts is given (``link`` is ``pair``), but in a form of more than ``copies`` ids,
    whose pairs of copies would grow as the square of the rows: there each id is paired with the smallest id of each
    *other* text, however many these are (``link`` is ``first``). So only pairs of a copy with a copy are left out, and
    ids of texts without copies give every pair. ``copies=None`` gives all pairs. A large form's ids are taken in blocks
    of about ``BLOCK``, so that no task holds the pairs of a whole form. Exact copies are no pair, nor is one id with two
    texts; a repeated (id, text) counts once; null ids, null and empty texts match nothing.
    """
    rows = materialize(classes(df, id, text).distinct(), "forms")  # read several times below, rewritten once
    texts = rows.groupBy("class", "raw").agg(F.min("id").alias("first"), F.count("id").alias("n"))
    heads = texts.groupBy("class").agg(F.count("*").alias("texts"), F.sum("n").alias("ids")).where("texts > 1")
    few = F.lit(True) if copies is None else F.col("ids") <= copies
    small = rows.join(heads, "class").where(few)
    out = small.select("class", "raw", F.col("id").alias("a")).join(small.select("class", F.col("raw").alias("raw_b"), F.col("id").alias("b")), "class").where("raw <> raw_b and a < b").select("a", "b", F.lit("pair").alias("link"))
    if copies is not None:
        wide = heads.where(~few).select("class", F.ceil(F.col("ids") / BLOCK).cast("int").alias("blocks"))
        large = rows.join(wide, "class").select("class", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "raw", F.col("id").alias("a"))
        other = texts.join(wide, "class").select("class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("raw").alias("raw_b"), F.col("first").alias("b"))
        rest = large.join(other, ["class", "block"]).where("raw <> raw_b and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("first").alias("link"))
        out = out.unionByName(rest)
    return out.groupBy("a", "b").agg(F.max("link").alias("link")).select(F.col("a").alias(f"{id}_a"), F.col("b").alias(f"{id}_b"), "link")


def report(df: DataFrame, id: str, text: str, by: str) -> DataFrame:
    """Per value of ``by``: texts, texts that the consistent form changes, and distinct texts before and after."""
    kind = df.schema[id].dataType.simpleString()
    by_kind = df.schema[by].dataType.simpleString()
    inner = _rewriter(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = next(inner(iter([batch.select([0, 1])])))
            yield pa.record_batch([batch.column(2), out.column(1), out.column(2)], ["by", "class", "raw"])

    rows = df.select(F.col(id).cast(kind).alias("id"), F.col(text).alias("text"), F.col(by).alias("by")).where("text is not null").mapInArrow(run, f"by {by_kind}, class binary, raw binary")
    texts = rows.groupBy("by", "class", "raw").agg(F.count("*").alias("n"))
    forms = texts.groupBy("by", "class").agg(F.sum("n").alias("n"), F.count("*").alias("raw_texts"), F.sum(F.when(F.col("class") != F.col("raw"), F.col("n")).otherwise(0)).alias("changed"))
    return forms.groupBy("by").agg(F.sum("n").cast("bigint").alias("n_texts"), F.sum("changed").cast("bigint").alias("n_changed"), F.sum("raw_texts").cast("bigint").alias("n_distinct_before"), F.count("*").cast("bigint").alias("n_distinct_after")).withColumnRenamed("by", by)


