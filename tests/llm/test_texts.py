import random
import unicodedata

import pytest
from cohortlab.llm import leakage, lookalike
from cohortlab.llm.lookalike import transducer
from cohortlab.llm.words import words


@pytest.fixture(scope="module")
def form():
    return transducer()


@pytest.mark.parametrize(
    ("a", "b"),
    [("café", "café"), ("ｆｕｌｌ１２", "full12"), ("ﬁne ﬂow oﬃce", "fine flow office"), ("a b c d", "a b c d"), ("z​e‌r‍o­﻿", "zero"), ("раѕѕ", "pass"), ("Αlpha Οmega", "Alpha Omega"), ("ї", "ï"), ("ï", "ï"), ("е​́", "é"), ("a\r\nb", "a\nb"), ("Å", "Å"), ("한", "한"), ("ạ̇", "ạ̇")],
)
def test_alike(form, a, b):
    assert form(a) == form(b) and form(form(a)) == form(a)


@pytest.mark.parametrize(("a", "b"), [("cafe", "café"), ("Word", "word"), ("a b", "a  b"), ("a!", "a"), ("naïve", "naive"), ("1", "l"), ("a\nb", "a b"), ("œ", "oe"), ("x²", "x2")])
def test_different(form, a, b):
    assert form(a) != form(b)


def test_styled_letters_by_name(form):
    """Independent of decompositions: what the names of the mathematical letters and digits say."""
    digits = dict(zip("ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split(), "0123456789", strict=True))
    n = 0
    for code in range(0x1D400, 0x1D800):
        name = unicodedata.name(chr(code), "").split()
        if name[:1] == ["MATHEMATICAL"] and name[-2] in ("CAPITAL", "SMALL") and len(name[-1]) == 1:
            assert form(chr(code)) == (name[-1] if name[-2] == "CAPITAL" else name[-1].lower())
            n += 1
        elif name[:1] == ["MATHEMATICAL"] and name[-1] in digits:
            assert form(chr(code)) == digits[name[-1]]
            n += 1
    assert n > 650


@pytest.mark.parametrize("pair", "13AAA 13B1L? 13A0D 13C3Z 13CCG? 13E2P 13DAS 13D9V 13DEL 13DFC 13F4B A4EEA A4F3O A4EBX A4DDF A4E3R 2C9Eo? 2C9FO? 2C9EO 2C9Fo 2CA2P 0578n 04C0I 03FAM 1D04c 1D0Fo 1D20v A731s 2163V? 2164V 216FM 217Cl".split())
def test_other_scripts(form, pair):
    """Typed by code point from the public table of confusable characters; a question mark says that the two differ."""
    same = not pair.endswith("?")
    assert (form(chr(int(pair[:4], 16))) == pair[4]) == same


def test_letters_of_the_table_are_letters_of_its_scripts():
    for script, table in (("CYRILLIC", lookalike.CYRILLIC), ("GREEK", lookalike.GREEK), ("ARMENIAN", lookalike.ARMENIAN), ("CHEROKEE", lookalike.CHEROKEE), ("COPTIC", lookalike.COPTIC), ("LISU", lookalike.LISU)):
        for c, image in table.items():
            assert unicodedata.name(c).startswith(script) and image.isascii() and len(image) == 1
            if "CAPITAL" in unicodedata.name(c) or "SMALL" in unicodedata.name(c):
                assert image.isupper() == ("CAPITAL" in unicodedata.name(c) or "PALOCHKA" in unicodedata.name(c) and c == "\u04c0")


def test_clusters_are_the_longest(form):
    """Against a plain segmentation: after a match no mark or invisible character may follow that could still belong to it."""
    rng = random.Random(3)
    pool = "aбeé\u0301\u0308\u200b\u00ad ｅ12\r\n"
    for _ in range(5000):
        t = "".join(rng.choices(pool, k=10))
        for m in form.cluster.finditer(t):
            rest = t[m.end() :].lstrip("\u200b\u00ad")
            if m.group()[0] not in "\r\n\u200b\u00ad\u0301\u0308 ":
                assert not (rest and unicodedata.combining(rest[0]))


def test_plain_text_is_untouched(form):
    text = "Plain ASCII, with punctuation. Zoë's naïve café — “quoted” 日本語 собой"
    assert form("Plain ASCII.") is not None and form("") == ""
    assert form(text).count("café") == 1
    assert unicodedata.normalize("NFC", form(text)) == form(text)


def test_random_idempotence(form):
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x330), *range(0x370, 0x460), *range(0x2000, 0x2070), *range(0xFF00, 0xFFEF), *range(0xFB00, 0xFB07), *range(0x1100, 0x1120)] if chr(c).isprintable() or c < 0x2070]
    for _ in range(20_000):
        t = "".join(rng.choices(pool, k=8))
        assert form(form(t)) == form(t)


def test_pairs(spark):
    rows = [(1, "café", "x"), (2, "café", "x"), (3, "café", "x"), (4, "cafe", "x"), (5, None, "x"), (6, "", "x"), (7, "​", "x"), (2, "café", "x"), (None, "café", "x"), (8, "A" * 200_000, "x"), (9, "Α" + "A" * 199_999, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, class string")
    got = {tuple(r)[:2] for r in lookalike.alike(df, "doc_id", "text").collect()}
    assert got == {(1, 2), (2, 3), (8, 9)}
    assert lookalike.alike(df.limit(0), "doc_id", "text").count() == 0
    f = {r["doc_id"]: (r["form"], r["changed"]) for r in lookalike.consistent(df, "doc_id", "text").collect()}
    assert f[2] == ("café", True) and f[5] == (None, None) and f[6] == ("", False) and f[7] == ("", True)


@pytest.mark.parametrize("variants", [2, 70])
def test_large_forms_stay_linear_and_whole(spark, variants):
    texts = ["ab" + "​" * k for k in range(variants)]
    rows = [(i, texts[i % variants if i < variants else 0]) for i in range(400)]
    got = {tuple(r)[:2] for r in lookalike.alike(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", copies=64).collect()}
    assert all(a < b and rows[a][1] != rows[b][1] for a, b in got) and len(got) <= 64 * 400
    seen = {x for p in got for x in p}
    assert seen == set(range(400))  # no text lost its link


@pytest.mark.parametrize("block", [1024, 16])
def test_large_forms_keep_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(lookalike, "BLOCK", block)
    spellings = [(i, "ab" + "\u200b" * i) for i in range(65)]  # no copies: all pairs
    copies = [(100 + i, "cd" + "\u200b" * (i if i < 70 else 0)) for i in range(90)]  # 21 copies of one of 70 texts
    got = [tuple(r)[:2] for r in lookalike.alike(spark.createDataFrame(spellings + copies, "id bigint, text string"), "id", "text", copies=64).collect()]
    pairs = {(i, j) for j in range(65) for i in range(j)} | {(100 + i, 100 + j) for j in range(70) for i in range(j)}
    assert set(got) == pairs | {(100 + j, 100 + i) for i in range(70, 90) for j in range(1, 70)} and len(got) == len(set(got))


@pytest.mark.parametrize(("n", "copies"), [(65, lookalike.COPIES), (200, lookalike.COPIES), (65, None)])
def test_every_pair_of_copies(spark, n, copies):
    rows = [(i, "ab") for i in range(n)] + [(1000 + i, "a\u200bb") for i in range(n)]
    got = [(r["id_a"], r["id_b"], r["link"]) for r in lookalike.alike(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", copies=copies).collect()]
    assert sorted(got) == [(i, 1000 + j, "pair") for i in range(n) for j in range(n)]


def test_report(spark):
    df = spark.createDataFrame([(1, "ａ", "s"), (2, "a", "s"), (3, "b", None), (4, None, "s")], "id bigint, text string, source string")
    got = {r["source"]: (r["n_texts"], r["n_changed"], r["n_distinct_before"], r["n_distinct_after"]) for r in lookalike.report(df, "id", "text", "source").collect()}
    assert got == {"s": (2, 1, 2, 1), None: (1, 0, 1, 1)}


ITEM = "The quick brown fox jumps over the lazy dog while seven owls watch from above the barn"


@pytest.mark.parametrize("bits", [1 << 15, leakage.BITS])
def test_contains(spark, bits):
    w = ITEM.split()
    rows = [
        (1, "before " + ITEM + " after"), (2, "x " + " ".join(w[2:15]) + " y"), (3, " ".join(w[2:14])), (4, ITEM.upper().replace(" ", "\n")), (5, ITEM.replace("o", "ο").replace(" ", " *")),
        (6, None), (7, ""), (8, " ".join(w[:7] + ["other"] + w[7:])), (9, "z " * 50_000 + ITEM), (1, "before " + ITEM + " after"), (10, "fo­x".join(ITEM.split("fox"))),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, item bigint")
    items = spark.createDataFrame([(100, ITEM), (101, "too short to count"), (102, None), (103, "another passage that is long enough to have thirteen words in it for sure"), (100, ITEM)], "item_id bigint, text string")
    got = leakage.contains(docs, "doc_id", "text", items, "item_id", "text", bits=bits).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, 100) for d in (1, 2, 4, 5, 9, 10)}
    assert next(r["windows"] for r in got if r["doc_id"] == 2) == 1 and len(got) == 6
    assert leakage.contains(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leakage.contains(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_a_full_filter_stops_nothing(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))) for i in range(500)]
    docs = [(i, "start " + " ".join(t.split()[5:25]) + " end") for i, t in items] + [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(50)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leakage.contains(d, "doc_id", "text", t, "item_id", "text", bits=1 << 15).collect()} == {(i, i, 8) for i in range(500)}


def test_against_brute_force(spark, form):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(10, 40)))) for i in range(30)]
    docs = []
    for d in range(200):
        w = rng.choices(vocab, k=rng.randrange(0, 120))
        if d % 3 == 0:
            p = rng.choice(items)[1].split()
            n = rng.randrange(8, 20)
            s = rng.randrange(max(1, len(p) - n))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[s : s + n]
        docs.append((d, " ".join(w)))
    grams = {tuple(words(t)[k : k + 13]): set() for _, t in items for k in range(len(words(t)) - 12)}
    for i, t in items:
        for k in range(len(words(t)) - 12):
            grams[tuple(words(t)[k : k + 13])].add(i)
    want = {(d, i) for d, t in docs for k in range(len(words(t)) - 12) for i in grams.get(tuple(words(t)[k : k + 13]), ())}
    got = leakage.contains(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want


@pytest.mark.parametrize(("a", "b"), [("ｶﾞ", "ガ"), ("ﾡ​ￂᆨ", "각"), ("각", "각"), ("가‍ᆨ", "각")])
def test_syllables_of_any_width(form, a, b):
    assert form(a) == b == form(b)
