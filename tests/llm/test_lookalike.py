import unicodedata

from organelia.llm import lookalike
from organelia.llm.lookalike import classes, consistent_text, equal_looking_pairs, look_alike_form

SAME = [
    ("Café - 10 % of filled", ["Café - 10 % of filled", "Ｃafé - １0 ％ of filled", "Café - 10 % of filled", "Café ‐ 10 % of filled", "Café ‑ 10 % o​f fi­l‍led﻿",
        "Café - 10 % of ﬁlled", "Саfé - 10 % оf fіllеd", "Cafе́ - 10 % of filled"]),
    ("Ångdal 5 μm", ["Ångdal 5 μm", "Ångdal 5 µm", "А̊ngdal 5 µm"]),
    ("NOTE X", ["ΝΟΤΕ Χ", "ＮＯＴＥ　Ｘ"]),
]
DIFFERENT = ["cafe", "Cafe", "café", "ss", "ß", "a", "α", "x2", "x²", "a-b", "a–b", "a.b", "a b", "ab", "a!", "e", "é", "", " ", "\n"]


def test_pairs(spark):
    texts = [t for first, others in SAME for t in (first, *others)] + DIFFERENT
    data = [(i, t, "f") for i, t in enumerate(texts)]
    data += [(900, None, "f"), (None, "Cafe", "f"), (901, "Cafe", "f"), (901, "Cafe", "f"), (902, "NOTE X", "f")]
    df = spark.createDataFrame(data, "doc_id long, text string, form string")
    found = equal_looking_pairs(classes(df)).collect()
    expected, at = set(), 0
    for first, others in SAME:
        n = 1 + len(others)
        group = [*range(at, at + n), *([902] if first == "NOTE X" else [])]
        text = dict((i, t) for i, t, _ in data if i is not None)
        expected |= {(a, b) for a in group for b in group if a < b and text[a] != text[b]}
        at += n
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_every_fullwidth_and_composed_letter(spark):
    data, pairs = [], set()
    for i, c in enumerate(range(0xFF01, 0xFF5F)):
        data += [(2 * i, f"x{chr(c)}y"), (2 * i + 1, f"x{chr(c - 0xFEE0)}y")]
        pairs.add((2 * i, 2 * i + 1))
    composed = [c for c in map(chr, range(0xC0, 0x17F)) if len(unicodedata.normalize("NFD", c)) > 1]
    for i, c in enumerate(composed):
        data += [(1000 + 2 * i, f"z{c}"), (1001 + 2 * i, "z" + unicodedata.normalize("NFD", c))]
        pairs.add((1000 + 2 * i, 1001 + 2 * i))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {tuple(r) for r in equal_looking_pairs(classes(df)).collect()} == pairs


def test_one_form_long_text_and_copies(spark):
    long = "Ωmega é " * 20_000
    data = [(3, long), (1, unicodedata.normalize("NFD", long)), (2, long), (5, "copy"), (6, "copy"), (6, "copy")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    c = classes(df)
    got = {r["doc_id"]: r for r in consistent_text(df, c).collect()}
    assert got[3]["text"] == got[1]["text"] == got[2]["text"] and got[3]["class_id"] == 1
    assert got[5]["class_id"] == got[6]["class_id"] == 5
    assert {tuple(r) for r in equal_looking_pairs(c).collect()} == {(1, 3), (1, 2)}
    assert classes(df.limit(0)).count() == 0


def test_every_composed_look_alike_equals_its_decomposition(spark):
    """Each character whose letter is a look-alike and that carries accents: composed, decomposed, and with the Latin letter."""
    table = lookalike.table()
    found = [c for c in map(chr, range(0x80, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in table and len(table[d[0]]) == 1]
    assert len(found) > 100 and {"ӑ", "ӓ", "ӧ", "ѐ", "ў", "Ά", "ό"} <= set(found)
    data, pairs = [], set()
    for i, c in enumerate(found):
        d = unicodedata.normalize("NFD", c)
        data += [(3 * i, f"{i} x{c}"), (3 * i + 1, f"{i} x{d}"), (3 * i + 2, f"{i} x" + table[d[0]] + d[1:])]
        pairs |= {(3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 2)}
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {tuple(r) for r in equal_looking_pairs(classes(df)).collect()} == pairs


def test_forms(spark):
    cases = {"Ᏼꓮ𝐀𝒷": "BAAb", "Ⅻ of Ⅳ": "XII of IV", "ﾊﾟｶﾞ": "ハ\u309aカ\u3099", "x²½①": "x²½①", "𝚨": "A", "ў": "y\u0306", "plain": "plain", "": "", "–—": "–—"}
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    for r in df.select("text", "want", look_alike_form(df.text).alias("got")).collect():
        assert r["got"] == r["want"], r["text"]


def test_other_scripts_and_hot_groups(spark):
    data = [(1, "한국어 글"), (2, unicodedata.normalize("NFD", "한국어 글")), (3, "日本語"), (4, "中文"), (5, "がぎ"), (6, unicodedata.normalize("NFD", "がぎ")), (7, "かき"), (8, "ไทย"),
        (9, "")]
    data += [(1000 + i, "no" + "\u200b" * i + "tice") for i in range(40)] + [(2000, "notice"), (2000, "nòtice"), (2001, "no\u0300tice")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {tuple(r) for r in equal_looking_pairs(classes(df)).collect()}
    marked = [*range(1000, 1040), 2000]
    text = dict(data)
    want = {(1, 2), (5, 6), (2000, 2001)} | {(a,
        b) for a in marked for b in marked if a < b and (text[a] if a != 2000 else "notice") != (text[b] if b != 2000 else "notice")}
    assert got == want
