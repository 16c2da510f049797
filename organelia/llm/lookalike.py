"""Texts that look the same although their characters differ, brought to one form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from organelia.session import cut

# Characters without a look of their own, as code point ranges.
INVISIBLE = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00,
    0xFE0F), (0xFEFF, 0xFEFF))
# Blanks that look like the plain one.
BLANKS = ((0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# Hyphens that look like the plain one. The dashes are longer and stay.
HYPHENS = "‐‑﹣−־"
# Joined letters, and numerals written as one character.
JOINED = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ŉ": "'n",
    "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz",
    "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅺ": "XI", "Ⅻ": "XII",
    "ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv", "ⅵ": "vi", "ⅶ": "vii", "ⅷ": "viii", "ⅸ": "ix", "ⅺ": "xi", "ⅻ": "xii",
}
# Letters of another script and the Latin letters they look like, after the published list of confusables.
CYRILLIC = ("АВЕЅЗІЈКМНОРСТУХЬԌԚԜҮаеѕіјорсухһԁԛԝүӏ", "ABES3IJKMHOPCTYXbGQWYaesijopcyxhdqwyl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονρϲϳ", "ABEZHIKMNOPTYXCJovpcj")
ARMENIAN = ("ՕՍօոսցհզ", "OUonughq")
CHEROKEE = ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏏᏒᏔᏚᏞᏟᏢᏦᏧᏴ", "DRTiAJEWMHYGZ4bRWSLCPKdB")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
LETTERLIKE = ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿɡµ", "IVXLCDMivxlcdmgμ")
SIGNS = (";·։∶․⁄∕∗ǃː꞉", ";·::.//*!::")

#: Tags of the Unicode decompositions that change nothing in the look but width and style. Raised and lowered forms, circles and fractions look different.
TAGS = ("<wide>", "<narrow>", "<font>")
_SURROGATES = range(0xD800, 0xE000)


def _chars(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


def _every() -> Iterator[str]:
    """The characters beyond ASCII of the planes that have letters and signs."""
    return (chr(c) for c in range(0x80, 0x20000) if c not in _SURROGATES)


def _look(c: str, known: dict[str, str]) -> str:
    """What a character stands for: styled forms and look-alikes of its decomposition, until nothing changes."""
    tag, _, codes = unicodedata.decomposition(c).partition(" ")
    now = "".join(chr(int(x, 16)) for x in codes.split()) if tag in TAGS else c
    while (then := "".join(known.get(x, x) for x in unicodedata.normalize("NFD", now))) != now:
        now = then
    return now


@cache
def table() -> dict[str, str]:
    """Characters, and the text they become: nothing for what can't be seen.

    A character is decomposed before its parts are looked up, so a look-alike letter with its accent in one character
    becomes the same as the letter followed by the accent. Where Unicode has the result in one character, that is used.
    """
    blanks = _chars(BLANKS)
    pairs = [(blanks, " " * len(blanks)), (HYPHENS, "-" * len(HYPHENS)), CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, LETTERLIKE, SIGNS]
    known: dict[str, str] = dict(JOINED)
    for a, b in pairs:
        for x, y in zip(a, b, strict=True):
            known.setdefault(x, y)
    for c in _chars(INVISIBLE):
        known[c] = ""
    out = {}
    for c in _every():
        look = unicodedata.normalize("NFC", _look(c, known))
        if look != unicodedata.normalize("NFC", c):
            out[c] = look
    return out


def look_alike_form(text: Column) -> Column:
    """The text with invisible characters removed and width forms, blanks, hyphens, joined letters and look-alikes replaced.

    Accents are left as they are, composed or combining; the collation that groups the forms does not tell
    these apart. Plain ASCII is returned as it is. NULL gives NULL.
    """
    single = {c: t for c, t in table().items() if len(t) == 1}
    removed = "".join(c for c, t in table().items() if not t)
    several = {c: t for c, t in table().items() if len(t) > 1}
    form = F.translate(text, "".join(single) + removed, "".join(single.values()))
    longer = form
    for c, t in several.items():
        longer = F.replace(longer, F.lit(c), F.lit(t))
    # Few texts have characters that become several. They are told by ranges of code points: what else lies in these is not replaced.
    return F.when(~text.rlike(r"[^\x00-\x7F]"), text).when(text.rlike(_ranges("".join(several))), longer).otherwise(form)


def _ranges(characters: str, gap: int = 32) -> str:
    """A character class of few ranges in which all the characters lie."""
    codes = sorted(map(ord, characters))
    ends = [[codes[0], codes[0]]]
    for c in codes[1:]:
        if c - ends[-1][1] > gap:
            ends.append([c, c])
        ends[-1][1] = c
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ends) + "]"


@cache
def _bases() -> tuple[str, str]:
    """Characters that have a canonical decomposition, and its first character."""
    found = {c: d[0] for c in _every() if (d := unicodedata.normalize("NFD", c)) != c}
    return "".join(found), "".join(found.values())


def skeleton(form: Column) -> Column:
    """The characters of a form without accents, vowel signs and what can't be seen: the same for all forms that are canonically equal."""
    bare = F.regexp_replace(F.translate(form, *_bases()), r"[\p{M}\p{C}\u1160-\u11FF&&[^\t\n\x0B\f\r]]+", "")
    return F.when(form.rlike(r"[^\t\n\x0B\f\r\x20-\x7E]"), bare).otherwise(form)


def classes(documents: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """(doc_id, text_id, class_id): each document, its exact text and its class of equal look.

    1. One pass over the texts keeps three hashes a document: of the text, of its look-alike form, and of the form's
       skeleton. It is written to the checkpoint folder; from then on texts are fetched only for step 3.
    2. Forms that are the same string, character by character, are one value with the least doc_id as its representative.
       This is a minimum that is combined before the shuffle, so copies and variants of one text, however many, meet nowhere.
    3. Values that share their skeleton with another value are fetched and grouped under an accent- and case-sensitive
       Unicode collation, to which composed and combining accents are equal. The class's canonical member
       (``class_id``) is the least doc_id; it is joined back to the values. A value alone with its skeleton is a group of its own.

    ``text_id`` is the 128-bit hash of the text as it stands. The canonical member does not depend on row
    order. Documents with NULL doc_id or text are left out; an empty text is a text. A repeated doc_id
    with several texts belongs to several classes. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    hashed = lambda c: F.unhex(F.md5(c))
    looked = docs.select("doc_id", "text", look_alike_form(F.col("text")).alias("form"))
    ids = cut(looked.select("doc_id", hashed("text").alias("text_id"), hashed("form").alias("form_id"), F.xxhash64(skeleton(F.col("form"))).alias("bone")))
    forms = ids.groupBy("form_id").agg(F.min("doc_id").alias("rep"), F.min("bone").alias("bone"))
    shared = forms.groupBy("bone").agg(F.count("*").alias("n")).where("n > 1").select("bone")
    suspects = forms.join(shared, "bone")
    fetched = docs.join(suspects.withColumnRenamed("rep", "doc_id"), "doc_id").select("form_id", F.col("doc_id").alias("rep"), "bone",
        look_alike_form(F.col("text")).alias("form"))
    # A repeated doc_id may bring another of its texts along. Values of one skeleton come together by its
    # hash, so the collation only ever compares likely equals.
    values = cut(fetched.where(hashed("form") == F.col("form_id")).dropDuplicates(["form_id"]).select("form_id", "rep", "bone", F.collate("form",
        collation).alias("form")).repartition("bone"))
    canonical = values.groupBy("bone", "form").agg(F.min("rep").alias("class_id"))
    named = values.join(canonical, ["bone", "form"]).select("form_id", "class_id")
    of = forms.join(named, "form_id", "left").select("form_id", F.coalesce("class_id", "rep").alias("class_id"))
    return ids.join(of, "form_id").select("doc_id", "text_id", "class_id")


def equal_looking_pairs(found: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of one class whose texts are not the same string.

    Different texts of a class are paired first, then each side is put back to its documents; copies of one
    text are never paired with each other.
    """
    several = found.groupBy("class_id").agg(F.min("text_id").alias("x"), F.max("text_id").alias("y")).where("x <> y").select("class_id")
    few = found.join(several, "class_id", "left_semi").distinct()
    texts = few.select("class_id", "text_id").distinct()
    pairs = texts.select("class_id", F.col("text_id").alias("ta")).join(texts.select("class_id", F.col("text_id").alias("tb")), "class_id").where("ta < tb").select("ta",
        "tb")
    a = few.select(F.col("text_id").alias("ta"), F.col("doc_id").alias("da")).distinct()
    b = few.select(F.col("text_id").alias("tb"), F.col("doc_id").alias("db")).distinct()
    return pairs.join(a, "ta").join(b, "tb").where("da <> db").select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b")).distinct()


def consistent_text(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, class_id, text): each document with the form of its class's canonical member."""
    members = found.select("class_id").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("class_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(members,
        "class_id", "left_semi")
    canonical = texts.groupBy("class_id").agg(F.min(look_alike_form(F.col("text"))).alias("text"))
    return found.select("doc_id", "class_id").distinct().join(canonical, "class_id").select("doc_id", "class_id", "text")
