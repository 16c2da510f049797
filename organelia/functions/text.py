"""Text, list and JSON helpers as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def append_note(current: Column, new: Column) -> Column:
    """A note added to a list of notes; NULL and empty text are an empty list, a NULL note adds nothing."""
    return F.when(new.isNull(), current).when(current.isNull() | (current == ""), new).otherwise(F.concat(current, F.lit("; "), new))


def glue(template: str, columns: Mapping[str, Column] | None = None) -> Column:
    """A template with ``{column}`` places as one concatenation; NULL values are shown as NA."""
    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(parts):
        if i % 2:
            c = columns[p] if columns else F.col(p)
            out.append(F.coalesce(c.cast("string"), F.lit("NA")))
        elif p:
            out.append(F.lit(p))
    return F.concat(*out) if out else F.lit("")


def wrap_lines(seq: Column, width: int = 80) -> Column:
    """A line break after every ``width`` characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def masked(value: Column, mask: Column) -> Column:
    """A value as text, with ``#`` in front where the mask holds."""
    return F.when(F.coalesce(mask, F.lit(False)), F.concat(F.lit("#"), value.cast("string"))).otherwise(value.cast("string"))


def unmasked(text: Column) -> tuple[Column, Column]:
    """Value and mask of what ``masked`` wrote."""
    return F.regexp_replace(text, "^#", "").try_cast("double"), F.coalesce(F.startswith(text, F.lit("#")), F.lit(False))


def squish(text: Column) -> Column:
    """Outer blanks off, inner runs of blanks to one."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def named_groups(text: Column, pattern: str, names: list[str]) -> list[Column]:
    """Groups of a pattern as columns; NULL where the pattern is not found."""
    return [F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i)).alias(n) for i, n in enumerate(names, 1)]


def named_values(name: Column, value: Column) -> Column:
    """An aggregate: the values of a group as a map by their names. A name should occur once in a group; of several the one that sorts last counts."""
    entries = F.array_sort(F.collect_list(F.struct(name.alias("k"), value.alias("v"))))
    last = F.filter(entries, lambda e, i: ~F.coalesce(F.get(entries, i + 1)["k"] == e["k"], F.lit(False)))
    return F.map_from_entries(F.filter(last, lambda e: e["k"].isNotNull()))


def bullets(structure: Column) -> Column:
    """A structure with its transfer RNAs shown as bullets."""
    return F.regexp_replace(structure, "trn[A-Z]", "\u2022")


def shell_quote(text: Column) -> Column:
    """A text as one word of a shell command."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


HIT_FIELDS = ("acc", "Taxon", "eval", "pctid", "similarity", "gap_leading", "gap_trailing")


def recycled(raw: Column, n: Column) -> Column:
    """The JSON text of a field as an array of ``n`` values: a scalar stands for all rows, NULL for ``n`` NULLs."""
    listed = F.startswith(F.ltrim(raw), F.lit("["))
    return F.when(listed, F.from_json(raw, "array<string>")).otherwise(F.array_repeat(raw, n))


def hit_rows(json: Column) -> Column:
    """Reference hits kept as column-oriented JSON, as an array of rows; NULL, ``{}`` and unreadable text are no hits.

    The text is parsed once; a field's value stays JSON text until it is known to be a list or a scalar.
    """
    kind = {"acc": "string", "Taxon": "string", "gap_leading": "int", "gap_trailing": "int"}

    def count(acc: Column) -> Column:
        return F.when(acc.isNull(), 0).when(F.startswith(F.ltrim(acc), F.lit("[")), F.size(F.from_json(acc, "array<string>"))).otherwise(1)

    def zipped(p: Column, n: Column) -> Column:
        cells = F.arrays_zip(*[recycled(p[f], n).alias(f) for f in HIT_FIELDS])
        return F.transform(cells, lambda h: F.struct(*[h[f].try_cast(kind.get(f, "double")).alias(f.lower()) for f in HIT_FIELDS]))

    parsed = F.from_json(json, ", ".join(f"{f} string" for f in HIT_FIELDS))
    rows = bind(parsed, lambda p: bind(count(p["acc"]), lambda n: zipped(p, n)))
    return F.when(json.isNotNull(), F.coalesce(rows,
        F.array().cast("array<struct<acc:string,taxon:string,eval:double,pctid:double,similarity:double,gap_leading:int,gap_trailing:int>>")))


def hit_json(hits: Column, fields: list[str]) -> Column:
    """Rows of hits as column-oriented JSON: a field that is the same in all rows is one scalar, one that is all NULL is left out."""

    def column(f: str) -> Column:
        values = F.transform(hits, lambda h: F.to_json(F.struct(h[f].alias("v"))))
        texts = F.transform(values, lambda v: F.when(v == "{}", "null").otherwise(F.regexp_replace(F.regexp_replace(v, r'^\{"v":', ""), r"\}$", "")))
        kinds = F.array_distinct(texts)
        body = F.when(F.size(kinds) == 1, kinds[0]).otherwise(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
        return F.when(F.forall(hits, lambda h: h[f].isNull()), F.lit(None)).otherwise(F.concat(F.lit(f'"{f}":'), body))

    parts = F.filter(F.array(*[column(f) for f in fields]), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 0, "{}").otherwise(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
