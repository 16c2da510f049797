"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators outside quotes: punctuation and line breaks; a comma not between digits; a slash with a blank beside it.
SEPARATOR = r"[;|\t\r\n]|(?<![0-9]),|,(?![0-9])|(?<=\s)/|/(?=\s)"
#: The same where blanks alone separate too.
BLANK_SEPARATOR = r"\s+/\s*|/\s+|[;|]|(?<![0-9]),|,(?![0-9])|\s+"
OUTER = " \t\r\n\f\x0b\u00a0"
#: Marks the end of a value while pieces are put together: a code point that is no character. One that a text has itself is written with the next two.
MARK, ESCAPE = "\ufdd0", "\ufdd1"


def unpack(text: Column, blanks: bool = False) -> Column:
    """The values of a packed text, in order, as an array.

    The text is split on double quotes. Odd pieces are literals; even pieces are split on the separators;
    an empty even piece between two literals is a doubled quote. Two folds put the values together again: one over the
    parts of a piece, with a mark between them, and one over the pieces; what lies between two marks is a value. Both are linear in
    the text. Outer blanks and empty values are dropped. NULL gives NULL, empty text an empty array. A quote
    that is never closed makes the rest of the text a literal.
    """
    sep = BLANK_SEPARATOR if blanks else SEPARATOR
    pieces = F.split(F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "1")), F.lit(MARK), F.lit(ESCAPE + "0")), '"', -1)
    last = F.size(pieces) - 1
    parts = lambda p, i: F.when(i % 2 == 1, F.array(p)).when((p == "") & (i > 0) & (i < last), F.array(F.lit('"'))).otherwise(F.split(p, sep, -1))
    folded = F.array_join(F.transform(pieces, lambda p, i: F.array_join(parts(p, i), MARK)), "")
    values = F.transform(F.split(folded, MARK, -1), lambda v: F.replace(F.replace(v, F.lit(ESCAPE + "0"), F.lit(MARK)), F.lit(ESCAPE + "1"), F.lit(ESCAPE)))
    return F.filter(F.transform(values, lambda v: F.btrim(v, F.lit(OUTER))), lambda v: v != "")


def packed_values(df: DataFrame, table_name: str, row_key: Sequence[str], fields: Sequence[str], blank_fields: Sequence[str] = (), least: int = 2) -> DataFrame:
    """(table_name, field_name, row_key, pos, item): every value of the fields that hold ``least`` or more.

    ``row_key`` columns are joined by ``|``; a NULL among them is shown as empty text. Rows whose field is
    NULL, empty or holds fewer values give nothing. Rows are distinct, so copies of a row count once.
    Columns other than the named ones are not read.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_key])
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text"), F.lit(f in blank_fields).alias("blanks")) for f in fields]))
    rows = df.select(key.alias("row_key"), parts.alias("x")).select("row_key", "x.*").where("text is not null")
    if not blank_fields:
        values = unpack(F.col("text"))
    elif set(blank_fields) >= set(fields):
        values = unpack(F.col("text"), True)
    else:
        values = F.when(F.col("blanks"), unpack(F.col("text"), True)).otherwise(unpack(F.col("text")))
    return (
        rows.select("field_name", "row_key", values.alias("v"))
        .where(F.size("v") >= least)
        .select(F.lit(table_name).alias("table_name"), "field_name", "row_key", F.posexplode("v").alias("p", "item"))
        .select("table_name", "field_name", "row_key", (F.col("p") + 1).alias("pos"), "item")
        .distinct()
    )
