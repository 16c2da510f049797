"""Rows that fail to parse: valid rows are loaded, the others come out with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("ID", "Taxon", "R1", "R2")
ID_LENGTH = 18
# The endings of a read file.
READ_FILE = r"\.(fastq|fq)(\.gz)?\z"
#: Quotes are balanced, and a quoted field starts and ends at a field border. Possessive, so that long texts need no stack.
WELL_QUOTED = r'(?s)\A(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+\z'
_BLANKS = " \t\r\n\f\x0b\u00a0\ufeff"
_MARK = "\ufeff"


def _blank_off(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _record(raw: Column) -> Column:
    """A raw record without the carriage return and line break it may end in."""
    return F.regexp_replace(raw, r"[\r\n]+\z", "")


def _commas(record: Column) -> Column:
    return F.length(record) - F.length(F.replace(record, F.lit(","), F.lit("")))


def _read(record: Column, width: Column, most: int, columns: int) -> Column:
    """Permissive read of any record as ``width`` fields under an explicit schema of ``most`` columns.

    Commas fill a narrower sheet up to the schema, so the parser marks a record as corrupt exactly if it
    finds another number of fields than the sheet has. ``_corrupt`` keeps the text of such records. ``columns``
    are as many as the record with most commas could have.
    """
    schema = ", ".join([f"c{i} string" for i in range(most)] + ["_corrupt string"])
    padded = F.concat(record, F.repeat(F.lit(","), (F.lit(most) - width).cast("int")))
    options = {"quote": '"', "escape": '"', "comment": "", "emptyValue": "", "nullValue": "\ufdd0", "multiLine": "true", "maxCharsPerColumn": "-1",
        "maxColumns": str(columns)}
    return F.from_csv(padded, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **options})


def _split(record: Column) -> Column:
    """The fields of a well-quoted header as an array."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r'(?s),("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'), 1)
    return F.transform(cells, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def classify_records(sheets: DataFrame, most: int | None = None) -> DataFrame:
    """(sheet, line_no, raw, width, id, taxon, r1, r2, reason) of every record after its sheet's header.

    ``reason`` is NULL for a valid record, else the first that holds of: ``no header`` (the sheet has no
    line 1 with all required columns), ``no record`` (raw NULL), ``quoting``, ``field count``, ``id empty``,
    ``id too long``, ``taxon empty``, ``r1 not a read file``, ``r2 not a read file``, ``r1 equals r2``,
    ``id repeated`` (an earlier valid record of the sheet has it). Header names are compared without case
    and outer blanks; of a name that occurs twice the first counts.

    1. Every record is read permissively under an explicit schema of ``most`` columns (default: the widest header).
       The parser keeps the text of records whose field count is not their sheet's in ``_corrupt``; that text
       is what comes out as ``raw``.
    2. Corrupt records are classed from the text kept: ``quoting`` where quotes are unbalanced or not at a
       field border, else ``field count``. The parser forgives some quotes that are neither, so records
       that it could read are held to the same pattern.
    3. Values of what is left are checked.

    Of several line 1 the first by text is the header, and of records with one (sheet, line_no) and ID each
    may be the earlier one, so all of them are valid. A NULL sheet or line_no makes a record of an unknown
    sheet: ``no header``. Other columns are not read.

    The parts of a sheet are never gathered in one task: the header is joined, and the first valid line of
    an ID is a minimum that is combined before the shuffle.
    """
    rows = sheets.select("sheet", "line_no", F.col("raw").cast("string").alias("raw"))
    heads = rows.where("line_no = 1 and sheet is not null").groupBy("sheet").agg(F.min("raw").alias("raw"))
    head = _record(F.regexp_replace("raw", f"^{_MARK}", ""))
    names = F.transform(_split(head), lambda c: F.lower(_blank_off(c)))
    heads = heads.select("sheet", names.alias("names")).select(
        "sheet", F.size("names").alias("width"), *[F.array_position("names", F.lit(n.lower())).cast("int").alias(f"at_{n.lower()}") for n in REQUIRED]
    )
    # Two numbers come to the driver: the widest header, and the most commas in a record, for which the parser is sized.
    sizes = dict(tuple(r) for r in heads.select(F.lit("width").alias("k"), F.col("width").alias("v")).unionAll(rows.select(F.lit("commas"),
        _commas(F.col("raw")))).groupBy("k").agg(F.max("v").alias("v")).collect())
    if most is None:
        most = max(sizes.get("width") or 1, 1)
    columns = most + (sizes.get("commas") or 0) + 1
    body = rows.where("line_no is null or line_no <> 1").join(heads, "sheet", "left")
    read = body.withColumn("record", _record(F.col("raw"))).withColumn("got", _read(F.col("record"), F.col("width"), most, columns))
    cell = F.array(*[F.col(f"got.c{i}") for i in range(most)])
    size, kept = F.length("record"), F.col("got._corrupt")
    # The text that the parser kept, without the commas that filled it up and with the line's end that was taken off.
    raw = F.when(kept.isNotNull(), F.concat(F.substr(kept, F.lit(1), size), F.substr("raw", size + 1))).otherwise(F.col("raw"))
    read = read.select("sheet", "line_no", raw.alias("raw"), "width", "at_id", "at_taxon", "at_r1", "at_r2", "record",
        F.when(kept.isNull() & ((F.col("record") != "") | (F.col("width") == 1)), cell).alias("cells"))
    quoted = ~F.contains("record", F.lit('"')) | F.col("record").rlike(WELL_QUOTED)
    value = lambda n: _blank_off(F.coalesce(F.get("cells", F.col(f"at_{n}") - 1), F.lit("")))
    read = read.withColumn("quoted", quoted)
    read = read.select("sheet", "line_no", "raw", "width", "at_id", "at_taxon", "at_r1", "at_r2", "quoted",
        (F.col("quoted") & F.col("cells").isNotNull()).alias("counted"), F.inline(F.array(F.struct(*[value(n.lower()).alias(n.lower()) for n in REQUIRED]))))
    # The generator keeps later filters from being rewritten into many copies of the parse below it.
    reason = (
        F.when(F.col("width").isNull() | (F.least("at_id", "at_taxon", "at_r1", "at_r2") == 0), "no header")
        .when(F.col("raw").isNull(), "no record")
        .when(~F.col("quoted"), "quoting")
        .when(~F.col("counted"), "field count")
        .when(F.col("id") == "", "id empty")
        .when(F.length("id") > ID_LENGTH, "id too long")
        .when(F.col("taxon") == "", "taxon empty")
        .when(~F.col("r1").rlike(READ_FILE), "r1 not a read file")
        .when(~F.col("r2").rlike(READ_FILE), "r2 not a read file")
        .when(F.col("r1") == F.col("r2"), "r1 equals r2")
    )
    checked = read.select("sheet", "line_no", "raw", "width", *[F.when(F.col("counted"), F.col(n)).alias(n) for n in ("id", "taxon", "r1", "r2")], reason.alias("reason"))
    firsts = checked.where("reason is null").groupBy("sheet", F.col("id").alias("key")).agg(F.min("line_no").alias("first_line"))
    # An invalid record has no earlier one to look for; its own line as key spreads such records over the tasks.
    key = F.when(F.col("reason").isNull(), F.col("id")).otherwise(F.concat(F.lit("\n"), F.col("line_no").cast("string")))
    return (
        checked.withColumn("key", key)
        .join(firsts, ["sheet", "key"], "left")
        .withColumn("reason", F.when(F.col("reason").isNull() & (F.col("line_no") > F.col("first_line")), "id repeated").otherwise(F.col("reason")))
        .select("sheet", "line_no", "raw", "width", "id", "taxon", "r1", "r2", "reason")
    )


def valid_records(classified: DataFrame) -> DataFrame:
    """The loaded rows of ``classify_records``."""
    return classified.where("reason is null").select("sheet", "line_no", "id", "taxon", "r1", "r2")


def rejected_records(classified: DataFrame) -> DataFrame:
    """The rows that were kept out, with raw text and reason."""
    return classified.where("reason is not null").select("sheet", "line_no", "reason", "raw")
