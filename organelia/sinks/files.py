"""Writers: delimited text, FASTA, feature tables, GFF3."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from organelia.functions.text import glue


def write_csv(df: DataFrame, path: str, sep: str = ",", quoted: bool = True) -> None:
    """Delimited text with a header, NULL as nothing, outer blanks kept. Unquoted output is for tables whose text holds no separator."""
    w = df.write.mode("overwrite").options(header=True, sep=sep, nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (w.option("escape", '"') if quoted else w.option("quote", "\x00").option("escapeQuotes", False)).csv(path)


def write_lines(df: DataFrame, path: str, line: str = "line", by: str | None = None, order: Sequence[str] = ()) -> None:
    """Lines as text files; ``by`` makes one folder a value and keeps the order of its lines within a task."""
    if by is None:
        (df.sortWithinPartitions(*order) if order else df).select(line).write.mode("overwrite").text(path)
        return
    df.repartition(by).sortWithinPartitions(by, *order).select(line, by).write.mode("overwrite").partitionBy(by).text(path)


def fasta_lines(header: Column, sequence: Column) -> Column:
    """A FASTA record as one text."""
    return F.concat(F.lit(">"), header, F.lit("\n"), sequence)


def fasta_from_template(df: DataFrame, template: str, sequence: str = "sequence") -> DataFrame:
    """FASTA records with headers from a ``{column}`` template."""
    return df.withColumn("line", fasta_lines(glue(template), F.col(sequence)))


def _positions(c: Sequence[str] = ("pos1", "pos2")) -> tuple[Column, Column]:
    back = F.col("direction") == "-"
    return F.when(back, F.col(c[1])).otherwise(F.col(c[0])).cast("string"), F.when(back, F.col(c[0])).otherwise(F.col(c[1])).cast("string")


def _tab(*cells: Column | str) -> Column:
    return F.concat_ws("\t", *[F.lit(c) if isinstance(c, str) else c for c in cells])


# The notes of an export.
UNDETERMINED = "start codon not determined"
COMPLETED = "TAA stop codon is completed by the addition of 3' A residues to the mRNA"


def codon_notes(df: DataFrame) -> DataFrame:
    """Adds ``bad_start`` and ``note`` to protein calls from (start_codon, stop_codon, start_codons); NULL codons and NULL lists raise no note."""
    bad = (F.col("type") == "PCG") & F.coalesce(~F.array_contains("start_codons", F.col("start_codon")), F.lit(False))
    short = (F.col("type") == "PCG") & (F.length("stop_codon") < 3)
    parts = F.concat_ws("; ", F.when(bad, UNDETERMINED), F.when(short, COMPLETED))
    return df.withColumn("bad_start", bad).withColumn("note", F.nullif(parts, F.lit("")))


def feature_table(calls: DataFrame) -> DataFrame:
    """(seq_name, pos1, gene, n, line): the lines of a 5-column feature table.

    Input: seq_name, type, gene, product, pos1, pos2, direction, anticodon, genetic_code, bad_start, note.
    Positions of the minus strand are written in reverse; a start codon that is not determined marks the
    start as partial. Types other than PCG, tRNA, rRNA and ctrl have no lines.
    """
    a, b = _positions()
    a = F.when(F.col("bad_start") & (F.col("direction") == "+"), F.concat(F.lit("<"), a)).otherwise(a)
    b = F.when(F.col("bad_start") & (F.col("direction") == "-"), F.concat(b, F.lit(">"))).otherwise(b)
    q = lambda name, value: _tab("\t\t", name, value)
    kind = F.col("type")
    shown = F.when((kind == "rRNA") & (F.col("gene") == "rrnS"), "s-rRNA").when(kind == "rRNA", "l-rRNA").otherwise(F.col("gene"))
    # The feature names and qualifiers of the file format, and the notes.
    lines = F.when(
        kind.isin("PCG", "tRNA", "rRNA"),
        F.array(
            _tab(a, b, "gene"),
            q("gene", shown),
            _tab(a, b, F.when(kind == "PCG", "CDS").otherwise(kind)),
            q("product", F.coalesce("product", F.lit(""))),
            F.when(kind == "PCG", q("transl_table", F.col("genetic_code").cast("string"))),
            F.when(F.col("bad_start"), q("codon_start", F.lit("1"))),
            F.when(F.col("note").isNotNull(), q("note", F.col("note"))),
            F.when((kind == "tRNA") & (F.col("anticodon") != "NNN"), q("note", F.concat(F.lit("anticodon:"), F.lower("anticodon")))),
        ),
    ).when(kind == "ctrl", F.array(_tab(a, b, "D-loop"), q("note", F.lit("control region"))))
    return calls.select("seq_name", "pos1", "gene", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("n", "line"))


def gff3(calls: DataFrame, source: str = "organelia") -> DataFrame:
    """(seq_name, pos1, gene, n, line): the GFF3 lines of calls.

    Input: seq_name, contig_length, topology, type, gene, product, pos1, pos2, direction, genetic_code,
    note. A call over the origin of a circular contig ends at contig length + pos2.
    """
    wraps = (F.col("topology") == "circular") & (F.col("pos1") > F.col("pos2"))
    end = F.when(wraps, F.col("contig_length") + F.col("pos2")).otherwise(F.col("pos2"))
    row = lambda feature, phase, attributes: _tab(F.col("seq_name"), source, feature, F.col("pos1").cast("string"), end.cast("string"), ".", F.col("direction"), phase,
        attributes)
    kind, gene, product = F.col("type"), F.col("gene"), F.coalesce("product", F.lit(""))
    place = F.concat(F.col("seq_name"), F.lit(":"), F.col("pos1").cast("string"), F.lit(".."), F.col("pos2").cast("string"))
    # Fixed values below: the feature names and attributes of the file format.
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    cds = text("ID=cds-", gene, ";Parent=gene-", gene, ";Name=", gene, ";gbkey=CDS;gene=", gene, ";product=", product, ";transl_table=",
        F.col("genetic_code").cast("string"), F.coalesce(F.concat(F.lit(";Note="), F.col("note")), F.lit("")))
    lines = (
        F.when(kind == "PCG", F.array(row("gene", ".", text("ID=gene-", gene, ";Name=", gene, ";gbkey=Gene;gene=", gene, ";gene_biotype=protein_coding")), row("CDS", "0",
            cds)))
        .when(
            kind.isin("tRNA", "rRNA"),
            F.array(
                row(kind, ".", text("ID=rna-", place, ";Name=", gene, ";gbkey=", kind, ";product=", product)),
                row("exon", ".", text("ID=exon-", place, ";Parent=rna-", place, ";gbkey=", kind, ";product=", product)),
            ),
        )
        .when(kind == "ctrl", F.array(row("D_loop", ".", text("ID=exon-", place, ";gbkey=D-loop;Note=control region"))))
    )
    return calls.select("seq_name", "pos1", "gene", F.posexplode(lines).alias("n", "line"))


def gff3_heads(contigs: DataFrame, source: str = "organelia") -> DataFrame:
    """The version and region lines of each contig (seq_name, contig_length), to stand before its calls."""
    region = _tab(F.col("seq_name"), source, "region", "1", F.col("contig_length").cast("string"), ".", "+", ".", F.concat(F.lit("ID="), F.col("seq_name"), F.lit(":1.."),
        F.col("contig_length").cast("string"), F.lit(";Name=MT;mol_type=genomic DNA")))
    return contigs.select("seq_name", F.lit(0).cast("long").alias("pos1"), F.lit("").alias("gene"), F.posexplode(F.array(F.lit("##gff-version 3"), region)).alias("n",
        "line"))


def end_trimmed(calls: DataFrame, contigs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Linear contigs cut to their annotated span, with their calls shifted; circular contigs stay.

    ``contigs`` has topology and sequence. A contig without calls stays whole.
    """
    span = calls.groupBy(*keys).agg(F.min(F.least("pos1", "pos2")).alias("first"), F.max(F.greatest("pos1", "pos2")).alias("last"))
    c = contigs.join(span, list(keys), "left")
    linear = (F.col("topology") == "linear") & F.col("first").isNotNull()
    cut = c.withColumn("sequence", F.when(linear,
        F.substr("sequence", F.col("first").cast("int"), (F.col("last") - F.col("first") + 1).cast("int"))).otherwise(F.col("sequence")))
    cut = cut.withColumn("shift", F.when(linear, F.col("first") - 1).otherwise(0))
    moved = calls.join(cut.select(*keys, "shift"), list(keys)).withColumns({"pos1": F.col("pos1") - F.col("shift"), "pos2": F.col("pos2") - F.col("shift")}).drop("shift")
    return cut.drop("first", "last", "shift"), moved


def numbered(lines: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lines with their number within a file."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
