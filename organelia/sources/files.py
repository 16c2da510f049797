"""Readers for the file formats of an assembly and annotation project."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from organelia.session import ship

READ_COUNT_SCHEMA = "seq_id string, position long, ref_base string, depth long, eq string, a string, c string, g string, t string, n string"
STATS_SCHEMA = "seq_id string, position long, call string, depth double, correct double, error_rate string, mean_depth string, gc double"


def mapping_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sample sheet with a header; all columns are text, so an id keeps its zeros."""
    return split_csv(spark, path)


def split_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header line a file, all columns as text; quotes and quoted line breaks are read."""
    return spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"')


def contig_key(name: Column) -> list[Column]:
    """``ID.path.scaffold`` as three columns, split from the right: an id may hold dots."""
    pattern = r"^(.*)\.(\d+)\.(\d+)$"
    found = name.rlike(pattern)
    return [
        F.when(found, F.regexp_extract(name, pattern, 1)).otherwise(name).alias("id"),
        F.when(found, F.regexp_extract(name, pattern, 2).cast("int")).alias("path"),
        F.when(found, F.regexp_extract(name, pattern, 3).cast("int")).alias("scaffold"),
    ]


def fasta(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(header, sequence) of each record. Records are split by the reader, so a large file is read by many tasks.

    Lines of a sequence are joined; a record without bases has an empty sequence. Text before the first
    ``>`` and blank records are left out.
    """
    reader = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    record = F.regexp_replace("value", r"^>", "")
    body = F.regexp_extract(record, r"(?s)^[^\n]*\n(.*)$", 1)
    return reader.text(path).select(F.rtrim(F.regexp_extract(record, r"^([^\r\n]*)", 1)).alias("header"), F.regexp_replace(body, r"\s+",
        "").alias("sequence")).where("header <> ''")


def assemblies_fasta(spark: SparkSession, path: str, **options) -> DataFrame:
    """(id, path, scaffold, topology, sequence) from headers ``ID.path.scaffold topology``; the marker of a failed assembly gives no row."""
    name = F.regexp_extract("header", r"^(\S+)", 1)
    topology = F.regexp_extract("header", r"\s(circular|linear)", 1)
    return fasta(spark, path, **options).where("header <> 'No assembly found'").select(*contig_key(name), F.nullif(topology, F.lit("")).alias("topology"), "sequence")


def protein_fasta(spark: SparkSession, path: str, **options) -> DataFrame:
    """(acc, gene, strand, start, end, taxon, sequence) from headers ``ACC:gene-strand-start-end Taxon``; the first record of an accession and gene counts."""
    p = r"^([^:\s]+):(.+?)-([+-]|[^-\s]*)-(\d+)-(\d+)\s*(.*)$"
    part = lambda i: F.regexp_extract("header", p, i)
    return fasta(spark, path, **options).select(
        F.regexp_extract("header", r"^([^:\s]+)", 1).alias("acc"), part(2).alias("gene"), part(3).alias("strand"), part(4).try_cast("long").alias("start"),
            part(5).try_cast("long").alias("end"), part(6).alias("taxon"), "sequence"
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, position, call, depth, correct, error_rate) per base; ``correct`` is the count of the reference base.

    A call other than A, C, G, T has no correct count; at depth 0 the error rate is NULL.
    """
    raw = spark.read.csv(path, sep="\t", header=False, schema=READ_COUNT_SCHEMA)
    count = lambda c: F.split(c, ":")[1].try_cast("double")
    correct = F.when(F.col("ref_base") == "A", count("a")).when(F.col("ref_base") == "C", count("c")).when(F.col("ref_base") == "G",
        count("g")).when(F.col("ref_base") == "T", count("t"))
    return raw.select("seq_id", "position", F.col("ref_base").alias("call"), F.col("depth").cast("double").alias("depth"),
        correct.alias("correct")).withColumn("error_rate", F.try_divide(F.col("depth") - F.col("correct"), F.col("depth")))


def coverage_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per-base statistics with ``#`` marks read into values and one mask."""
    raw = spark.read.csv(path, header=True, schema=STATS_SCHEMA)
    value = lambda c: F.regexp_replace(c, "^#", "").try_cast("double")
    marked = lambda c: F.coalesce(F.startswith(c, F.lit("#")), F.lit(False))
    return raw.select("seq_id", "position", "call", "depth", "correct", value(F.col("error_rate")).alias("error_rate"), value(F.col("mean_depth")).alias("mean_depth"),
        "gc", (marked(F.col("mean_depth")) | marked(F.col("error_rate"))).alias("mask"))


def trna_table(spark: SparkSession, path: str) -> DataFrame:
    """(seq, idx, begin, end, type, anticodon, intron_begin, intron_end, score, notes); the three header lines are told by their text, so files may be read in parts."""
    cells = F.split("value", "\t")
    at = lambda i: F.trim(F.get(cells, F.lit(i)))
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(Sequence|Name|-{4,})\b|^-{4,}") & (F.trim("value") != ""))
    return lines.select(
        at(0).alias("seq"), at(1).try_cast("int").alias("idx"), at(2).try_cast("long").alias("begin"), at(3).try_cast("long").alias("end"), at(4).alias("type"),
            at(5).alias("anticodon"),
        at(6).try_cast("long").alias("intron_begin"), at(7).try_cast("long").alias("intron_end"), at(8).try_cast("double").alias("score"), at(9).alias("notes"),
    )


def gene_call_headers(spark: SparkSession, path: str, **options) -> DataFrame:
    """(contig, pos1, pos2, direction, gene_id, gene) from headers ``contig; p1-p2; strand; gene``."""
    p = r"^(.*?)\s*;\s*(\d+)-(\d+)\s*;\s*([+-])\s*;\s*(\S+)\s*$"
    part = lambda i: F.regexp_extract("header", p, i)
    return (
        fasta(spark, path, **options)
        .where(F.col("header").rlike(p))
        .select(part(1).alias("contig"), part(2).cast("long").alias("pos1"), part(3).cast("long").alias("pos2"), part(4).alias("direction"), part(5).alias("gene_id"),
            F.regexp_extract(part(5), r"^[a-zA-Z0-9]+", 0).alias("gene"))
    )


def search_hits(spark: SparkSession, path: str, with_sequence: bool = False) -> DataFrame:
    """(acc, taxon, eval) from tabular search output ``title<TAB>e-value``; ``with_sequence`` also (target) from a third column."""
    raw = spark.read.csv(path, sep="\t", header=False, schema="hit string, eval double" + (", target string" if with_sequence else ""))
    return raw.select(F.regexp_extract("hit", r"^[^:]+", 0).alias("acc"), F.regexp_replace("hit", r"^\S+ ", "").alias("taxon"), "eval",
        *(["target"] if with_sequence else []))


def trimming_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(reads, trimmed_reads, mean_length) from read-trimming JSON, a document a file or, with ``lines``, a line; a count that is no number is NULL."""
    schema = "summary struct<before_filtering: struct<total_reads: string>, after_filtering: struct<total_reads: string, read1_mean_length: string>>"
    s = spark.read.schema(schema).json(path, multiLine=not lines, primitivesAsString=True)
    return s.select(
        F.col("summary.before_filtering.total_reads").try_cast("long").alias("reads"),
        F.col("summary.after_filtering.total_reads").try_cast("long").alias("trimmed_reads"),
        F.col("summary.after_filtering.read1_mean_length").try_cast("long").alias("mean_length"),
    )


def assembly_summary(spark: SparkSession, path: str) -> DataFrame:
    """An assembler's summary table with ``topology`` from its column ``circular``."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.withColumn("topology", F.when(F.lower("circular") == "yes", "circular").otherwise("linear"))


def config_values(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, value) of ``name = value`` lines; quotes around a value are removed."""
    p = rf"""^\s*(?:params\.)?({"|".join(map(re.escape, names))})\s*=\s*['"]?([^'"\r\n]*?)['"]?\s*$"""
    return spark.read.text(path).where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("name"), F.regexp_extract("value", p, 2).alias("value"))


def files_of(spark: SparkSession, folder: str, pattern: str = "*", name: str | None = None) -> DataFrame:
    """(path, length, modified) of the files below a folder whose name matches a glob and, if given, the whole of a regular expression; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    df = df.select("path", "length", F.col("modificationTime").alias("modified"))
    return df if name is None else df.where(F.regexp_extract("path", r"[^/]*$", 0).rlike(f"^(?:{name})$"))


def fasta_summary(records: DataFrame) -> DataFrame:
    """(n, n_names, shortest, longest, bases) of FASTA records."""
    n = F.length("sequence")
    return records.agg(F.count("*").alias("n"), F.count_distinct("header").alias("n_names"), F.min(n).alias("shortest"), F.max(n).alias("longest"),
        F.sum(n.cast("long")).alias("bases"))


_GENBANK = "name string, definition string, organism string, organelle string, n_features int, features map<string,int>, products array<string>, sequence string"


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """Records of GenBank flat files: name, source organelle, counts of features by type, first products, sequence.

    The reader splits at ``//``; each record is parsed by itself in Arrow batches.
    """

    def parse(text: str) -> tuple | None:
        if "LOCUS" not in text:
            return None
        head, _, origin = text.partition("\nORIGIN")
        table = re.split(r"\nFEATURES[^\n]*\n", head, maxsplit=1)
        one = lambda p, s: (m := re.search(p, s, re.M)) and m.group(1).strip() or None
        types: dict[str, int] = {}
        for m in re.finditer(r"^ {5}(\S+)\s", table[1] if len(table) > 1 else "", re.M):
            types[m.group(1)] = types.get(m.group(1), 0) + 1
        body = table[1] if len(table) > 1 else ""
        products = [" ".join(p.split()) for p in re.findall(r'/product="([^"]*)"', body)]
        return (one(r"^LOCUS\s+(\S+)", head), one(r"^DEFINITION\s+(.*)$", head), one(r"^  ORGANISM\s+(.*)$", head), one(r'/organelle="([^"]*)"', body),
            sum(types.values()), list(types.items()), products, re.sub(r"[^A-Za-z]", "", origin).upper())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for t in f["value"] if t is not None and (r := parse("\n" + t)) is not None]
            if rows:
                yield pd.DataFrame([dict(zip(("name", "definition", "organism", "organelle", "n_features", "features", "products", "sequence"), (*r[:5], dict(r[5]),
                    *r[6:]), strict=True)) for r in rows])

    ship(spark)
    return spark.read.option("lineSep", "\n//").text(path).mapInPandas(run, _GENBANK)


def genbank_classes(records: DataFrame) -> DataFrame:
    """Records with a class by their genes (none, single, multi), the first of equal sequences only."""
    genes = F.coalesce(F.try_element_at("features", F.lit("gene")), F.lit(0)) + F.coalesce(F.try_element_at("features", F.lit("rRNA")), F.lit(0))
    kept = records.groupBy(F.sha2("sequence", 256).alias("h")).agg(F.min_by(F.struct(*records.columns), "name").alias("r")).select("r.*")
    return kept.withColumn("class", F.when(genes == 0, "none").when(genes == 1, "single").otherwise("multi"))
