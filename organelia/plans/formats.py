"""The readers and writers as queries: the tables are written in each file format and read back, and the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from organelia.functions import text as X
from organelia.functions.stamps import file_name
from organelia.plans import annotate as A
from organelia.plans import coverage as C
from organelia.plans.engine import _CODING, _CONTIGS, _STATS, _TRACK, CODE, CONTIG, ORACLE as _ENGINE_SQL, _calls_sql, calls, contigs, project_snapshot, sequences, track
from organelia.plans.models import _SAMPLES, samples
from organelia.plans.sql_tables import amino_sql
from organelia.session import scratch, table
from organelia.sinks import files as K
from organelia.sources import files as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


_NAME = "id || '.' || path || '.' || scaffold"


def _name():
    return F.concat_ws(".", *[F.col(c).cast("string") for c in CONTIG])


def _keyed(df: DataFrame) -> DataFrame:
    return df.where("id is not null and path is not null and scaffold is not null")


_KEYED = "id IS NOT NULL AND path IS NOT NULL AND scaffold IS NOT NULL"


def _fasta_file(spark, base) -> str:
    d = _keyed(sequences(spark, base)).select(_name().alias("name"), "topology", "sequence").distinct().withColumn("wrapped", X.wrap_lines(F.col("sequence")))
    path = scratch(spark, "contigs.fasta")
    K.write_lines(K.fasta_from_template(d, "{name} {topology}", "wrapped"), path)
    return path


@_query(
    f"""SELECT DISTINCT id, path, scaffold, CASE WHEN topology IN ('circular', 'linear') THEN topology END AS topology, length(sequence)::INT AS bases,
  md5(upper(sequence)) AS sequence_md5
FROM assemblies WHERE sequence IS NOT NULL AND {_KEYED}"""
)
def scan_fasta(spark, base):
    """Contigs as FASTA of 80 columns, and back."""
    d = R.assemblies_fasta(spark, _fasta_file(spark, base))
    return d.select("id", F.col("path").cast("int"), F.col("scaffold").cast("int"), "topology", F.length("sequence").alias("bases"),
        F.md5("sequence").alias("sequence_md5")).distinct()


@_query(
    f"""WITH d AS (SELECT DISTINCT {_NAME} || ' ' || coalesce(topology, 'NA') AS header, upper(sequence) AS sequence FROM assemblies WHERE sequence IS NOT NULL
  AND {_KEYED})
SELECT count(*) AS n, count(DISTINCT header) AS n_names, min(length(sequence))::INT AS shortest, max(length(sequence))::INT AS longest,
  sum(length(sequence))::BIGINT AS bases FROM d"""
)
def fasta_counts(spark, base):
    return R.fasta_summary(R.fasta(spark, _fasta_file(spark, base)))


_PROTEIN = "type = 'PCG' AND translation <> '' AND direction IS NOT NULL AND gene IS NOT NULL AND pos1 IS NOT NULL AND pos2 IS NOT NULL"


@_query(f"SELECT DISTINCT 'P' || substr(md5(translation), 1, 12) AS acc, gene, direction AS strand, pos1 AS start, pos2 AS \"end\", 'Taxon ' || gene AS taxon, md5(translation) AS protein_md5 FROM annotations WHERE {_PROTEIN}")
def scan_proteins(spark, base):
    """Proteins as FASTA with the headers of a reference file, and back."""
    d = table(spark, base, "annotations").where(_PROTEIN).select("gene", "direction", "pos1", "pos2", "translation").distinct().withColumn("acc", F.concat(F.lit("P"),
        F.substr(F.md5("translation"), F.lit(1), F.lit(12))))
    path = scratch(spark, "proteins.fas")
    K.write_lines(K.fasta_from_template(d, "{acc}:{gene}-{direction}-{pos1}-{pos2} Taxon {gene}", "translation"), path)
    return R.protein_fasta(spark, path).select("acc", "gene", "strand", "start", "end", "taxon", F.md5("sequence").alias("protein_md5"))


_BLOCKS = ("A", "C", "G", "T")


@_query(
    f"""WITH {_TRACK}, c AS (SELECT {_NAME} AS seq_id, position, call, depth::BIGINT AS depth, greatest(depth::BIGINT - position % 3, 0) AS correct FROM track
  WHERE {_KEYED})
SELECT seq_id, position, call, coalesce(depth, 0)::DOUBLE AS depth, CASE WHEN depth IS NULL THEN 0 WHEN call IN ('A', 'C', 'G', 'T') THEN correct END::DOUBLE AS correct,
 CASE WHEN call IN ('A', 'C', 'G', 'T') AND depth > 0 THEN (depth - correct) / depth END AS error_rate FROM c"""
)
def scan_read_counts(spark, base):
    """Per-base counts as a table of blocks, and back, with a row for every base that has no count."""
    t = _keyed(track(spark, base)).withColumn("seq_id", _name())
    depth = F.col("depth").cast("long")
    right = F.greatest(depth - F.col("position") % 3, F.lit(0))
    block = lambda b: F.concat(F.lit(f"{b}:"), F.when(F.col("call") == b, right).otherwise(0).cast("string"), F.lit(":0.0"))
    line = F.concat_ws("\t", "seq_id", F.col("position").cast("string"), "call", depth.cast("string"), F.lit("=:0"), *[block(b) for b in _BLOCKS], F.lit("N:0"))
    path = scratch(spark, "counts.tsv")
    K.write_lines(t.where("depth is not null").select(line.alias("line")), path)
    whole = t.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "call"))), lambda x: x["call"]), "").alias("sequence"))
    return C.fill_gaps(R.read_counts(spark, path), whole)


@_query(
    f"""WITH {_TRACK}, {_STATS} SELECT {_NAME} AS seq_id, position, call, mean_depth, error_rate, gc, coalesce(mean_depth_mask AND mean_depth IS NOT NULL OR error_rate_mask AND error_rate IS NOT NULL, false) AS mask FROM stats WHERE {_KEYED}"""
)
def scan_statistics(spark, base):
    """Coverage statistics as delimited text with masked values marked, and back."""
    s = _keyed(C.statistics(track(spark, base), CONTIG)).withColumn("seq_id", _name())
    path = scratch(spark, "stats.csv")
    K.write_csv(C.encoded(s, ["seq_id"]), path)
    return R.coverage_stats(spark, path).select("seq_id", "position", "call", "mean_depth", "error_rate", "gc", "mask")


# Amino acid codes by the letter of the tRNA gene.
_AMINO = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu",
    "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val", "W": "Trp", "Y": "Tyr",
}
_AMINO_SQL = "CASE substr(gene, 4) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AMINO.items()) + " END"
# The table tells the strand by the order of begin and end, so a call over the origin can't be written in it.
_TRNA = f"type = 'tRNA' AND pos1 < pos2 AND pos1 > 0 AND direction IS NOT NULL AND gene IS NOT NULL AND {_KEYED}"


@_query(
    f"""SELECT DISTINCT {_NAME} AS contig, 'tRNA' AS type, gene, 'tRNA-' || {_AMINO_SQL} AS product, pos1, pos2, pos2 - pos1 + 1 AS length, direction, coalesce(anticodon, '') AS anticodon FROM annotations WHERE {_TRNA}"""
)
def scan_trna_table(spark, base):
    """tRNA calls as a search tool's table of three header lines, and back as calls."""
    d = table(spark, base, "annotations").where(_TRNA).select(_name().alias("contig"), "gene", "pos1", "pos2", "direction", "anticodon").distinct()
    back = F.col("direction") == "-"
    begin, end = F.when(back, F.col("pos2")).otherwise(F.col("pos1")), F.when(back, F.col("pos1")).otherwise(F.col("pos2"))
    kind = A.lookup(_AMINO, F.substr("gene", F.lit(4)))
    line = F.concat_ws("\t", F.concat("contig", F.lit(" ")), F.lit("1"), begin.cast("string"), end.cast("string"), kind, F.coalesce("anticodon", F.lit("")), F.lit("0"),
        F.lit("0"), F.lit("50.5"), F.lit(""))
    path = scratch(spark, "trna.tsv")
    heads = spark.createDataFrame([("Sequence\t\ttRNA\tBounds",), ("Name\ttRNA #\tBegin\tEnd",), ("--------\t------\t-----\t---",)], "line string")
    K.write_lines(heads.unionAll(d.select(line.alias("line"))), path)
    return A.trna_calls(R.trna_table(spark, path)).select("contig", "type", "gene", "product", "pos1", "pos2", "length", "direction", "anticodon")


_HEADED = f"type IN ('PCG', 'rRNA', 'ctrl') AND {_KEYED}"


@_query(
    f"""WITH {_calls_sql()}, {_CONTIGS}, d AS (SELECT *, {_NAME} AS contig, CASE WHEN gene = 'ctrl' THEN 'OH' ELSE gene END AS g FROM calls WHERE {_HEADED}),
j AS (SELECT d.contig, CASE WHEN g LIKE 'rrn%' THEN 'rRNA' WHEN g = 'OH' THEN 'ctrl' ELSE 'PCG' END AS kind, g, pos1, pos2, direction, length(sequence) AS n, CASE
  WHEN sequence IS NOT NULL THEN {_CODING} END AS coding FROM d LEFT JOIN contigs USING (id, path, scaffold)),
k AS (SELECT *, CASE WHEN kind = 'PCG' THEN CASE WHEN length(coding) % 3 = 0 THEN 3 ELSE length(coding) % 3 END END AS k FROM j)
SELECT contig, kind AS type, g AS gene, pos1, pos2, direction, CASE WHEN pos1 <= pos2 THEN pos2 - pos1 + 1 ELSE n - pos1 + 1 + pos2 END::BIGINT AS length,
 CASE WHEN kind = 'PCG' THEN substr(coding, 1, 3) END AS start_codon, CASE WHEN kind = 'PCG' THEN substr(coding, length(coding) - k + 1) END AS stop_codon,
 CASE WHEN kind = 'PCG' THEN md5(array_to_string(list_transform(range(0, (length(coding) - k) // 3), lambda i: {amino_sql('substr(coding, (3 * i + 1)::INT, 3)')}),
   '')) END AS translation_md5 FROM k"""
)
def scan_gene_calls(spark, base):
    """Protein, rRNA and origin calls as FASTA headers of a gene finder, and back as calls with codons and translation."""
    d = calls(spark, base).where(_HEADED).withColumn("contig", _name())
    shown = F.when(F.col("gene") == "ctrl", "OH_0").otherwise(F.col("gene"))
    head = F.concat_ws("; ", "contig", F.concat(F.col("pos1").cast("string"), F.lit("-"), F.col("pos2").cast("string")), "direction", shown)
    path = scratch(spark, "result.fas")
    K.write_lines(d.select(K.fasta_lines(head, F.lit("N")).alias("line")), path)
    named = _keyed(contigs(spark, base)).select(_name().alias("contig"), "sequence")
    found = A.combine(A.gene_calls(R.gene_call_headers(spark, path), named, CODE))
    return found.select("contig", "type", "gene", "pos1", "pos2", "direction", F.col("length").cast("long").alias("length"), "start_codon", "stop_codon",
        F.md5("translation").alias("translation_md5"))


@_query("SELECT DISTINCT 'P' || substr(md5(translation), 1, 12) AS acc, 'Taxon ' || gene AS taxon, length(translation) / 8 AS eval, md5(translation) AS target_md5 FROM annotations WHERE type = 'PCG' AND translation <> '' AND gene IS NOT NULL")
def scan_search_hits(spark, base):
    """Search hits with their sequence as a table, and back."""
    d = table(spark, base, "annotations").where("type = 'PCG' and translation <> '' and gene is not null").select("gene", "translation").distinct()
    title = F.concat(F.lit("P"), F.substr(F.md5("translation"), F.lit(1), F.lit(12)), F.lit(":"), "gene", F.lit("-+-1-9 Taxon "), "gene")
    path = scratch(spark, "hits.tsv")
    K.write_lines(d.select(F.concat_ws("\t", title, (F.length("translation") / 8).cast("string"), "translation").alias("line")), path)
    return R.search_hits(spark, path, True).select("acc", "taxon", "eval", F.md5("target").alias("target_md5")).distinct()


@_query("SELECT reads, trimmed_reads, mean_length, count(*) AS n FROM preprocess GROUP BY ALL")
def scan_trimming(spark, base):
    """Read-trimming reports as JSON, and back."""
    p = table(spark, base, "preprocess")
    doc = F.struct(F.struct(F.struct(F.col("reads").alias("total_reads")).alias("before_filtering"), F.struct(F.col("trimmed_reads").alias("total_reads"),
        F.col("mean_length").alias("read1_mean_length")).alias("after_filtering")).alias("summary"))
    path = scratch(spark, "trimming.json")
    K.write_lines(p.select(F.to_json(doc).alias("line")), path)
    return R.trimming_report(spark, path, lines=True).groupBy("reads", "trimmed_reads", "mean_length").agg(F.count("*").alias("n"))


@_query("SELECT DISTINCT id AS name, CASE WHEN topology = 'circular' THEN 'circular' ELSE 'linear' END AS topology FROM assemblies WHERE id IS NOT NULL")
def scan_summary(spark, base):
    """An assembler's summary as a tab-separated table, and back."""
    d = table(spark, base, "assemblies").where("id is not null").select(F.col("id").alias("name"), F.when(F.col("topology") == "circular",
        "yes").otherwise("no").alias("circular")).distinct()
    path = scratch(spark, "summary.tsv")
    K.write_csv(d, path, sep="\t", quoted=False)
    return R.assembly_summary(spark, path).select("name", "topology")


@_query("SELECT name, value, count(*) AS n FROM (SELECT 'cpus' AS name, cpus::VARCHAR AS value FROM pre_opts UNION ALL SELECT 'fastp', fastp FROM pre_opts WHERE fastp IS NOT NULL) GROUP BY ALL")
def scan_config(spark, base):
    """Settings as lines of a configuration, and back."""
    o = table(spark, base, "pre_opts")
    lines = F.explode(F.array(F.concat(F.lit("params.cpus = "), F.col("cpus").cast("string")), F.concat(F.lit("  fastp = '"), "fastp", F.lit("'")), F.lit("other = 1")))
    path = scratch(spark, "run.config")
    K.write_lines(o.select(lines.alias("line")).where("line is not null"), path)
    return R.config_values(spark, path, ["cpus", "fastp"]).groupBy("name", "value").agg(F.count("*").alias("n"))


@_query("SELECT name FROM (VALUES ('pre_opts.parquet'), ('assemble_opts.parquet'), ('curate_opts.parquet')) v(name)")
def scan_files(spark, base):
    """The option tables of the data folder, found by a pattern of their file names."""
    return R.files_of(spark, base, name=r"\w+_opts\.parquet").select(F.regexp_extract("path", r"[^/]*$", 0).alias("name"))


@_query(f"{_SAMPLES} SELECT id AS \"ID\", taxon AS \"Taxon\", r1 AS \"R1\", r2 AS \"R2\" FROM samples")
def scan_sheet(spark, base):
    """The samples as a sheet, quoted where they must be, and back as text."""
    d = samples(table(spark, base, "mapping_test")).select(F.col("id").alias("ID"), F.col("taxon").alias("Taxon"), F.col("r1").alias("R1"), F.col("r2").alias("R2"))
    path = scratch(spark, "mapping.csv")
    K.write_csv(d, path)
    return R.mapping_sheet(spark, path)


@_query(
    f"""WITH {_calls_sql("product")}, {_CONTIGS}, f AS (SELECT id, path, scaffold, pos1, pos2, gene, type, max(product) AS product FROM calls GROUP BY ALL),
n AS (SELECT id, path, scaffold, count(*) AS n, string_agg(product, '|' ORDER BY pos1, pos2, gene, type) FILTER (product IS NOT NULL) AS products FROM f GROUP BY ALL),
r AS (SELECT {_NAME} AS name, sequence, coalesce(n, 0) AS genes, products FROM contigs LEFT JOIN n USING (id, path, scaffold) WHERE {_KEYED}),
k AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(sequence, '[^A-Z]', '', 'g') ORDER BY name) AS i FROM r)
SELECT name, (2 * genes + 1)::INT AS n_features, CASE WHEN genes = 0 THEN 'none' WHEN genes = 1 THEN 'single' ELSE 'multi' END AS class, coalesce(products,
  '') AS products, md5(sequence) AS sequence_md5 FROM k WHERE i = 1"""
)
def scan_genbank(spark, base):
    """Contigs and their calls as GenBank records, and back, the first of equal sequences with its class."""
    gap = F.lit(" " * 21)
    c = calls(spark, base, "product").groupBy(*CONTIG, "pos1", "pos2", "gene", "type").agg(F.max("product").alias("product"))
    place = F.concat(F.col("pos1").cast("string"), F.lit(".."), F.col("pos2").cast("string"))
    kept = F.concat(F.lit("     gene            "), place, F.lit("\n"), gap, F.lit('/gene="'), F.coalesce("gene", F.lit("")), F.lit('"\n     CDS             '), place,
        F.lit("\n"), F.coalesce(F.concat(gap, F.lit('/product="'), "product", F.lit('"\n')), F.lit("")))
    # A record is one text: the calls of a contig stand in it.
    features = c.withColumn("t",
        kept).groupBy(*CONTIG).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos1", "pos2", "gene", "type", "t"))), lambda x: x["t"]),
        "").alias("features"))
    d = _keyed(contigs(spark, base)).join(features, CONTIG, "left").withColumn("name", _name())
    head = F.concat(F.lit("LOCUS       "), "name", F.lit("  bp DNA\nDEFINITION  contig.\nFEATURES             Location/Qualifiers\n     source          1..9\n"), gap,
        F.lit('/organelle="mitochondrion"\n'))
    line = F.concat(head, F.coalesce("features", F.lit("")), F.lit("ORIGIN\n        1 "), F.lower("sequence"), F.lit("\n//"))
    path = scratch(spark, "contigs.gb")
    K.write_lines(d.select(line.alias("line")), path)
    r = R.genbank_classes(R.genbank(spark, path))
    return r.select("name", "n_features", "class", F.array_join("products", "|").alias("products"), F.md5("sequence").alias("sequence_md5"))


@_query("SELECT gene, count(*) AS n FROM (SELECT DISTINCT gene, translation FROM annotations WHERE type = 'PCG' AND translation <> '' AND gene IS NOT NULL) GROUP BY gene")
def gene_files(spark, base):
    """Proteins in one folder of FASTA files a gene, and how many records each then has."""
    d = table(spark, base, "annotations").where("type = 'PCG' and translation <> '' and gene is not null").select("gene", "translation").distinct()
    path = scratch(spark, "genes")
    K.write_lines(K.fasta_from_template(d, "{gene}", "translation"), path, by="gene", order=["translation"])
    return spark.read.text(path).where("value like '>%'").groupBy("gene").agg(F.count("*").alias("n"))


@_query(
    f"SELECT id, reads::VARCHAR AS reads, nullif(assembly_topology, '') AS assembly_topology, nullif(assembly_length, '') AS assembly_length, pcgcount::VARCHAR AS pcgcount, nullif(missing, '') AS missing FROM ({_ENGINE_SQL['project_snapshot']})"
)
def snapshot_file(spark, base):
    """The project as delimited text under a name with the time in it, and back."""
    path = f"{scratch(spark, 'snapshots')}/{file_name('project', 'csv')}"
    K.write_csv(project_snapshot(spark, base), path)
    return R.split_csv(spark, path)
