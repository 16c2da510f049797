"""From tool output to ordered gene calls on a rotated contig."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from organelia.functions import seq as S
from organelia.operators.intervals import flip_strand, rotate, rotate_reverse, span_length
from organelia.operators.windows import neighbours

# Amino acid codes of the tRNA table and their gene names.
TRNA_GENES = {
    "Ala": "trnA", "Cys": "trnC", "Asp": "trnD", "Glu": "trnE", "Phe": "trnF", "Gly": "trnG", "His": "trnH", "Ile": "trnI", "Lys": "trnK", "Leu": "trnL",
    "Met": "trnM", "Asn": "trnN", "Pro": "trnP", "Gln": "trnQ", "Arg": "trnR", "Ser": "trnS", "Thr": "trnT", "Val": "trnV", "Trp": "trnW", "Tyr": "trnY",
}
# Products of the protein genes.
PRODUCTS = {
    "atp6": "ATP synthase F0 subunit 6",
    "atp8": "ATP synthase F0 subunit 8",
    "atp9": "ATP synthase F0 subunit 9",
    "cob": "cytochrome b",
    "cox1": "cytochrome c oxidase subunit 1",
    "cox2": "cytochrome c oxidase subunit 2",
    "cox3": "cytochrome c oxidase subunit 3",
    "dpo": "DNA-polymerase",
    "lagli": "homing endonuclease",
    "msh1": "MutS mismatch DNA repair protein",
    "mttb": "trimethylamine methyltransferase",
    "nad1": "NADH dehydrogenase subunit 1",
    "nad2": "NADH dehydrogenase subunit 2",
    "nad3": "NADH dehydrogenase subunit 3",
    "nad4": "NADH dehydrogenase subunit 4",
    "nad4l": "NADH dehydrogenase subunit 4L",
    "nad5": "NADH dehydrogenase subunit 5",
    "nad6": "NADH dehydrogenase subunit 6",
}


def lookup(values: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def trna_calls(table: DataFrame) -> DataFrame:
    """Calls from a tRNA table: strand by the order of begin and end, gene and product by the amino acid."""
    return table.select(
        F.trim("seq").alias("contig"),
        F.lit("tRNA").alias("type"),
        lookup(TRNA_GENES, F.col("type")).alias("gene"),
        F.concat(F.lit("tRNA-"), F.col("type")).alias("product"),
        F.least("begin", "end").alias("pos1"),
        F.greatest("begin", "end").alias("pos2"),
        (F.abs(F.col("end") - F.col("begin")) + 1).alias("length"),
        F.when(F.col("begin") < F.col("end"), "+").otherwise("-").alias("direction"),
        "anticodon",
    )


def gene_type(gene: Column) -> Column:
    return F.when(gene.rlike("^rrn[LS]"), "rRNA").when(gene.startswith("Intron"), "intron").when(gene.startswith("OL"), "OL").when(gene.startswith("OH"),
        "ctrl").otherwise("PCG")


def gene_product(gene: Column) -> Column:
    return F.when(gene.startswith("rrnL"), "16S ribosomal RNA").when(gene.startswith("rrnS"), "12S ribosomal RNA").when(gene.startswith("OH"),
        "d-loop").otherwise(lookup(PRODUCTS, gene))


def gene_calls(headers: DataFrame, contigs: DataFrame, table: int, initiators: Sequence[str] = ()) -> DataFrame:
    """Calls from gene-call headers, with length, codons and translation from their contig (contig, sequence).

    Of several origin calls only the first part is kept. A call over the origin takes its bases from both
    ends. Calls whose contig is missing are kept without codons.
    """
    h = headers.where((F.col("gene") != "OH") | F.col("gene_id").rlike("OH_0|OH$")).withColumn("type", gene_type(F.col("gene"))).withColumn("product",
        gene_product(F.col("gene")))
    return with_codons(h.join(contigs.select("contig", "sequence"), "contig", "left"), table, initiators)


def with_codons(calls: DataFrame, table: int, initiators: Sequence[str] = ()) -> DataFrame:
    """Adds length, start and stop codon and translation to calls that carry their contig's ``sequence``."""
    seq, p1, p2, strand = F.col("sequence"), F.col("pos1"), F.col("pos2"), F.col("direction")
    pcg = F.col("type") == "PCG"
    d = calls.withColumn("length", span_length(p1, p2, F.length(seq)))
    coding = S.stranded(S.circular_subseq(seq, p1, p2), strand)
    d = d.withColumn("_coding", F.when(pcg, coding)).withColumn("_stop", S.partial_stop_length(F.length("_coding")))
    return d.withColumns(
        {
            "start_codon": F.substr("_coding", F.lit(1), F.lit(3)),
            "stop_codon": F.substr("_coding", F.length("_coding") - F.col("_stop") + 1),
            "translation": S.translate_codons(F.substr("_coding", F.lit(1), F.length("_coding") - F.col("_stop")), table, initiators),
        }
    ).drop("_coding", "_stop")


def combine(*calls: DataFrame) -> DataFrame:
    """All calls by name; columns that one lacks are NULL."""
    out = calls[0]
    for c in calls[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def start_points(calls: DataFrame, keys: Sequence[str], gene: str) -> DataFrame:
    """Where each contig is to be cut: the first call of the start gene by position."""
    return (
        calls.where(F.col("gene") == gene)
        .groupBy(*keys)
        .agg(F.min_by(F.struct("pos1", "pos2", "direction"), F.struct("pos1", "pos2", "direction")).alias("s"))
        .select(*keys, F.col("s.pos1").alias("cut1"), F.col("s.pos2").alias("cut2"), F.col("s.direction").alias("cut_strand"))
    )


def rotated_calls(calls: DataFrame, starts: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """Calls of circular contigs after rotation to their start gene; contigs without one stay as they are."""
    d = calls.join(starts, list(keys), "left")
    n = F.col(length)
    f1, f2 = rotate(F.col("pos1"), F.col("pos2"), F.col("cut1"), n)
    r1, r2 = rotate_reverse(F.col("pos1"), F.col("pos2"), F.col("cut2"), n)
    back = F.col("cut_strand") == "-"
    return d.withColumns(
        {
            "pos1": F.when(F.col("cut1").isNull(), F.col("pos1")).when(back, r1).otherwise(f1),
            "pos2": F.when(F.col("cut1").isNull(), F.col("pos2")).when(back, r2).otherwise(f2),
            "direction": F.when(back, flip_strand(F.col("direction"))).otherwise(F.col("direction")),
        }
    ).drop("cut1", "cut2", "cut_strand")


def rotated_sequence(sequence: Column, cut1: Column, cut2: Column, strand: Column) -> Column:
    """The contig itself after that rotation."""
    forward = F.concat(F.substr(sequence, cut1.cast("int")), F.substr(sequence, F.lit(1), (cut1 - 1).cast("int")))
    back = S.reverse_complement(F.concat(F.substr(sequence, (cut2 + 1).cast("int")), F.substr(sequence, F.lit(1), cut2.cast("int"))))
    return F.when(cut1.isNull(), sequence).when(strand == "-", back).otherwise(forward)


def rotated_positions(position: Column, length: Column, cut1: Column, cut2: Column, strand: Column) -> Column:
    """New position of each base of a per-base track; no row moves."""
    return F.when(cut1.isNull(), position).when(strand == "-", F.pmod(cut2 - position, length) + 1).otherwise(F.pmod(position - cut1, length) + 1)


def control_regions(calls: DataFrame, keys: Sequence[str], length: str, drop_overlapping: bool = False) -> DataFrame:
    """Origin calls widened to the gap between their neighbours and named ``ctrl``.

    The first call of a contig starts at 1 and the last ends with the contig. ``drop_overlapping`` removes
    origin calls that overlap a neighbour before.
    """
    near = lambda d: neighbours(d, keys, ["pos1", "pos2", "gene", "direction", "type"], {"_before": "pos2"}, {"_after": "pos1"})
    d = near(calls)
    origin = F.col("gene") == "OH"
    if drop_overlapping:
        clear = (F.coalesce("_before", F.lit(0)) < F.col("pos1")) & (F.coalesce("_after", F.col("pos2") + 1) > F.col("pos2"))
        d = near(d.where(~origin | clear).drop("_before", "_after"))
    p1 = F.when(origin, F.coalesce(F.col("_before") + 1, F.lit(1))).otherwise(F.col("pos1"))
    p2 = F.when(origin, F.coalesce(F.col("_after") - 1, F.col(length))).otherwise(F.col("pos2"))
    return d.withColumns({"pos1": p1, "pos2": p2, "length": F.when(origin, F.abs(p2 - p1) + 1).otherwise(F.col("length")), "gene": F.when(origin,
        "ctrl").otherwise(F.col("gene"))}).drop("_before", "_after")
