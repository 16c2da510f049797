"""Refining gene boundaries: strand, punctuation, reference proteins, stop codons."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from organelia.functions.align import compare_many, may_reach
from organelia.functions.seq import BASES, COMPLEMENTS, genetic_code
from organelia.functions.text import append_note
from organelia.operators.intervals import flip, flip_strand
from organelia.operators.windows import neighbours
from organelia.session import ship

_COMPLEMENT = str.maketrans(BASES, COMPLEMENTS)


def reversed_contigs(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contigs whose rRNA calls all lie on the minus strand."""
    return calls.where("type = 'rRNA'").groupBy(*keys).agg(F.bool_and(F.col("direction") == "-").alias("r")).where("r").select(*keys)


def flipped_calls(calls: DataFrame, contigs: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """Calls with those of the given contigs moved to the reverse complement."""
    d = calls.join(contigs.select(*keys).withColumn("_flip", F.lit(True)), list(keys), "left")
    p1, p2 = flip(F.col("pos1"), F.col("pos2"), F.col(length))
    on = F.coalesce("_flip", F.lit(False))
    return d.withColumns({"pos1": F.when(on, p1).otherwise(F.col("pos1")), "pos2": F.when(on, p2).otherwise(F.col("pos2")), "direction": F.when(on,
        flip_strand(F.col("direction"))).otherwise(F.col("direction"))}).drop("_flip")


def punctuated(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rRNA ends snapped to adjacent tRNAs, unless the call would grow beyond its ``max_len`` (NULL: no limit).

    Adds to ``notes`` what was moved. Neighbours are those by (pos1, pos2, gene, direction, type) on the contig.
    """
    d = neighbours(calls, keys, ["pos1", "pos2", "gene", "direction", "type"], {"_bt": "type", "_b2": "pos2"}, {"_at": "type", "_a1": "pos1"})
    limit = F.coalesce("max_len", F.lit(1 << 60))
    rrna = F.col("type") == "rRNA"
    new1 = F.when(rrna & (F.col("_bt") == "tRNA") & (F.col("_b2") + 1 != F.col("pos1")) & (F.col("pos2") - F.col("_b2") <= limit), F.col("_b2") + 1)
    d = d.withColumn("_n1", new1).withColumn("_p1", F.coalesce("_n1", "pos1"))
    new2 = F.when(rrna & (F.col("_at") == "tRNA") & (F.col("_a1") - 1 != F.col("pos2")) & (F.col("_a1") - F.col("_p1") <= limit), F.col("_a1") - 1)
    d = d.withColumn("_n2", new2)
    # Fixed value: the text of the note.
    note = lambda what, by: F.when(by.isNotNull(), F.concat(F.lit(f"Applied punctuation model - moved {what} by "), by.cast("string"), F.lit(" bp")))
    notes = append_note(append_note(F.col("notes"), note("pos1", F.col("_n1") - F.col("pos1"))), note("pos2", F.col("_n2") - F.col("pos2")))
    d = d.withColumns({"notes": notes, "pos1": F.col("_p1"), "pos2": F.coalesce("_n2", "pos2")})
    return d.withColumn("length", F.when(rrna, F.abs(F.col("pos2") - F.col("pos1")) + 1).otherwise(F.col("length"))).drop("_bt", "_b2", "_at", "_a1", "_n1", "_n2", "_p1")


def trimmed_stops(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stop codons shortened where exactly one call on the same strand begins within them.

    Input: pos1, pos2, direction, type, stop_codon, stop_codons, overlap_stop. A stop may be shortened only
    to one that the rules list, and not where the rules allow the overlap. The join is on the contig and
    the position bucket of the codon: a codon is at most three positions.
    """
    d = calls.withColumn("_row", F.struct(*[F.col(c) for c in (*keys, "pos1", "pos2", "gene")]))
    n = F.length("stop_codon")
    ends = d.where("type = 'PCG' and stop_codon is not null and not coalesce(overlap_stop, false)").select(
        "_row", *keys, "direction", F.when(F.col("direction") == "+", F.col("pos2") - n + 1).otherwise(F.col("pos1")).alias("s"), F.when(F.col("direction") == "+",
            F.col("pos2")).otherwise(F.col("pos1") + n - 1).alias("e")
    )
    codon = ends.withColumn("at", F.explode(F.sequence("s", "e")))
    other = d.select(*keys, "direction", F.when(F.col("direction") == "+", F.col("pos1")).otherwise(F.col("pos2")).alias("at"), F.col("_row").alias("_other"),
        F.col("pos1").alias("o1"), F.col("pos2").alias("o2"))
    hits = codon.join(other, [*keys, "direction", "at"]).where(F.col("_row") != F.col("_other"))
    shared = F.least("e", "o2") - F.greatest("s", "o1") + 1
    single = hits.groupBy("_row").agg(F.count("*").alias("k"), F.max(shared).cast("int").alias("_cut")).where("k = 1").select("_row", "_cut")
    d = d.join(single, "_row", "left")
    short = F.substr("stop_codon", F.lit(1), n - F.col("_cut"))
    ok = F.col("_cut").isNotNull() & (n > F.col("_cut")) & F.coalesce(F.array_contains("stop_codons", short), F.lit(False))
    plus = F.col("direction") == "+"
    return d.withColumn("_ok", ok).withColumns(
        {
            "notes": append_note(F.col("notes"), F.when(F.col("_ok"), F.concat(F.lit("stop codon trimmed by "), F.col("_cut").cast("string"), F.lit(" bp")))),
            "stop_codon": F.when(F.col("_ok"), short).otherwise(F.col("stop_codon")),
            "pos2": F.when(F.col("_ok") & plus, F.col("pos2") - F.col("_cut")).otherwise(F.col("pos2")),
            "pos1": F.when(F.col("_ok") & ~plus, F.col("pos1") + F.col("_cut")).otherwise(F.col("pos1")),
            "length": F.when(F.col("_ok"), F.col("length") - F.col("_cut")).otherwise(F.col("length")),
        }
    ).drop("_row", "_cut", "_ok")


@dataclass(frozen=True)
class Hit:
    acc: str
    similarity: float
    pctid: float
    gap_leading: int
    gap_trailing: int


@dataclass(frozen=True)
class Gene:
    """A protein call in the orientation of its own strand: ``first`` and ``last`` are 1-based on the oriented contig."""

    contig: str
    first: int
    last: int
    stop: str
    notes: tuple[str, ...] = ()

    def protein(self, code: dict[str, str]) -> str:
        s = self.contig[self.first - 1 : self.last - len(self.stop)]
        return "".join(code.get(s[i : i + 3], "X") for i in range(0, len(s) - len(s) % 3, 3))


def rank_hits(protein: str, references: Sequence[tuple[str, str]], most: int) -> list[Hit]:
    """Reference proteins (accession, sequence) by similarity."""
    hits = []
    for (acc, _), (pctid, similarity, lead, tail) in zip(references, compare_many([protein] * len(references), [t for _, t in references]), strict=True):
        if similarity is not None:
            hits.append(Hit(acc, similarity, pctid, lead, tail))
    return sorted(hits, key=lambda h: -h.similarity)[:most]


def _off(hits: list[Hit], gap: Callable[[Hit], int], sign: int) -> bool:
    """Whether the best hit disagrees at an end and most hits do so in the same sense."""
    return bool(hits) and gap(hits[0]) != 0 and sum(gap(h) * sign > 0 for h in hits) > len(hits) / 2


def refine(gene: Gene, score: Callable[[str], list[Hit]], code: dict[str, str], starts: Sequence[str], stops: Sequence[str], threshold: float) -> tuple[Gene, list[Hit]]:
    """Boundaries moved so that most reference proteins no longer show a gap at that end.

    A truncated end is extended to the farthest valid codon within the greatest gap; an over-extended end
    is cut back to the first valid codon at which the overhang is gone. Without a hit of the threshold's
    similarity nothing moves.
    """
    lead, tail = (lambda h: h.gap_leading), (lambda h: h.gap_trailing)
    stops = sorted(stops, key=len, reverse=True)
    hits = score(gene.protein(code))
    if not any(h.similarity >= threshold for h in hits):
        return gene, hits
    if _off(hits, lead, 1):
        for g in range(max(map(lead, hits)), 0, -1):
            at = gene.first - 3 * g
            if at >= 1 and gene.contig[at - 1 : at + 2] in starts:
                gene = replace(gene, first=at, notes=(*gene.notes, f"extending start {3 * g} bp"))
                hits = score(gene.protein(code))
                break
    if _off(hits, tail, 1):
        for g in range(max(map(tail, hits)), 0, -1):
            codon_at = gene.last - len(gene.stop) + 3 * g
            stop = next((s for s in stops if len(s) <= 3 and gene.contig[codon_at : codon_at + len(s)] == s), None)
            if stop is not None and codon_at + len(stop) <= len(gene.contig):
                last = codon_at + len(stop)
                gene = replace(gene, last=last, stop=stop, notes=(*gene.notes, f"extending end {abs(last - gene.last)} bp"))
                hits = score(gene.protein(code))
                break
    if _off(hits, lead, -1):
        for k in range(1, max(-lead(h) for h in hits) + 1):
            at = gene.first + 3 * k
            if at + 2 < gene.last and gene.contig[at - 1 : at + 2] in starts:
                moved = replace(gene, first=at, notes=(*gene.notes, f"trimming start {3 * k} bp"))
                found = score(moved.protein(code))
                if not _off(found, lead, -1):
                    gene, hits = moved, found
                    break
    if _off(hits, tail, -1):
        for k in range(1, max(-tail(h) for h in hits) + 1):
            codon_at = gene.last - len(gene.stop) - 3 * k
            stop = next((s for s in stops if codon_at > gene.first and gene.contig[codon_at : codon_at + len(s)] == s), None)
            if stop is not None:
                last = codon_at + len(stop)
                moved = replace(gene, last=last, stop=stop, notes=(*gene.notes, f"trimming end {abs(last - gene.last)} bp"))
                found = score(moved.protein(code))
                if not _off(found, tail, -1):
                    gene, hits = moved, found
                    break
    return gene, hits


REFINED = "row_id string, pos1 long, pos2 long, length long, start_codon string, stop_codon string, translation string, notes string, hits array<struct<acc: string, similarity: double, pctid: double, gap_leading: int, gap_trailing: int>>"


def packed_references(references: Column) -> Column:
    """An array of (acc, target) as one text: a line a reference. Neither holds a tab or a line break."""
    return F.array_join(F.transform(references, lambda x: F.concat(x["acc"], F.lit("\t"), x["target"])), "\n")


@lru_cache(maxsize=256)
def _unpacked(text: str) -> tuple[tuple[str, str], ...]:
    return tuple(tuple(line.split("\t")) for line in text.split("\n"))


def refined_calls(calls: DataFrame, table: int, threshold: float, most: int = 100, every_hit: bool = True) -> DataFrame:
    """Refined protein calls (``REFINED``).

    Input rows carry all they need: row_id, pos1, pos2, direction, stop_codon, notes, sequence (the contig),
    references (array of (acc, target), or ``packed_references``), start_codons, stop_codons. A row is
    refined by itself, in Arrow batches. Where there is a column topology, a call over the origin of a
    circular contig is refined on the contig turned to its opposite side, and its positions are turned
    back. Other calls with pos1 > pos2, and rows with a NULL among these or without references, are left out. Without ``every_hit``, a call that an upper bound of its scores shows to be
    below the threshold, and so not to move, comes without hits.
    """
    code = genetic_code(table)
    # Where the contig of a call over the origin is cut instead: halfway between its end and its start.
    opposite = lambda r: (r.pos1 + r.pos2) // 2 if r.pos1 > r.pos2 else 0
    turned = lambda p, by, size: (p - 1 + by) % size + 1 if by else p

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            genes: list[Gene] = []
            for r in f.itertuples(index=False):
                contig = r.sequence.upper()
                size, back, cut = len(contig), r.direction == "-", opposite(r)
                contig = contig[cut:] + contig[:cut]
                if back:
                    contig = contig.translate(_COMPLEMENT)[::-1]
                p1, p2 = turned(r.pos1, -cut, size), turned(r.pos2, -cut, size)
                first, last = (size - p2 + 1, size - p1 + 1) if back else (p1, p2)
                genes.append(Gene(contig, first, last, r.stop_codon))
            proteins = [g.protein(code) for g in genes]
            moving = [True] * len(genes)
            if not every_hit:
                of: dict[str, list[int]] = {}
                for k, text in enumerate(f["references"]):
                    of.setdefault(text, []).append(k)
                for text, ks in of.items():
                    for k, may in zip(ks, may_reach([proteins[k] for k in ks], [t for _, t in _unpacked(text)], threshold), strict=True):
                        moving[k] = may
            for r, gene, protein, may in zip(f.itertuples(index=False), genes, proteins, moving, strict=True):
                size, back = len(gene.contig), r.direction == "-"
                hits: list[Hit] = []
                if may:
                    kept: dict[str, list[Hit]] = {}

                    def score(protein: str, refs=_unpacked(r.references), kept=kept) -> list[Hit]:
                        if protein not in kept:
                            kept[protein] = rank_hits(protein, refs, most)
                        return kept[protein]

                    gene, hits = refine(gene, score, code, list(r.start_codons), list(r.stop_codons), threshold)
                    protein = gene.protein(code)
                p1, p2 = (size - gene.last + 1, size - gene.first + 1) if back else (gene.first, gene.last)
                cut = opposite(r)
                notes = "; ".join([*([r.notes] if r.notes else []), *gene.notes]) or None
                out.append((r.row_id, turned(p1, cut, size), turned(p2, cut, size), p2 - p1 + 1, gene.contig[gene.first - 1 : gene.first + 2], gene.stop, protein, notes,
                    [vars(h) for h in hits]))
            if out:
                yield pd.DataFrame(out, columns=["row_id", "pos1", "pos2", "length", "start_codon", "stop_codon", "translation", "notes", "hits"])

    ship(calls.sparkSession)
    if dict(calls.dtypes)["references"] != "string":
        calls = calls.where("size(references) > 0").withColumn("references", packed_references(F.col("references")))
    over = " or topology = 'circular' and pos1 > pos2 and pos2 >= 1 and pos1 <= length(sequence)" if "topology" in calls.columns else ""
    ready = calls.where(f"(pos1 <= pos2{over}) and pos1 >= 1 and stop_codon is not null and sequence is not null and direction is not null and references <> '' and start_codons is not null and stop_codons is not null")
    return ready.select("row_id", "pos1", "pos2", "direction", "stop_codon", "notes", "sequence", "references", "start_codons", "stop_codons").mapInPandas(run, REFINED)


def next_start(sequence_name: str, starts: Sequence[str], reach: int):
    """Columns (upstream, downstream): codons to the nearest valid start codon before and after a call's start, up to ``reach`` codons; NULL if there is none."""
    from organelia.functions.seq import codons, reverse_complement

    seq, size = F.col(sequence_name), F.length(sequence_name)
    back = F.col("direction") == "-"
    own = F.when(back, reverse_complement(seq)).otherwise(seq)
    first = F.when(back, size - F.col("pos2") + 1).otherwise(F.col("pos1")).cast("int")
    up = F.least(F.lit(reach), F.floor((first - 1) / 3)).cast("int")
    before = F.reverse(codons(F.substr(own, first - 3 * up, 3 * up)))
    after = codons(F.substr(own, first + 3, F.lit(3 * reach)))
    at = lambda a: F.nullif(F.array_position(F.transform(a, lambda c: c.isin(list(starts))), F.lit(True)).cast("int"), F.lit(0))
    return F.when(up > 0, at(before)), at(after)
