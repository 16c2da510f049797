"""Sequence functions as column expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide codes and their complements, ambiguity codes included.
BASES = "ACGTURYKMSWBDHVNacgturykmswbdhvn"
COMPLEMENTS = "TGCAAYRMKSWVHDBNtgcaayrmkswvhdbn"

# The standard genetic code over the codons in T, C, A, G order, and what other tables change.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHANGES = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
}


def genetic_code(table: int) -> dict[str, str]:
    """Codon to amino acid of a numbered table."""
    if table not in CHANGES:
        raise ValueError(f"unknown genetic code {table}")
    order = "TCAG"
    code = {a + b + c: STANDARD[16 * i + 4 * j + k] for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)}
    return code | CHANGES[table]


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; letters that are no nucleotide code stay, in reverse order. NULL gives NULL."""
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def subseq(seq: Column, first: Column, last: Column) -> Column:
    """Bases ``first`` to ``last``, 1-based and closed; ``last`` -1 means the end."""
    end = F.when(last == -1, F.length(seq)).otherwise(last)
    return F.substr(seq, first.cast("int"), (end - first + 1).cast("int"))


def circular_subseq(seq: Column, first: Column, last: Column) -> Column:
    """As ``subseq``, but ``first > last`` runs over the origin."""
    over = F.concat(F.substr(seq, first.cast("int")), F.substr(seq, F.lit(1), last.cast("int")))
    return F.when(first <= last, subseq(seq, first, last)).otherwise(over)


def stranded(seq: Column, direction: Column) -> Column:
    return F.when(direction == "-", reverse_complement(seq)).otherwise(seq)


def codons(seq: Column) -> Column:
    """Pieces of three bases; the last may be shorter."""
    return F.regexp_extract_all(seq, F.lit("(.{1,3})"), 1)


def translate_codons(seq: Column, table: int, initiators: Sequence[str] = ()) -> Column:
    """Amino acids of the whole codons; X for one that is ambiguous. A first codon in ``initiators`` is M."""
    code = F.create_map(*[F.lit(x) for kv in genetic_code(table).items() for x in kv])
    whole = F.filter(codons(F.translate(F.upper(seq), "U", "T")), lambda c: F.length(c) == 3)

    def letter(c: Column, i: Column) -> Column:
        plain = F.coalesce(F.try_element_at(code, c), F.lit("X"))
        return F.when((i == 0) & c.isin(list(initiators)), "M").otherwise(plain) if initiators else plain

    return F.array_join(F.transform(whole, letter), "")


def count_bases(seq: Column, letters: str) -> Column:
    """Occurrences of any of the letters, in either case."""
    both = letters.upper() + letters.lower()
    return F.length(seq) - F.length(F.translate(seq, both, ""))


def gc_fraction(seq: Column) -> Column:
    """G and C among all bases; NULL for an empty sequence."""
    return F.try_divide(count_bases(seq, "GC"), F.length(seq))


def bases(seq: Column) -> Column:
    """Array of single bases."""
    return F.filter(F.split(seq, ""), lambda b: b != "")


def partial_stop_length(length: Column) -> Column:
    """Bases of the stop codon of a call of that length: 1 or 2 where it is completed later, else 3."""
    return F.when(length % 3 == 0, 3).otherwise(length % 3).cast("int")


def start_codon(seq: Column, pos1: Column, pos2: Column, direction: Column) -> Column:
    return F.when(direction == "+", subseq(seq, pos1, pos1 + 2)).when(direction == "-", reverse_complement(subseq(seq, pos2 - 2, pos2)))


def stop_codon(seq: Column, pos1: Column, pos2: Column, direction: Column, length: Column) -> Column:
    n = partial_stop_length(length)
    return F.when(direction == "+", subseq(seq, pos2 - n + 1, pos2)).when(direction == "-", reverse_complement(subseq(seq, pos1, pos1 + n - 1)))


def coding_sequence(seq: Column, pos1: Column, pos2: Column, direction: Column, stop_length: Column) -> Column:
    """The coding bases of a call on its own strand, without the stop codon; runs over the origin where pos1 > pos2."""
    whole = stranded(circular_subseq(seq, pos1, pos2), direction)
    return F.substr(whole, F.lit(1), F.greatest(F.length(whole) - stop_length, F.lit(0)).cast("int"))


def first_codon_in(seq: Column, options: Sequence[str]) -> Column:
    """1-based index of the first codon of ``seq`` that is among the options; 0 if none is."""
    hits = F.transform(codons(seq), lambda c: c.isin(list(options)))
    return F.array_position(hits, F.lit(True)).cast("int")
