"""Tables that the SQL of the queries states for itself, so that a wrong value in the engine's own tables shows as a difference."""

from __future__ import annotations

# The published amino acids of genetic code 2, codons in the order T, C, A, G of each base.
AMINO_2 = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"


def amino_sql(codon: str) -> str:
    """The amino acid of a codon; X for one with another letter or of another length."""
    at = " + ".join(f"{n} * (strpos('TCAG', substr({codon}, {i}, 1)) - 1)" for i, n in ((1, 16), (2, 4), (3, 1)))
    return f"CASE WHEN regexp_full_match({codon}, '[TCAG][TCAG][TCAG]') THEN substr('{AMINO_2}', ({at} + 1)::INT, 1) ELSE 'X' END"


# Gene, type, calls, greatest and least length, overlap allowed at the start and at the stop, start codons, stop codons.
_STARTS, _STOPS = "['ATG', 'GTG', 'ATA', 'ATT', 'TTA', 'ATC']", "['TAA', 'TAG', 'AGA', 'AGG', 'AG', 'TA', 'T']"
_STARTS_TTG, _STARTS_CTG = _STARTS[:-1] + ", 'TTG']", _STARTS[:-1] + ", 'CTG']"
RULES = f"""rules(rgene, rtype, allowed, max_len, min_len, overlap_start, overlap_stop, starts, stops, rank) AS (VALUES
('ctrl', 'ctrl', 1, NULL, 350, NULL, NULL, NULL, NULL, 1),
('rrnL', 'rRNA', 1, 1850, NULL, 0, false, NULL, NULL, 2),
('rrnS', 'rRNA', 1, 1000, NULL, 0, false, NULL, NULL, 3),
('nad1', 'PCG', 1, NULL, NULL, 2, false, {_STARTS_TTG}, {_STOPS}, 4),
('nad2', 'PCG', 1, NULL, NULL, 2, false, {_STARTS}, {_STOPS}, 5),
('cox1', 'PCG', 1, NULL, NULL, 2, true, {_STARTS}, {_STOPS}, 6),
('cox2', 'PCG', 1, NULL, NULL, 2, false, {_STARTS_TTG}, {_STOPS}, 7),
('atp8', 'PCG', 1, NULL, NULL, 2, true, {_STARTS}, {_STOPS}, 8),
('atp6', 'PCG', 1, NULL, NULL, 20, false, {_STARTS_CTG}, {_STOPS}, 9),
('cox3', 'PCG', 1, NULL, NULL, 2, false, {_STARTS}, {_STOPS}, 10),
('nad3', 'PCG', 1, NULL, NULL, 2, false, {_STARTS}, {_STOPS}, 11),
('nad4l', 'PCG', 1, NULL, NULL, 2, true, {_STARTS}, {_STOPS}, 12),
('nad4', 'PCG', 1, NULL, NULL, 20, false, {_STARTS}, {_STOPS}, 13),
('nad5', 'PCG', 1, NULL, NULL, 2, true, {_STARTS}, {_STOPS}, 14),
('nad6', 'PCG', 1, NULL, NULL, 2, true, {_STARTS}, {_STOPS}, 15),
('cob', 'PCG', 1, NULL, NULL, 2, false, {_STARTS}, {_STOPS}, 16),
('trnA', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 17),
('trnC', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 18),
('trnD', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 19),
('trnE', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 20),
('trnF', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 21),
('trnG', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 22),
('trnH', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 23),
('trnI', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 24),
('trnK', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 25),
('trnL', 'tRNA', 2, NULL, NULL, NULL, NULL, NULL, NULL, 26),
('trnM', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 27),
('trnN', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 28),
('trnP', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 29),
('trnQ', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 30),
('trnR', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 31),
('trnS', 'tRNA', 2, NULL, NULL, NULL, NULL, NULL, NULL, 32),
('trnT', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 33),
('trnV', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 34),
('trnW', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 35),
('trnY', 'tRNA', 1, NULL, NULL, NULL, NULL, NULL, NULL, 36))"""

# Products of the protein genes of the test data.
PRODUCTS = {
    "atp6": "ATP synthase F0 subunit 6",
    "atp8": "ATP synthase F0 subunit 8",
    "cob": "cytochrome b",
    "cox1": "cytochrome c oxidase subunit 1",
    "cox2": "cytochrome c oxidase subunit 2",
    "cox3": "cytochrome c oxidase subunit 3",
    "nad1": "NADH dehydrogenase subunit 1",
    "nad2": "NADH dehydrogenase subunit 2",
    "nad3": "NADH dehydrogenase subunit 3",
    "nad4": "NADH dehydrogenase subunit 4",
    "nad4l": "NADH dehydrogenase subunit 4L",
    "nad5": "NADH dehydrogenase subunit 5",
    "nad6": "NADH dehydrogenase subunit 6",
}
PRODUCT_SQL = "CASE gene " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRODUCTS.items()) + " END"
