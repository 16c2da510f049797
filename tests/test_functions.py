import json
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from organelia.functions import align as A
from organelia.functions import seq as S
from organelia.functions import text as X


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_sequences(spark):
    s = F.lit("ACGTRYKMN")
    assert one(spark, S.reverse_complement(s), S.reverse_complement(S.reverse_complement(s))) == ("NKMRYACGT", "ACGTRYKMN")
    assert one(spark, S.subseq(s, F.lit(2), F.lit(4)), S.subseq(s, F.lit(8), F.lit(-1)), S.circular_subseq(s, F.lit(8), F.lit(2))) == ("CGT", "MN", "MNAC")
    assert one(spark, S.codons(F.lit("ATGCC")), S.bases(F.lit("AC"))) == (["ATG", "CC"], ["A", "C"])
    assert one(spark, S.translate_codons(F.lit("ATAtgaAGANNNTT"), 2), S.translate_codons(F.lit("TTGATA"), 5, ["TTG"]), S.translate_codons(F.lit("AAAUGA"), 9)) == ("MW*X", "MM", "NW")
    assert one(spark, S.gc_fraction(F.lit("GCat")), S.gc_fraction(F.lit("")), S.gc_fraction(F.lit(None).cast("string"))) == (0.5, None, None)
    assert one(spark, S.first_codon_in(F.lit("AAAATGTTT"), ["ATG"]), S.first_codon_in(F.lit("AAA"), ["ATG"])) == (2, 0)
    plus = one(spark, S.start_codon(F.lit("CCATGAAATAACC"), F.lit(3), F.lit(11), F.lit("+")), S.stop_codon(F.lit("CCATGAAATAACC"), F.lit(3), F.lit(11), F.lit("+"), F.lit(9)), S.coding_sequence(F.lit("CCATGAAATAACC"), F.lit(3), F.lit(11), F.lit("+"), F.lit(3)))
    assert plus == ("ATG", "TAA", "ATGAAA")
    with pytest.raises(ValueError):
        S.genetic_code(99)


def test_text(spark):
    note = lambda a, b: X.append_note(F.lit(a).cast("string"), F.lit(b).cast("string"))
    assert one(spark, note(None, "b"), note("", "b"), note("a", "b"), note("a", None)) == ("b", "b", "a; b", "a")
    assert one(spark, X.glue(">{a} [x={b}]", {"a": F.lit("s"), "b": F.lit(None).cast("string")}), X.squish(F.lit("  a  b "))) == (">s [x=NA]", "a b")
    assert one(spark, X.wrap_lines(F.lit("abcdef"), 3), X.wrap_lines(F.lit("abcd"), 3)) == ("abc\ndef", "abc\nd")
    assert one(spark, *X.unmasked(X.masked(F.lit(3.5), F.lit(True))), *X.unmasked(X.masked(F.lit(2.0), F.lit(None).cast("boolean")))) == (3.5, True, 2.0, False)


def test_hits_as_json(spark):
    fields = ["acc", "similarity", "gap_leading", "pctid"]
    hits = F.from_json(F.lit(json.dumps([{"acc": "a", "similarity": 90.5, "gap_leading": 0}, {"acc": "b", "similarity": 80.0, "gap_leading": 0}])), "array<struct<acc:string,similarity:double,gap_leading:int,pctid:double>>")
    text = one(spark, X.hit_json(hits, fields))[0]
    assert json.loads(text) == {"acc": ["a", "b"], "similarity": [90.5, 80.0], "gap_leading": 0}
    back = one(spark, X.hit_rows(F.lit(text)))[0]
    assert [(h["acc"], h["similarity"], h["gap_leading"], h["pctid"]) for h in back] == [("a", 90.5, 0, None), ("b", 80.0, 0, None)]
    assert one(spark, X.hit_rows(F.lit("{}")), X.hit_rows(F.lit('{"acc":"x","similarity":1}')))[0] == []


def best_score(a, b):
    table = A.scores()

    @cache
    def f(i, j, s):
        if i == 0 and j == 0:
            return 0 if s == 0 else -(10**9)
        if s == 0:
            return max(f(i - 1, j - 1, t) for t in range(3)) + int(table[ord(a[i - 1]), ord(b[j - 1])]) if i and j else -(10**9)
        if s == 1:
            return max(f(i - 1, j, t) - (4 if t == 1 else 14) for t in range(3)) if i else -(10**9)
        return max(f(i, j - 1, t) - (4 if t == 2 else 14) for t in range(3)) if j else -(10**9)

    return max(f(len(a), len(b), s) for s in range(3))


def test_alignment_is_optimal():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("ARNDM") for _ in range(rng.randint(0, 8))) for _ in range(2))
        r = A.align(a, b)
        assert r.a.replace("-", "") == a and r.b.replace("-", "") == b and r.score == best_score(a, b)
    assert (A.scores() == A.scores().T).all()


def test_compare_and_group():
    q = "MKLVWWAARNDCQ"
    assert A.compare(q, q) == (100.0, 100.0, 0, 0)
    assert A.compare(q[3:], q)[2:] == (3, 0) and A.compare(q, q[:-2])[2:] == (0, -2)
    assert A.compare(None, q) == (None,) * 4 and A.compare("", q) == (None,) * 4
    aligned = A.multiple_alignment(["MKLVWW", "MKVWW", "KLVWWA", "MKLVWW"])
    assert len({len(s) for s in aligned}) == 1 and [s.replace("-", "") for s in aligned] == ["MKLVWW", "MKVWW", "KLVWWA", "MKLVWW"]
    d = A.distances(aligned)
    assert d[0, 3] == 0 and (d == d.T).all() and sorted(A.cluster_order(d)) == [0, 1, 2, 3]
    assert A.multiple_alignment([]) == [] and A.cluster_order(A.distances([])) == []


def test_alignment_in_spark(spark):
    df = spark.createDataFrame([("MKLV", "MKLV"), ("MKLV", "MKLV"), ("MK", None)], "query string, target string")
    got = sorted(tuple(r) for r in A.score_pairs(df.where("target is not null")).collect())
    assert got == [("MKLV", "MKLV", 100.0, 100.0, 0, 0)] * 2
    genes = spark.createDataFrame([("g", "a", "MKLVW"), ("g", "b", "MKLW"), ("h", "a", "MMM"), ("h", "b", None)], "gene string, id string, protein string")
    report = A.alignment_report(genes, "gene", "id", "protein").collect()
    assert {(r["group"], r["name"]) for r in report} == {("g", "a"), ("g", "b"), ("h", "a")}
    # Copies share a row and a place and weigh in the distances.
    more = spark.createDataFrame([("g", f"a{i}", "MKLVW") for i in range(600)] + [("g", "b", "MKLW"), (None, "c", "MK")], "gene string, id string, protein string")
    rows = A.alignment_report(more, "gene", "id", "protein").collect()
    assert len(rows) == 602 and {(r["ord"], r["aligned"], round(r["mean_distance"], 6)) for r in rows if r["name"].startswith("a")} == {(2, "MKLVW", round(0.2 / 600, 6))} or {r["ord"] for r in rows if r["name"].startswith("a")} == {1}
    assert [(r["aligned"], round(r["mean_distance"], 6)) for r in rows if r["name"] == "b"] == [("MKL-W", 0.2)]
