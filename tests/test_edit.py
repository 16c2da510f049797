from pyspark.sql import functions as F

from organelia.plans import edit


def test_common_region(spark):
    d = spark.createDataFrame([("a", "ACGTACGTAA"), ("a", "ACCTACG-AA"), ("b", "AAAA"), ("b", "CCCC")], "k string, s string")
    assert [tuple(r) for r in edit.common_region(d, ["k"], "s").collect()] == [("a", 4, 7, 4)]
    assert [tuple(r) for r in edit.common_region(d, ["k"], "s", F.lit(True)).collect()] in ([("a", 4, 7, 4)], [("a", 9, 12, 4)])
    assert [tuple(r) for r in edit.common_region(d, ["k"], "s", first=True).collect()] == [("a", 1, 2, 2)]


def test_linearize_move_and_delete(spark):
    calls = spark.createDataFrame([("c", "x", 10, 20, "+", 11, 100), ("c", "y", 30, 40, "-", 11, 100), ("d", "x", 5, 9, "+", 5, 50)], "k string, gene string, pos1 long, pos2 long, direction string, length long, n long")
    cuts = spark.createDataFrame([("c", 30), ("d", 7)], "k string, cut long")
    moved, refused = edit.linearized(calls, cuts, ["k"], "n")
    assert sorted((r["k"], r["gene"], r["pos1"], r["pos2"]) for r in moved.collect()) == [("c", "x", 81, 91), ("c", "y", 1, 11), ("d", "x", 5, 9)]
    assert [tuple(r) for r in refused.collect()] == [("d", 7, 1)]
    gone = edit.deleted_calls(calls, calls.where("gene = 'y'"), ["k", "gene", "pos1"])
    assert sorted((r["gene"], r["pos1"], r["length"]) for r in gone.where("k = 'c'").collect()) == [("x", 10, 11), ("y", 0, 0)]
    steps = F.when(F.col("gene") == "y", -1).when(F.col("k") == "c", 2)
    assert sorted((r["k"], r["gene"], r["pos1"], r["pos2"], r["length"]) for r in edit.with_start(calls, steps).collect()) == [("c", "x", 16, 20, 5), ("c", "y", 30, 43, 14), ("d", "x", 5, 9, 5)]


def test_move_stop(spark):
    contig = "CCATGAAATAGCCCTTGGGTAACC"  # ATG AAA TAG CCC TTG GGT AA
    comp = str.maketrans("ACGT", "TGCA")
    n = len(contig)
    rows = [("p", 3, 17, "+", "TTG", contig), ("m", n - 17 + 1, n - 2, "-", "TTG", contig.translate(comp)[::-1])]
    d = spark.createDataFrame(rows, "k string, pos1 long, pos2 long, direction string, stop_codon string, s string")
    inward, s1, outward, s2 = edit.next_stop("s", ["TAA", "TAG", "GG"], 4)
    got = {r["k"]: tuple(r)[1:] for r in d.select("k", inward.alias("a"), s1.alias("b"), outward.alias("c"), s2.alias("d")).collect()}
    assert got == {"p": (2, "TAG", 1, "GG"), "m": (2, "TAG", 1, "GG")}
    e = d.withColumn("a", inward).withColumn("b", s1)
    moved = {r["k"]: (r["pos1"], r["pos2"], r["stop_codon"], r["length"]) for r in edit.with_stop(e, -F.col("a"), F.col("b")).collect()}
    assert moved == {"p": (3, 11, "TAG", 9), "m": (n - 11 + 1, n - 2, "TAG", 9)}


def test_cut_to(spark):
    contigs = spark.createDataFrame([("a", "ACGTACGTAA", "1 2 3 4 5 6 7 8 9 10"), ("b", "ACGT", None), ("c", "ACGT", "1 2 3 4"), ("d", "AC", "1 2")], "k string, sequence string, depth string")
    regions = spark.createDataFrame([("a", 9, 12), ("b", 2, 3), ("d", 2, 1)], "k string, f long, l long")
    got = {r["k"]: (r["sequence"], r["depth"]) for r in edit.cut_to(contigs, regions, ["k"], "f", "l", ["depth"]).collect()}
    assert got == {"a": ("AAAC", "9 10 1 2"), "b": ("CG", None), "c": ("ACGT", "1 2 3 4"), "d": ("", "")}
    kept = {r["k"]: r["sequence"] for r in edit.cut_to(contigs, regions, ["k"], "f", "l", only=F.col("k") != "a").collect()}
    assert kept["a"] == "ACGTACGTAA" and kept["b"] == "CG"


def test_rescored(spark):
    calls = spark.createDataFrame([("x", "cob", "MKLVWAAGH"), ("y", "cob", "MKLVWAAGH"), ("z", "nad1", "MK"), ("n", "cob", None)], "id string, gene string, translation string")
    refs = spark.createDataFrame([("cob", "r1", "MKLVWAAGH"), ("cob", "r2", "KLVWAAGH"), ("cob", "r3", "MKLVWYYYYYY")], "gene string, acc string, target string")
    got = {r["id"]: r["hits"] for r in edit.rescored(calls, refs, 2).collect()}
    assert got["x"] == got["y"] and got["x"].startswith('{"acc":["r1","r2"]') and '"gap_leading":[0,' in got["x"] and got["z"] is None and got["n"] is None
