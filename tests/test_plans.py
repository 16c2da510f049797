import random

from pyspark.sql import functions as F

from organelia.functions.seq import genetic_code
from organelia.operators import windows as W
from organelia.operators.nested import rule_values
from organelia.plans import annotate as An
from organelia.plans import coverage as C
from organelia.plans import curate, params
from organelia.plans import validate as V
from organelia.plans.curate import Gene, Hit, rank_hits, refine

CALL = "contig string, type string, gene string, pos1 long, pos2 long, direction string"


def test_rolling_windows(spark):
    d = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate([1, 3, 5, 7, 9], 1)], "k string, position long, v double")
    got = d.select("position", W.rolling_mean(F.col("v"), ["k"], "position").alias("m")).orderBy("position").collect()
    assert [r["m"] for r in got] == [3, 4, 5, 6, 7]
    bases = spark.createDataFrame([("c", i, "G") for i in range(1, 201)], "k string, position long, v string")
    full = bases.select("position", W.full_window_fraction(F.col("v") == "G", ["k"], "position", 200).alias("f")).where("f is not null").collect()
    assert [tuple(r) for r in full] == [(100, 1.0)]
    assert bases.where("position < 200").select(W.full_window_fraction(F.col("v") == "G", ["k"], "position", 200).alias("f")).where("f is not null").count() == 0


def test_islands(spark):
    d = spark.createDataFrame([("c", i, v) for i, v in enumerate([1, 1, 0, 1, 1, 1, 0], 1)], "k string, position long, v int")
    runs = W.islands(d, ["k"], "position", F.col("v") == 1)
    assert [tuple(r) for r in W.longest_run(runs, ["k"]).collect()] == [("c", 4, 6, 3)]
    assert [tuple(r) for r in W.longest_run(runs, ["k"], first=True).collect()] == [("c", 1, 2, 2)]


def loop_trim(depth, mask):
    """The trim points by stepping inward one position at a time."""
    n, mask = len(depth), list(mask)
    first = lambda d, at: next((i for i, x in enumerate(d, 1) if x > at), 1 << 60)
    ends = []
    for d in (depth, depth[::-1]):
        ends.append(0 if first(d, 10) <= 100 else first(d, 15))
    mask = [m or i <= ends[0] or n - i + 1 <= ends[1] for i, m in enumerate(mask, 1)]
    lo, hi = 1, n
    if sum(mask[:100]) > 10:
        lo = 1
        while any(mask[lo : lo + 51]):
            lo += 1
        lo += 1
    if sum(mask[-100:]) > 10:
        hi = n
        while any(mask[max(0, hi - 52) : hi - 1]):
            hi -= 1
        hi -= 1
    return lo, hi


def test_trim_points(spark):
    rng = random.Random(8)
    data, expected = [], {}
    for k in range(6):
        n = rng.randint(400, 600)
        bad = [rng.random() < 0.4 and (i < 80 or i > n - 70) for i in range(n)]
        depth = [5.0 if k % 2 and i < 130 else 30.0 for i in range(n)]
        data += [(str(k), i, depth[i - 1], bad[i - 1]) for i in range(1, n + 1)]
        expected[str(k)] = loop_trim(depth, bad)
    d = spark.createDataFrame(data, "k string, position long, depth_mean double, mask boolean")
    assert {r["k"]: (r["keep_from"], r["keep_to"]) for r in W.trim_points(d, ["k"]).collect()} == expected


def test_coverage_steps(spark):
    counts = spark.createDataFrame([("c", 2, "A", 10.0, 9.0), ("c", 3, "C", 0.0, 0.0), ("c", 6, "T", 4.0, 4.0)], "seq_id string, position long, call string, depth double, correct double")
    contigs = spark.createDataFrame([("c", "circular", 5, "GACGT")], "seq_id string, topology string, length long, sequence string")
    folded = C.fold_circular(counts, contigs)
    assert sorted((r["position"], r["depth"]) for r in folded.collect()) == [(1, 4.0), (2, 10.0), (3, 0.0)]
    full = C.fill_gaps(folded, contigs).orderBy("position").collect()
    assert [(r["position"], r["call"], r["depth"], r["error_rate"]) for r in full] == [(1, "T", 4.0, 0.0), (2, "A", 10.0, 0.1), (3, "C", 0.0, None), (4, "G", 0.0, None), (5, "T", 0.0, None)]
    stats = C.statistics(C.fill_gaps(folded, contigs))
    assert stats.count() == 5 and C.encoded(stats).count() == 5
    packed = C.pack_track(stats, ["seq_id"], "depth", "track")
    assert sorted(r["d"] for r in C.unpack_track(packed, ["seq_id"], "track", "d").collect()) == [0.0, 0.0, 0.0, 4.0, 10.0]


def test_control_region_and_rotation(spark):
    d = spark.createDataFrame([("c", "tRNA", "trnF", 41, 50, "-", 100, 10), ("c", "ctrl", "OH", 60, 70, "+", 100, 11), ("c", "PCG", "cob", 90, 95, "+", 100, 6)], CALL + ", n long, length long")
    wide = {r["gene"]: (r["pos1"], r["pos2"], r["length"]) for r in An.control_regions(d, ["contig"], "n").collect()}
    assert wide["ctrl"] == (51, 89, 39)
    turned = An.rotated_calls(d, An.start_points(d, ["contig"], "trnF"), ["contig"], "n")
    assert {r["gene"]: (r["pos1"], r["pos2"], r["direction"]) for r in turned.collect()}["trnF"] == (1, 10, "+")
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(100))
    moved = spark.range(1).select(An.rotated_sequence(F.lit(seq), F.lit(41), F.lit(50), F.lit("-"))).first()[0]
    comp = str.maketrans("ACGT", "TGCA")
    assert moved == (seq[50:] + seq[:50]).translate(comp)[::-1]


def test_punctuation_and_stop_trimming(spark):
    d = spark.createDataFrame([("c", "tRNA", "trnF", 1, 69, "+"), ("c", "rRNA", "rrnS", 72, 1020, "+"), ("c", "tRNA", "trnV", 1025, 1090, "+")], CALL).withColumns({"length": F.lit(0).cast("long"), "notes": F.lit(None).cast("string"), "max_len": F.lit(1000).cast("long")})
    r = curate.punctuated(d, ["contig"]).where("type = 'rRNA'").first()
    assert (r["pos1"], r["pos2"], r["length"]) == (70, 1024, 955) and r["notes"].count("moved") == 2 and "-2 bp" in r["notes"] and "4 bp" in r["notes"]
    calls = [("c", "PCG", "nad1", 1, 102, "+", "TAA"), ("c", "PCG", "nad2", 101, 200, "+", "TAA"), ("d", "PCG", "nad1", 50, 102, "-", "TAA"), ("d", "PCG", "nad2", 1, 50, "-", "TAG")]
    p = spark.createDataFrame(calls, CALL + ", stop_codon string").withColumns({"stop_codons": F.array(F.lit("TAA"), F.lit("TA"), F.lit("T")), "overlap_stop": F.lit(False), "length": (F.col("pos2") - F.col("pos1") + 1), "notes": F.lit(None).cast("string")})
    got = {(r["contig"], r["gene"]): (r["pos1"], r["pos2"], r["stop_codon"], r["length"]) for r in curate.trimmed_stops(p, ["contig"]).collect()}
    assert got["c", "nad1"] == (1, 100, "T", 100) and got["d", "nad1"] == (51, 102, "TA", 52) and got["c", "nad2"] == (101, 200, "TAA", 100)


CODE = genetic_code(2)


def contig_with(protein_codons, before="CCC", after="GGG"):
    return before + "".join(protein_codons) + after


def test_refine_extends_and_trims():
    rng = random.Random(11)
    plain = [c for c, a in CODE.items() if a not in "*MIV"]
    body = [rng.choice(plain) for _ in range(40)]
    starts, stops = ["ATG"], ["TAA", "TA", "T"]
    protein = "M" + "".join(CODE[c] for c in body)
    score = lambda p: rank_hits(p, [("ref", protein), ("ref2", protein)], 10)
    contig = contig_with(["ATG", *body, "TAA"])
    whole = Gene(contig, 4, 3 + 3 * 42, "TAA")
    assert whole.protein(CODE) == protein
    same, hits = refine(whole, score, CODE, starts, stops, 80)
    assert same == whole and hits[0].similarity == 100
    late = Gene(contig, 4 + 15, whole.last, "TAA")
    assert refine(late, score, CODE, starts, stops, 50)[0].first == 4
    early_end = Gene(contig, 4, whole.last - 12, contig[whole.last - 15 : whole.last - 12])
    fixed = refine(early_end, score, CODE, starts, stops, 50)[0]
    assert fixed.last == whole.last and fixed.stop == "TAA"
    long = contig_with([*["CCA"] * 3, "ATG", *body, "TAA"])
    over = refine(Gene(long, 4, 3 + 3 * 45, "TAA"), score, CODE, starts, stops, 50)[0]
    assert over.first == 4 + 9 and "trimming start 9 bp" in over.notes
    assert refine(late, lambda p: [Hit("x", 10.0, 10.0, 5, 0)], CODE, starts, stops, 80)[0] == late


def test_refine_in_spark_on_both_strands(spark):
    rng = random.Random(11)
    body = [rng.choice([c for c, a in CODE.items() if a not in "*MIV"]) for _ in range(30)]
    protein = "M" + "".join(CODE[c] for c in body)
    contig = contig_with(["ATG", *body, "TAA"])
    comp = str.maketrans("ACGT", "TGCA")
    n, last = len(contig), 3 + 3 * 32
    rows = [("p", 4 + 9, last, "+", "TAA", None, contig), ("m", n - last + 1, n - 3 - 9, "-", "TAA", "old", contig.translate(comp)[::-1]), ("w", 50, 4, "+", "TAA", None, contig)]
    d = spark.createDataFrame(rows, "row_id string, pos1 long, pos2 long, direction string, stop_codon string, notes string, sequence string")
    d = d.withColumns({"references": F.array(F.struct(F.lit("r").alias("acc"), F.lit(protein).alias("target"))), "start_codons": F.array(F.lit("ATG")), "stop_codons": F.array(F.lit("TAA"))})
    got = {r["row_id"]: r for r in curate.refined_calls(d, 2, 50).collect()}
    assert set(got) == {"p", "m"}
    assert (got["p"]["pos1"], got["p"]["pos2"], got["p"]["translation"]) == (4, last, protein)
    assert (got["m"]["pos1"], got["m"]["pos2"], got["m"]["notes"]) == (n - last + 1, n - 3, "old; extending start 9 bp")
    up, down = curate.next_start("sequence", ["ATG"], 10)
    assert sorted(tuple(r) for r in d.where("row_id <> 'w'").select("row_id", up, down).collect()) == [("m", 3, None), ("p", 3, None)]


def test_rules(spark):
    assert params.fish({"rules": {"cob": {"max_len": 5}}})["rules"]["cob"] == {"type": "PCG", "max_len": 5}
    rules = {r["gene"]: r for r in params.effective_rules(params.fish())}
    assert rules["nad1"]["start_codons"][-1] == "TTG" and rules["trnL"]["count"] == 2 and rules["cox1"]["overlap_stop"] is True
    assert {t: params.TARGETS[t][0]()["hit_threshold"] for t in params.TARGETS} == {"fish": 90, "diptera": 80, "starfish": 80}
    import json

    df = spark.createDataFrame([("s", json.dumps(params.fish()))], "curate_opts string, params string")
    merged = {r["gene"]: r for r in params.merged_rules(rule_values(df)).collect()}
    assert len(merged) == len(rules)
    for gene, r in rules.items():
        m = merged[gene]
        assert (m["type"], int(m["count"]), m["start_codons"], m["stop_codons"]) == (r["type"], r["count"], r["start_codons"], r["stop_codons"])


def test_warnings(spark):
    calls = [
        ("c", "PCG", "cox1", 1, 100, "+", "ATG", "TAA", "MA", 95.0),
        ("c", "PCG", "cox1", 71, 200, "+", "CTG", "AGC", "MA*K", None),
        ("c", "tRNA", "trnL", 300, 360, "+", None, None, None, None),
    ]
    d = spark.createDataFrame(calls, CALL + ", start_codon string, stop_codon string, translation string, s double").withColumn("length", F.col("pos2") - F.col("pos1") + 1)
    d = d.withColumn("hits", F.when(F.col("s").isNotNull(), F.array(F.struct(F.col("s").alias("similarity"), F.lit(0).alias("gap_leading"), F.lit(1).alias("gap_trailing")))))
    rules = params.rules_frame(spark, params.fish())
    keys, call = ["contig", "direction"], ["type", "gene", "pos1", "pos2"]
    pieces = V.segments(d.withColumn("n", F.lit(400)), "n")
    found = V.overlaps(pieces, keys, call)
    got = {(r["gene"], r["pos1"]): r["warnings"] for r in V.call_warnings(d, V.worst_of(found, keys, call), rules, keys, call, 0.25, 90).collect()}
    assert got["cox1", 1] == ["exceeds max overlap", "check reference stop alignment"]
    assert got["cox1", 71] == ["exceeds max start overlap", "internal stop codon", "non-standard stop codon", "non-standard start codon", "low reference similarity", "check reference start alignment", "check reference stop alignment"]
    assert got["trnL", 300] == []
    counts = {r["gene"]: r for r in V.count_findings(d, d, params.effective_rules(params.fish()), ["contig"]).collect()}
    assert counts["cox1"]["extra"] == 1 and counts["trnL"]["missing"] and counts["cob"]["missing"] and not counts["cox1"]["missing"]
    track = spark.createDataFrame([("c", p, 5.0 if p <= 6 else 50.0, None) for p in range(1, 101)], "contig string, position long, depth double, error_rate double")
    weak = {r["pos1"]: r["low_coverage"] for r in V.weak_regions(track, pieces, ["contig"], ["gene", "pos1", "pos2"], bucket=32).collect()}
    assert weak[1] and not weak[71]


def test_first_and_last_calls_duplicates_and_count_ranges(spark):
    calls = [("c", "PCG", "cob", p1, p2, d) for p1, p2, d in ((1, 100, "+"), (90, 300, "+"), (290, 500, "+"), (600, 700, "-"), (690, 900, "-"), (890, 1000, "-"))]
    d = spark.createDataFrame(calls, CALL).withColumns({"length": F.lit(1000).cast("long"), "start_codon": F.lit("ATG"), "stop_codon": F.lit("TAA"), "translation": F.lit("M")})
    d = d.withColumn("hits", F.array(F.struct(F.lit(95.0).alias("similarity"), F.lit(0).alias("gap_leading"), F.lit(0).alias("gap_trailing"))))
    keys, call = ["contig", "direction"], ["type", "gene", "pos1", "pos2"]
    rules = params.rules_frame(spark, params.fish())
    worst = V.worst_of(V.overlaps(V.segments(d.withColumn("n", F.lit(1000)), "n"), keys, call), keys, call)
    said = lambda frame: {r["pos1"]: r["warnings"] for r in V.call_warnings(frame, worst, rules, keys, call, 0.25, 90).collect()}
    start, stop = "exceeds max start overlap", "exceeds max stop overlap"
    plain = said(d)
    assert plain == {1: [stop], 90: [start, stop], 290: [start], 600: [start], 690: [start, stop], 890: [stop]}
    # The start of the first + call and the stop of the last one lie outward, as do the stop of the first - call and the start of the last.
    only = lambda s, *p: d.where(F.col("direction") == s).where(F.col("pos1").isin(*p))
    ends = lambda frame: V.with_ends(frame, ["contig"], ["pos1", "pos2"])
    assert said(ends(only("+", 90, 290))) == {90: [stop], 290: [start]}
    assert said(ends(only("-", 600, 690))) == {600: [start], 690: [stop]}
    assert said(ends(only("+", 1, 90))) == {1: [stop], 90: [start]}
    assert said(d.withColumn("high_error", F.col("pos1") == 1).withColumn("low_coverage", F.col("pos1") == 1))[1] == [stop, "low coverage region", "high error region"]
    two = params.effective_rules(params.fish({"rules": {"cob": {"count": [1, 3]}}}))
    assert V.count_range([1, 3]) == (1, 3) and V.count_range(None) == (1, 1) and V.count_range("2") == (2, 2)
    found = {r["gene"]: (r["n_calls"], r["missing"], r["extra"]) for r in V.count_findings(d, d, two, ["contig"]).collect()}
    assert found["cob"] == (6, False, 3) and found["nad1"] == (0, True, 0)
    few = d.where("pos1 < 500")
    assert {r[0] for r in V.with_duplicates(few, few, two, ["contig"]).select("duplicate").collect()} == {False}
    assert {r[0] for r in V.with_duplicates(d, d, two, ["contig"]).select("duplicate").collect()} == {True}
    assert params.rules_frame(spark, params.fish({"rules": {"cob": {"count": [1, 3]}}})).where("gene = 'cob'").first()["count"] == 3
    row = V.sample_summary(d.withColumn("warnings", F.array().cast("array<string>")), ["contig"], ["contig"], ["pos1"], V.count_findings(d, d, two, ["contig"])).first()
    assert row["extra"] == 3 and row["missing"].startswith("ctrl; rrnL; rrnS; nad1") and row["warned"] == 0


def test_tool_output_becomes_calls(spark):
    table = spark.createDataFrame([("c ", 1, 100, 30, "Phe", "GAA"), ("c", 2, 5, 20, "Xxx", "NNN")], "seq string, idx int, begin long, end long, type string, anticodon string")
    got = sorted(tuple(r) for r in An.trna_calls(table).select("contig", "gene", "pos1", "pos2", "length", "direction").where("gene is not null").collect())
    assert got == [("c", "trnF", 30, 100, 71, "-")]
    contig = "TAACCCATGAAAGGGTAGCCCATG"
    heads = spark.createDataFrame(
        [("c", 7, 18, "+", "nad1", "nad1"), ("c", 22, 3, "+", "cob", "cob"), ("c", 1, 4, "+", "OH_0", "OH"), ("c", 1, 4, "+", "OH_1", "OH"), ("c", 2, 9, "-", "rrnS", "rrnS"), ("x", 1, 9, "+", "cox1", "cox1")],
        "contig string, pos1 long, pos2 long, direction string, gene_id string, gene string",
    )
    contigs = spark.createDataFrame([("c", contig)], "contig string, sequence string")
    calls = {(r["contig"], r["gene"]): r for r in An.gene_calls(heads, contigs, 2).collect()}
    assert len(calls) == 5
    nad1, cob = calls["c", "nad1"], calls["c", "cob"]
    assert (nad1["type"], nad1["start_codon"], nad1["stop_codon"], nad1["translation"], nad1["length"]) == ("PCG", "ATG", "TAG", "MKG", 12)
    assert (cob["start_codon"], cob["stop_codon"], cob["translation"], cob["length"], cob["product"]) == ("ATG", "TAA", "M", 6, "cytochrome b")
    assert calls["c", "rrnS"]["type"] == "rRNA" and calls["c", "rrnS"]["start_codon"] is None
    assert calls["c", "OH"]["type"] == "ctrl" and calls["x", "cox1"]["translation"] is None
    both = An.combine(An.trna_calls(table), An.gene_calls(heads, contigs, 2))
    assert both.count() == 7 and "anticodon" in both.columns


def test_neighbours_of_a_hot_contig(spark):
    import random

    from organelia.operators import windows as W

    rng = random.Random(4)
    rows = [(k, rng.randint(1, 12), rng.randint(1, 4), f"g{i}") for i, k in enumerate(["hot"] * 300 + ["b", "b", None, None, "c"])]
    d = spark.createDataFrame(rows, "k string, p int, q int, g string")
    got = {r["g"]: (r["b"], r["a"]) for r in W.neighbours(d, ["k"], ["p", "q", "g"], {"b": "g"}, {"a": "g"}).collect()}
    for key in ("hot", "b", None, "c"):
        names = [g for *_, g in sorted((p, q, g) for k, p, q, g in rows if k == key)]
        for i, g in enumerate(names):
            assert got[g] == (names[i - 1] if i else None, names[i + 1] if i + 1 < len(names) else None)


def test_unique_names_pass_over_taken_ones(spark):
    from organelia.operators import windows as W

    rows = [("c", "x", 1, 1), ("c", "x", 1, 2), ("c", "x", 5, 1), ("c", "x", 9, 1), ("c", "x.1", 2, 1), ("c", "x.3", 2, 2), ("c", "x.3", 2, 3), ("d", "x", 1, 1), ("d", "x", 2, 1), (None, "y", 1, 1), (None, "y", 1, 2), ("d", None, 3, 3)]
    d = spark.createDataFrame(rows, "k string, g string, p int, q int")
    got = {(r["k"], r["p"], r["q"]): r["name"] for r in W.make_unique(d, ["k"], "g", ["p", "q"], "name").collect()}
    assert got == {("c", 1, 1): "x", ("c", 1, 2): "x.2", ("c", 5, 1): "x.4", ("c", 9, 1): "x.5", ("c", 2, 1): "x.1", ("c", 2, 2): "x.3", ("c", 2, 3): "x.3.1", ("d", 1, 1): "x", ("d", 2, 1): "x.1", (None, 1, 1): "y", (None, 1, 2): "y.1", ("d", 3, 3): None}
