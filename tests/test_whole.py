"""Queries and plans that must see the whole of their input."""

import random

from pyspark.sql import functions as F

from organelia.functions import align
from organelia.functions.seq import genetic_code
from organelia.plans import engine, formats

CODE = genetic_code(2)
ANNOTATIONS = "id string, path int, scaffold int, type string, gene string, product string, pos1 long, pos2 long, direction string, anticodon string, start_codon string, stop_codon string, translation string"


def write(spark, base, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}.parquet")


def call(sample, gene, pos1, pos2, kind="PCG", direction="+", stop="TAA", translation=None):
    return (sample, 1, 1, kind, gene, "p", pos1, pos2, direction, None, "ATG", stop, translation)


def contigs(spark, base, rows):
    write(spark, base, "assemblies", [(i, 1, 1, t, s) for i, t, s in rows], "id string, path int, scaffold int, topology string, sequence string")


def test_pairs_together_as_alone():
    rng = random.Random(5)
    letters = align.AMINO + "*X"
    text = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    queries = [text(40) for _ in range(150)]
    targets = [q[rng.randint(0, 5) :] + text(6) if rng.random() < 0.7 else text(40) for q in queries]
    queries += [None, "", "MK", "M-K", "Mé"]
    targets += ["MK", "MK", None, "MK", "MK"]
    assert align.compare_many(queries, targets) == [align.compare(q, t) for q, t in zip(queries, targets, strict=True)]


def test_bound_never_loses_a_target():
    rng = random.Random(6)
    base = [rng.choice(align.AMINO) for _ in range(60)]
    change = lambda s, p: "".join(rng.choice(align.AMINO) if rng.random() < p else c for c in s)
    targets = [change(base, 0.1)[: rng.choice([60, 60, 55])] for _ in range(9)]
    queries = [change(base, p)[rng.randint(0, 20) :] for p in (0.1, 0.3, 0.5, 0.6, 0.7, 0.9) for _ in range(8)]
    for threshold in (10, 40, 60):
        reached = [any((align.compare(q, t)[1] or -1e9) >= threshold for t in targets) for q in queries]
        assert align.may_reach(queries, targets, threshold) == reached
        assert {True, False} == set(reached)


def test_every_protein_of_the_gene_is_a_reference(spark, tmp_path):
    rng = random.Random(7)
    body = [rng.choice([c for c, a in CODE.items() if a not in "*MIV"]) for _ in range(40)]
    protein = "M" + "".join(CODE[c] for c in body)
    near = [protein[:k] + "W" + protein[k + 1 :] for k in (20, 25, 30, 35)]
    far = ["A" * 41, "Y" * 41]
    contig = "CC" + "C" + "".join(["ATG", *body, "TAA"]) + "CCCC"
    last = 3 + 3 * 42
    rows = [call("a", "cob", 4 + 9, last), *[call(f"r{k}", "cob", 1, 9, translation=t) for k, t in enumerate([protein, *near, *far])]]
    write(spark, str(tmp_path), "annotations", rows, ANNOTATIONS)
    contigs(spark, str(tmp_path), [("a", "circular", contig)])
    pairs = engine.protein_similarity(spark, str(tmp_path))
    assert pairs.count() == 49 and pairs.where(F.col("query_md5") == F.col("target_md5")).where("similarity = 100").count() == 7
    got = engine.curate_boundaries(spark, str(tmp_path)).collect()
    assert [(r["pos1"], r["pos2"], r["notes"]) for r in got] == [(4, last, "extending start 9 bp")]


def test_calls_over_the_origin_are_refined(spark, tmp_path):
    rng = random.Random(8)
    body = [rng.choice([c for c, a in CODE.items() if a not in "*MIV"]) for _ in range(40)]
    protein = "M" + "".join(CODE[c] for c in body)
    contig = "CC" + "C" + "".join(["ATG", *body, "TAA"]) + "C" * 100
    n, last = len(contig), 3 + 3 * 42
    rows, placed = [call("ref", "cob", 1, 9, translation=protein)], []
    other = str.maketrans("ACGT", "TGCA")
    for k, cut in enumerate((40, 8, 12, 15, 90)):
        turned = contig[cut:] + contig[:cut]
        at = lambda p, cut=cut: (p - 1 - cut) % n + 1
        late, end = at(4 + 9), at(last)
        rows += [call(f"p{k}", "cob", late, end), call(f"m{k}", "cob", n - end + 1, n - late + 1, direction="-")]
        placed += [(f"p{k}", "circular", turned), (f"m{k}", "circular", turned.translate(other)[::-1])]
        if k == 0:
            placed.append(("l0", "linear", turned))
            rows.append(call("l0", "cob", late, end))
    write(spark, str(tmp_path), "annotations", rows, ANNOTATIONS)
    contigs(spark, str(tmp_path), placed)
    got = {r["row_id"].split("|")[0]: (r["pos1"], r["pos2"], r["length"], r["start_codon"], r["notes"]) for r in engine.curate_boundaries(spark, str(tmp_path)).collect()}
    for k, cut in enumerate((40, 8, 12, 15, 90)):
        first, end = (4 - 1 - cut) % n + 1, (last - 1 - cut) % n + 1
        shared = (3 * 42, "ATG", "extending start 9 bp")
        if cut in (40, 15, 90):
            assert (got[f"p{k}"], got[f"m{k}"]) == ((first, end, *shared), (n - end + 1, n - first + 1, *shared))
        else:
            assert got[f"p{k}"][4] is None  # the part to add lies over the origin of a call that does not
    assert "l0" not in got


def final_plan(df):
    """The plan as it ran."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return plan.toString().partition("Initial Plan")[0]


def test_no_base_is_broadcast(spark, tmp_path):
    bases = 300
    depth = [str(k % 7) if k % 11 else "NA" for k in range(bases)]
    rows = [(f"s{k}", 1, 1, "linear", "ACGTN" * (bases // 5), " ".join(depth), "0 " * (bases - 1) + "0" if k % 2 else None) for k in range(3)]
    write(spark, tmp_path, "assemblies", rows, "id string, path int, scaffold int, topology string, sequence string, depth string, errors string")
    for query in (formats.scan_read_counts, engine.coverage_track):
        plan = final_plan(query(spark, str(tmp_path)))
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    got = {(r["seq_id"], r["position"]): (r["call"], r["depth"], r["correct"]) for r in formats.scan_read_counts(spark, str(tmp_path)).collect()}
    expected = {}
    for k in range(3):
        for i, d in enumerate(depth):
            n, call = 0 if d == "NA" else int(d), "ACGTN"[i % 5]
            expected[f"s{k}.1.1", i + 1] = (call, float(n), 0.0 if d == "NA" else None if call == "N" else float(max(n - (i + 1) % 3, 0)))
    assert got == expected
