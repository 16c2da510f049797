import random

import pytest
from pyspark.sql import functions as F

from organelia.operators.intervals import covered_and_gaps, flip, flip_strand, overlap_join, point_join, rotate, rotate_reverse, sweep

CALLS = "id string, path int, scaffold int, direction string, pos1 long, pos2 long, kind string, k string, bucket long, pos int"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def brute(spans):
    out = set()
    for key in {s[0] for s in spans}:
        mine = sorted((a, b if b is not None else float("inf")) for k, a, b in spans if k == key)
        first, end = mine[0]
        for a, b in mine[1:]:
            if a > end + 1:
                out |= {(key, "covered", first, end), (key, "gap", end + 1, a - 1)}
                first, end = a, b
            else:
                end = max(end, b)
        out.add((key, "covered", first, None if end == float("inf") else end))
    return out


@pytest.mark.parametrize("bucket", [1, 4, 1 << 16])
def test_sweep_equals_brute_force(spark, bucket):
    rng = random.Random(bucket)
    spans = []
    for key in ("a", "b", None):
        for _ in range(25):
            s = rng.randint(1, 120)
            spans.append((key, s, s + rng.randint(0, 9)))
    spans += [("c", 5, None), ("c", 1, 2), ("c", 9, 10), ("d", 3, 3)]
    spans += spans[:20]
    df = spark.createDataFrame(spans, "key string, s long, e long")
    got = {tuple(r) for r in sweep(df, ["key"], F.col("s"), F.col("e"), bucket).collect()}
    assert got == brute(spans)


def test_ignored_rows_and_no_rows(spark):
    df = spark.createDataFrame([("a", None, 3), ("a", 5, 4)], "key string, s long, e long")
    assert sweep(df, ["key"], F.col("s"), F.col("e")).count() == 0
    assert sweep(df.limit(0), ["key"], F.col("s"), F.col("e")).count() == 0


def test_calls_with_nulls_copies_wraps_and_clashing_columns(spark):
    extra = ("x", "y", 1, 2)
    data = [
        ("s", 1, 1, "+", 10, 20),
        ("s", 1, 1, "+", 10, 20),
        ("s", 1, 1, "+", 12, 15),
        ("s", 1, 1, "+", 21, 30),
        ("s", 1, 1, "+", 40, 50),
        ("s", 1, 1, "+", 90, 5),
        ("s", 1, 1, "-", 100, 110),
        ("s", 1, 1, None, 60, 70),
        ("s", 1, 1, "+", None, 70),
        ("s", 1, 1, "+", 60, None),
        ("s", 1, 1, "+", 0, 0),
        (None, None, 1, "+", 1, 2),
        (None, None, 1, "+", 5, 6),
    ]
    df = spark.createDataFrame([(*d, *extra) for d in data], CALLS)
    got = rows(covered_and_gaps(df).where("kind = 'gap'").drop("kind"))
    assert got == sorted([("s", 1, 1, "+", 6, 9), ("s", 1, 1, "+", 31, 39), ("s", 1, 1, "+", 51, 89), (None, None, 1, "+", 3, 4)], key=str)
    covered = rows(covered_and_gaps(df).where("kind = 'covered' and seg_end is null"))
    assert covered == [("s", 1, 1, "+", "covered", 90, None)]


def test_joins_find_each_pair_once(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), i, s, s + rng.randint(0, 40)) for i in range(60) for s in [rng.randint(0, 200)]]
    df = spark.createDataFrame(data + [("a", 99, None, 5)], "key string, n int, start long, end long")
    expected = {(x[0], x[1], y[1]) for x in data for y in data if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]}
    found = overlap_join(df, df, ["key"], 16).select("key", "n", "r_n").collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected
    points = spark.createDataFrame([("a", p) for p in range(0, 250, 7)], "key string, p long")
    hits = point_join(points, df, ["key"], "p", 16).select("p", "n").collect()
    assert {tuple(r) for r in hits} == {(p, x[1]) for p in range(0, 250, 7) for x in data if x[0] == "a" and x[2] <= p <= x[3]}


def test_circular_maps(spark):
    df = spark.createDataFrame([(41, 50, "+"), (91, 100, "+"), (31, 40, "+"), (61, 70, "+")], "a long, b long, d string")
    n = F.lit(100)
    forward = rotate(F.col("a"), F.col("b"), F.lit(41), n)
    assert rows(df.where("a <> 61").select(*forward)) == sorted([(1, 10), (51, 60), (91, 100)], key=str)
    back = rotate_reverse(F.col("a"), F.col("b"), F.lit(50), n)
    assert rows(df.where("a in (41, 61)").select(*back)) == sorted([(1, 10), (81, 90)], key=str)
    twice = flip(*flip(F.col("a"), F.col("b"), n), n)
    assert rows(df.select(*twice)) == rows(df.select("a", "b"))
    assert rows(df.select(flip_strand(flip_strand(F.col("d"))).alias("d")).distinct()) == [("+",)]


def test_worst_overlaps_equal_all_pairs(spark):
    """Against every pair, on nested, equal, touching and hot spans."""
    import random

    from organelia.operators.intervals import worst_overlaps

    rng = random.Random(13)
    rows = []
    for key, n, reach, longest in (("a", 60, 40, 12), ("b", 80, 300, 200), ("c", 200, 60, 60), ("d", 1, 10, 5), ("e", 30, 2000, 3)):
        for _ in range(n):
            s = rng.randint(0, reach)
            rows.append((key, s, s + rng.randint(0, longest), "x"))
    rows += [(None, 1, 5, "x"), ("f", None, 5, "x"), ("f", 5, None, "x"), ("f", 9, 3, "x"), ("g", 7, 7, "x"), ("g", 7, 7, "x")]
    df = spark.createDataFrame(rows, "k string, p long, q long, s string")
    got = {(r["k"], r["p"], r["q"]): (r["any_overlap"], r["left_overlap"], r["right_overlap"]) for r in worst_overlaps(df, ["k"], "p", "q").collect()}
    good = [r for r in rows if None not in r[:3] and r[2] >= r[1]]
    want = {}
    for i, (k, s, e, _) in enumerate(good):
        shared = [(min(e, e2) - max(s, s2) + 1, s2 <= s <= e2, s2 <= e <= e2) for n, (k2, s2, e2, _) in enumerate(good) if n != i and k2 == k]
        shared = [x for x in shared if x[0] > 0]
        most = lambda xs: max(xs, default=None)
        want[k, s, e] = (most([x[0] for x in shared]), most([x[0] for x in shared if x[1]]), most([x[0] for x in shared if x[2]]))
    assert got == want
    assert worst_overlaps(df.limit(0), ["k"], "p", "q").count() == 0
