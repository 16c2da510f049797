import random
from datetime import datetime, timedelta

from organelia.operators.references import Reference, orphans

CHILD = "id string, ref string, loaded_at timestamp_ntz, t int, key string"
PARENT = "name string, loaded_at timestamp_ntz, removed_at timestamp_ntz, m string"


def brute(children, parents):
    out = set()
    for i, ref, at in children:
        if ref is None:
            continue
        key = ref.strip().lower()
        live = at is not None and any(n is not None and n.strip().lower() == key and s is not None and s <= at and (r is None or at < r) for n, s, r in parents)
        if not live:
            out.add(("child", None if at is None else at.strftime("%Y-%m"), i, key))
    return out


def run(spark, children, parents, **options):
    c = spark.createDataFrame([(*x, 1, "x") for x in children], CHILD)
    p = spark.createDataFrame([(*x, "y") for x in parents], PARENT)
    found = orphans([Reference("child", c, "id", "ref", p, "name")], **options).collect()
    assert len(found) == len({tuple(r) for r in found})
    return {tuple(r) for r in found}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(hours=rng.randint(0, 24 * 120))
    parents = []
    for i in range(30):
        s = at()
        parents.append((rng.choice(["K", "k "]) + str(i % 12), s, rng.choice([None, s + timedelta(days=rng.randint(0, 60))])))
    children = [(f"c{i % 40}", rng.choice([f"k{rng.randint(0, 14)}", f" K{rng.randint(0, 14)}"]), at()) for i in range(300)]
    children += [(f"hot{i}", "k1", at()) for i in range(150)]
    assert run(spark, children, parents, dictionaries=3, salts=4) == brute(children, parents)


def test_edges(spark):
    t = datetime(2024, 3, 1)
    children = [("a", None, t), ("b", "", t), ("c", "x", None), ("d", "x", t), ("d", "x", t), (None, "y", t), ("e", "x", t - timedelta(microseconds=1)), ("f", "w", t)]
    parents = [("X ", t, None), (None, t, None), ("w", None, None), ("w", t, t), ("x", t, None)]
    assert run(spark, children, parents) == brute(children, parents)
    assert run(spark, children, []) == brute(children, [])
    assert run(spark, [], parents) == set()


def test_many_rows_without_a_time(spark):
    t = datetime(2024, 3, 1)
    children = [(f"c{i}", rng_key, None) for i in range(80) for rng_key in ("k1", "k2")] + [("d", "k1", t), ("e", "k2", t)]
    parents = [("k1", t, None), ("k2", t + timedelta(days=40), None)]
    assert run(spark, children, parents) == brute(children, parents)
    only = [(f"c{i}", "k1", None) for i in range(5)]
    assert run(spark, only, parents) == brute(only, parents)
