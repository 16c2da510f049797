import random

from organelia.llm.mixture import Target, fit_lengths, mix_sources, mixture_faults
from organelia.llm.tokens import count_tokens


def reachable(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= budget}
    return max(sums)


def test_fit_is_exact_within_the_window():
    rng = random.Random(4)
    for _ in range(80):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 6)))
        counts = [rng.randint(0, 5) for _ in lengths]
        budget = rng.randint(0, 300)
        take = fit_lengths(lengths, counts, budget)
        total = sum(n * k for n, k in zip(lengths, take, strict=True))
        assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))
        assert total == reachable(lengths, counts, budget)


def test_fit_of_a_large_budget():
    rng = random.Random(5)
    lengths = list(range(3, 900, 2))
    counts = [rng.randint(1, 400) for _ in lengths]
    budget = sum(n * c for n, c in zip(lengths, counts, strict=True)) // 3
    take = fit_lengths(lengths, counts, budget, window=4096)
    assert sum(n * k for n, k in zip(lengths, take, strict=True)) == budget
    assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, n string, c int")


def run(spark, rows, targets, **options):
    chosen, shares = mix_sources(documents(spark, rows), targets, ranges=4, **options)
    return {r["doc_id"]: r for r in chosen.collect()}, {r["source"]: r for r in shares.collect()}


def test_shares_repeats_and_dirt(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["gene", "contig", "of", "the", "depth"]) for _ in range(rng.randint(1, 60)))
    rows = [(i, text(), rng.choice(["big", " BIG", "Big "])) for i in range(200)] + [(1000 + i, text(), "small") for i in range(10)]
    rows += [(5000, None, "big"), (None, "x y", "big"), (5001, "", "big"), (5002, "x", None), (5003, "x", "other"), rows[0], rows[-1]]
    targets = [Target("big", 0.5, 1), Target("small", 0.45, 3), Target("none", 0.05, 5)]
    chosen, shares = run(spark, rows, targets)
    tokens = {i: count_tokens(t) for i, t, _ in rows if t}
    limit = {"big": 1, "small": 3}
    for i, r in chosen.items():
        assert 1 <= r["copies"] <= limit[r["source"]] and r["n_tokens"] == tokens[i]
    total = sum(r["copies"] * r["n_tokens"] for r in chosen.values())
    for name in ("big", "small"):
        got = sum(r["copies"] * r["n_tokens"] for r in chosen.values() if r["source"] == name)
        assert shares[name]["chosen_tokens"] == got and abs(got - shares[name]["budget_tokens"]) <= 1
        assert abs(shares[name]["actual_share"] - got / total) < 1e-12
        assert abs(got / total - shares[name]["target_share"] / 0.95) < 0.001
    assert shares["none"]["chosen_tokens"] == 0 and shares["none"]["actual_share"] == 0
    assert not {5000, None, 5001, 5002, 5003} & set(chosen)
    again, _ = run(spark, list(reversed(rows)), targets)
    assert {i: r["copies"] for i, r in again.items()} == {i: r["copies"] for i, r in chosen.items()}


def test_a_total_beyond_what_there_is(spark):
    rows = [(i, "one two three", "a") for i in range(5)] + [(10, "one two three", "b")]
    chosen, shares = run(spark, rows, [Target("a", 0.5, 2), Target("b", 0.5, 1)], total_tokens=10**6)
    assert {r["copies"] for i, r in chosen.items() if i < 10} == {2} and chosen[10]["copies"] == 1
    assert shares["a"]["chosen_tokens"] == 10 * count_tokens("one two three")


def test_nothing(spark):
    chosen, shares = run(spark, [(1, None, "a")], [Target("a", 1.0, 1)])
    assert not chosen and shares["a"]["chosen_tokens"] == 0
    chosen, shares = run(spark, [(1, "x", "a")], [])
    assert not chosen and not shares


def test_fit_meets_the_budget_at_any_window():
    """What is taken evenly costs no token: the exact part closes the rest of the budget, if it is as long as a few documents."""
    rng = random.Random(11)
    for _ in range(30):
        lengths = sorted(rng.sample(range(5, 3000), 200))
        counts = [rng.randint(0, 90) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = rng.randint(total // 5, total - 1)
        for window in (1 << 14, 1 << 16):
            take = fit_lengths(lengths, counts, budget, window)
            assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))
            assert budget - sum(n * k for n, k in zip(lengths, take, strict=True)) <= 1


def test_faults_are_seen(spark):
    rows = [(i, "one two three", "a") for i in range(6)] + [(10 + i, "one two three", " B") for i in range(6)]
    targets = [Target("a", 0.5, 1), Target("b", 0.5, 1), Target("none", 0.2, 1)]
    df = documents(spark, rows)
    chosen, shares = mix_sources(df, targets, ranges=4)
    see = lambda c, s=shares: {r["source"]: tuple(r)[1:] for r in mixture_faults(c, s, df, targets).collect()}
    assert see(chosen) == {k: (0, 0, 0, False) for k in ("a", "b", "none")}
    from pyspark.sql import functions as F

    assert see(chosen.withColumn("copies", F.lit(2)))["a"] == (0, 6, 0, False)
    assert see(chosen.withColumn("n_tokens", F.lit(99)))["b"][2] == 6
    assert see(chosen.withColumn("source", F.lit("a")))["a"][0] == 6
    assert see(chosen, shares.withColumn("chosen_tokens", F.when(F.col("source") == "a", 0).otherwise(F.col("chosen_tokens"))))["b"][3]
