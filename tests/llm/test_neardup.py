import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from organelia.llm import neardup as N

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def words(s):
    s = s.upper()
    return {min(w, w[::-1].translate(COMPLEMENT)) for i in range(len(s) - 15) if set(w := s[i : i + 16]) <= set("ACGT")}


def brute(data):
    sets = {k: words(s) for k, s in data if s is not None and k is not None}
    sets = {k: w for k, w in sets.items() if w}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}


def sequence(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.random()
        if kind < 0.4:
            s[i] = rng.choice("ACGTN")
        elif kind < 0.7:
            s.insert(i, rng.choice("ACGT"))
        else:
            del s[i]
    return "".join(s)


def test_words_registers_and_packing():
    rng = random.Random(1)
    s = edited(rng, sequence(rng, 3000), 40) + "acgtRYacgtn"
    bases = N.encode(s)
    assert (N.unpack(N.pack(bases)) == bases).all()
    assert len(set(N.words(bases).tolist())) == len(words(s))
    assert (N.unpack(N.pack(N.encode(""))) == N.encode("")).all()
    h = np.unique(N.mix(N.words(bases)))
    regs = N.registers_of(h)
    filled = {int(x) >> 57 for x in h}
    for j in range(N.REGISTERS):
        mine = [int(x) for x in h if int(x) >> 57 == j]
        if not mine:
            assert regs[j] == regs[next(k for k in N._probes(N.REGISTERS)[j] if k in filled)]
            continue
        rest = (min(mine) << 7) % 2**64
        zeros = 64 - rest.bit_length()
        value = zeros << N.MANTISSA | ((rest << (zeros + 1)) % 2**64) >> (64 - N.MANTISSA)
        assert int(regs[j]) % 2**32 == value


def found(spark, data):
    df = spark.createDataFrame(data, "key string, sequence string").withColumn("fp", F.lit(1)).withColumn("band", F.lit("x"))
    members, links = N.near_duplicates(df, F.col("key"), F.col("sequence"))
    return members, links


@pytest.mark.parametrize("sizes", [(2000, 900), (400, 207, 120), (60, 40, 25), (22, 19)])
def test_pairs_equal_brute_force(spark, sizes):
    rng = random.Random(sum(sizes))
    data = []
    for g in range(12):
        first = sequence(rng, sizes[g % len(sizes)])
        data.append((f"g{g}.0", first))
        for i in range(1, 4):
            data.append((f"g{g}.{i}", edited(rng, first, rng.randint(0, max(1, len(first) // 60)))))
    data += [("rc", data[0][1][::-1].translate(COMPLEMENT)), ("low", data[0][1].lower()), ("joined", data[0][1] + data[4][1])]
    data += [(None, data[0][1]), ("null", None), ("short", "ACGT"), ("n", "N" * 50), ("empty", "")]
    data += data[:5]
    members, links = found(spark, data)
    pairs = N.similar_pairs(members, links).collect()
    assert {tuple(r) for r in pairs} == brute(data)
    assert len(pairs) == len({tuple(r) for r in pairs})


@pytest.mark.parametrize("size", [3, 4, 8, 20, 40, 100, 200, 400, 3000])
def test_recall_of_the_sketches_alone(size):
    """Pairs of sets at or just above similarity 0.5 share a band and pass the estimate, at every size alike."""
    rng = np.random.default_rng(size)
    shared = -(-2 * size // 3)
    missed = 0
    for _ in range(500):
        draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)
        common = draw(shared)
        a, b = (N.registers_of(np.sort(np.concatenate((common, draw(size - shared))))) for _ in range(2))
        same = a == b
        missed += not ((same[::2] & same[1::2]).any() and same.mean() >= 0.5 - N.SLACK * (0.25 / N.REGISTERS) ** 0.5)
    assert missed <= 2


def test_copies_are_one_class(spark):
    rng = random.Random(9)
    s = sequence(rng, 500)
    members, links = found(spark, [(f"k{i:03d}", s) for i in range(200)])
    assert members.select("fp").distinct().count() == 1 and links.count() == 0


def test_no_rows(spark):
    members, links = found(spark, [("a", None)])
    assert members.count() == 0 and links.count() == 0 and N.similar_pairs(members, links).count() == 0
