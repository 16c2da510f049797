"""Near-duplicate sequences: HyperMinHash sketches, banding, corrected estimate, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from organelia.session import cut, ship

K = 16
THRESHOLD = 0.5
#: Registers of a sketch (a power of two) and registers per band.
REGISTERS = 128
ROWS = 2
#: A register is the leading-zero count of its bucket's least hash and this many mantissa bits.
MANTISSA = 26
#: Standard deviations by which a pair's estimate may be below the threshold before it is not verified.
SLACK = 6

_BASES = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _BASES[_c] = _BASES[_c + 32] = _i

_U = np.uint64


def encode(text: str) -> np.ndarray:
    """Bases as 0 to 3; 4 for any other letter."""
    return _BASES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def words(bases: np.ndarray) -> np.ndarray:
    """The 16-base words of a sequence as 32-bit codes, the lesser of a word and its reverse complement; words with another letter are left out."""
    n = bases.size - K + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    fwd = (bases & 3).astype(np.uint32)
    rev = 3 - fwd
    w = 1
    while w < K:
        shift = np.uint32(2 * w)
        fwd = (fwd[:-w] << shift) | fwd[w:]
        rev = rev[:-w] | (rev[w:] << shift)
        w *= 2
    out = np.minimum(fwd, rev)
    other = bases == 4
    if other.any():
        seen = np.concatenate((np.zeros(1, np.int32), np.cumsum(other, dtype=np.int32)))
        out = out[seen[K:] == seen[:-K]]
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing permutation."""
    h = x.astype(np.uint64)
    h *= _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xCA9B0C7EBA1DA115)
    h ^= h >> _U(32)
    return h


@cache
def _starts(registers: int) -> np.ndarray:
    return np.arange(registers, dtype=np.uint64) << _U(64 - int(math.log2(registers)))


@cache
def _probes(registers: int) -> np.ndarray:
    """For each bucket the order in which an empty one looks at the others: fixed permutations."""
    rng = np.random.Generator(np.random.PCG64(20))
    return np.stack([rng.permutation(registers) for _ in range(registers)])


def registers_of(hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """HyperMinHash registers of ascending distinct hashes, of which there is at least one.

    The top bits choose the bucket. Of the least hash in a bucket, the register keeps the leading-zero
    count of the rest and the ``MANTISSA`` bits after the leading one. A bucket without a hash takes the register of the
    first filled one in its fixed order, so registers of two sets agree with the probability of
    their similarity, however small the sets are (densified one-permutation hashing).
    """
    p = int(math.log2(registers))
    starts = _starts(registers)
    at = np.searchsorted(hashes, starts)
    least = hashes[np.minimum(at, hashes.size - 1)]
    filled = (at < hashes.size) & ((least >> _U(64 - p)) == (starts >> _U(64 - p)))
    rest = least << _U(p)
    zeros = 63 - np.floor(np.log2(np.maximum(rest, 1).astype(np.float64))).astype(np.int64)
    # As a float, a number just below a power of two may round up to it.
    zeros = np.where(rest == 0, 64 - p, np.where((rest << np.maximum(zeros, 0).astype(np.uint64)) < _U(1 << 63), zeros + 1, zeros))
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> _U(64 - MANTISSA)
    value = (zeros.astype(np.uint64) << _U(MANTISSA) | mantissa).astype(np.uint32).view(np.int32)
    empty = np.flatnonzero(~filled)
    if empty.size:
        order = _probes(registers)[empty]
        value[empty] = value[order[np.arange(empty.size), filled[order].argmax(axis=1)]]
    return value


def pack(bases: np.ndarray) -> bytes:
    """A sequence in two bits a base; other letters as runs in front."""
    other = np.flatnonzero(np.diff(np.concatenate(([0], (bases == 4).view(np.int8), [0]))))
    two = (bases & 3).astype(np.uint8)
    two = np.concatenate((two, np.zeros(-two.size % 4, np.uint8))).reshape(-1, 4)
    body = two[:, 0] << 6 | two[:, 1] << 4 | two[:, 2] << 2 | two[:, 3]
    return np.concatenate((np.array([bases.size, other.size], np.uint32), other.astype(np.uint32))).tobytes() + body.astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, runs = np.frombuffer(data, np.uint32, 2)
    edges = np.frombuffer(data, np.uint32, runs, 8)
    body = np.frombuffer(data, np.uint8, -1, 8 + 4 * int(runs))
    bases = np.empty((body.size, 4), np.uint8)
    for i, s in enumerate((6, 4, 2, 0)):
        bases[:, i] = (body >> s) & 3
    out = bases.reshape(-1)[:n]
    for a, b in edges.reshape(-1, 2):
        out[a:b] = 4
    return out


_SKETCH = pa.schema([("key", pa.string()), ("fp", pa.binary()), ("n", pa.int32()), ("regs", pa.list_(pa.int32())), ("packed", pa.binary())])


def sketches(keyed: DataFrame) -> DataFrame:
    """(key, fp, n, regs, packed) of each (key, sequence) with at least one valid word.

    ``fp`` is a 128-bit fingerprint of the set of words, ``n`` its size. One Arrow pass over the table,
    without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text is None or key is None:
                        continue
                    bases = encode(text)
                    h = np.sort(mix(words(bases)))
                    if not h.size:
                        continue
                    if h.size > 1:
                        h = h[np.concatenate((np.ones(1, bool), h[1:] != h[:-1]))]
                    fp = np.array([h.sum(dtype=np.uint64), ((h ^ (h >> _U(31))) * _U(0x9FB21C651E98DF25)).sum(dtype=np.uint64)], ">u8").tobytes()
                    rows.append((key, fp, h.size, registers_of(h), pack(bases)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SKETCH.types, strict=True)], schema=_SKETCH)

    ship(keyed.sparkSession)
    return keyed.select("key", "sequence").where("key is not null and sequence is not null").mapInArrow(run,
        "key string, fp binary, n int, regs array<int>, packed binary")


def _candidates(reps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints that share a band."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.slice("regs", i * ROWS + 1, ROWS)))
    rows = reps.select("fp", F.explode(bands).alias("band"))
    a, b = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    return a.join(b, "band").where("a < b").select("a", "b").distinct()


def corrected_estimate(ra: Column, rb: Column, na: Column, nb: Column) -> Column:
    """Jaccard estimate from two register arrays, less the matches expected by chance."""
    same = F.aggregate(F.zip_with(ra, rb, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    ratio = F.greatest(na, nb) / F.least(na, nb)
    # Fixed value: the constant of the published approximation of the expected collisions.
    chance = 0.169919487159739 * REGISTERS / 2**MANTISSA * 4 * ratio / F.pow(1 + ratio, 2)
    return (same - chance) / REGISTERS


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """Exact similarity of (a, b, pa, pb); the words of ``a`` are kept while it stays the same."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wa = None, np.empty(0, np.uint32)
        for batch in batches:
            out = []
            a, b, x, y = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                ka = a[i].as_py()
                if ka != last:
                    last, wa = ka, _distinct(words(unpack(x[i].as_py())))
                wb = _distinct(words(unpack(y[i].as_py())))
                both = np.sort(np.concatenate((wa, wb)))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                similarity = shared / max(wa.size + wb.size - shared, 1)
                if similarity >= threshold:
                    out.append((ka, b[i].as_py(), similarity))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    ship(pairs.sparkSession)
    return pairs.select("a", "b", "pa", "pb").mapInArrow(run, "a binary, b binary, similarity double")


def _distinct(x: np.ndarray) -> np.ndarray:
    s = np.sort(x)
    return s[np.concatenate((np.ones(1, bool), s[1:] != s[:-1]))] if s.size else s


def near_duplicates(df: DataFrame, key: Column, sequence: Column, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sets, and the similar pairs between classes.

    Returns ``members`` (key, fp): every key with its class, and ``links`` (a, b, similarity): every pair
    of classes, a < b, with exact similarity of at least ``threshold`` (0.5 or more).

    1. One pass sketches each sequence. Equal word sets (copies, reverse complements, other case) are one
       class from here on; a group of copies is never paired within itself.
    2. Classes that share a band of registers are candidates. At similarity 0.5 a pair shares none of the 64
       bands with probability 0.75 ** 64, 1e-8.
    3. Candidates whose collision-corrected estimate is over six standard deviations below the threshold
       are dropped (at similarity 0.5, with a probability of about 1e-9), the others are verified on their
       whole word sets. Sets of every size go the same way.

    NULL keys and sequences, and sequences without a valid word (shorter than 16, or no 16 bases of A, C,
    G, T in a row), are in no class. Repeated rows are one member. No rows in, no rows out. Columns other
    than key and sequence are not read.
    """
    made = cut(sketches(df.select(key.cast("string").alias("key"), sequence.cast("string").alias("sequence"))))
    members = made.select("key", "fp").distinct()
    reps = cut(made.groupBy("fp").agg(F.min(F.struct("key", "n", "regs")).alias("r")).select("fp", "r.key", "r.n", "r.regs"))
    side = reps.select("fp", "n", "regs")
    a = side.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = side.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    both = _candidates(reps).join(a, "a").join(b, "b")
    estimate = corrected_estimate(F.col("ra"), F.col("rb"), F.col("na"), F.col("nb"))
    slack = SLACK * math.sqrt(threshold * (1 - threshold) / REGISTERS)
    # Sizes alone can rule a pair out.
    fits = (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (estimate >= threshold - slack)
    likely = cut(both.where(fits).select("a", "b"))
    needed = likely.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    packed = made.join(reps.select("fp", "key"), ["fp", "key"]).join(needed, "fp", "left_semi").groupBy("fp").agg(F.min("packed").alias("packed"))
    x, y = packed.select(F.col("fp").alias("a"), F.col("packed").alias("pa")), packed.select(F.col("fp").alias("b"), F.col("packed").alias("pb"))
    links = _verify(likely.join(y, "b").join(x, "a").sortWithinPartitions("a"), threshold)
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of members of linked classes or of one class, distinct."""
    m = members.select("fp", "key")
    one = m.select("fp", F.col("key").alias("key_a")).join(m.select("fp", F.col("key").alias("key_b")), "fp").where("key_a < key_b").select("key_a", "key_b")
    x, y = m.select(F.col("fp").alias("a"), F.col("key").alias("ka")), m.select(F.col("fp").alias("b"), F.col("key").alias("kb"))
    two = links.join(x, "a").join(y, "b").where("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    return one.unionByName(two).distinct()


def assembly_key(columns: Sequence[str] = ("id", "path", "scaffold")) -> Column:
    """``id.path.scaffold``; NULL if a part is NULL."""
    return F.concat(*[p for c in columns for p in (F.lit("."), F.col(c).cast("string"))][1:])
