"""Alignment of proteins: the one place where built-in expressions can't do the work. Arrow batches, pairs deduplicated first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from organelia.session import ship

GAP_OPEN, GAP_EXTEND = 10, 4

# The lower triangle of the published BLOSUM80 matrix, one row an amino acid.
AMINO = "ARNDCQEGHILKMFPSTWYV"
BLOSUM80 = """
7
-3 9
-3 -1 9
-3 -3 2 10
-1 -6 -5 -7 13
-2 1 0 -1 -5 9
-2 -1 -1 2 -7 3 8
0 -4 -1 -3 -6 -4 -4 9
-3 0 1 -2 -7 1 0 -4 12
-3 -5 -6 -7 -2 -5 -6 -7 -6 7
-3 -4 -6 -7 -3 -4 -6 -7 -5 2 6
-1 3 0 -2 -6 2 1 -3 -1 -5 -4 8
-2 -3 -4 -6 -3 -1 -4 -5 -4 2 3 -3 9
-4 -5 -6 -6 -4 -5 -6 -6 -2 -1 0 -5 0 10
-1 -3 -4 -3 -6 -3 -2 -5 -4 -5 -5 -2 -4 -6 12
2 -2 1 -1 -2 -1 -1 -1 -2 -4 -4 -1 -3 -4 -2 7
0 -2 0 -2 -2 -1 -2 -3 -3 -2 -3 -1 -1 -4 -3 2 8
-5 -5 -7 -8 -5 -4 -6 -6 -4 -5 -4 -6 -3 0 -7 -6 -5 16
-4 -4 -4 -6 -5 -3 -5 -6 3 -3 -2 -4 -3 4 -6 -3 -3 3 11
-1 -4 -5 -6 -2 -4 -4 -6 -5 4 1 -4 1 -2 -4 -3 0 -5 -3 7
"""
#: Score of a letter that is no amino acid of the matrix.
UNKNOWN = -2


@cache
def scores() -> np.ndarray:
    """The matrix over byte values."""
    m = np.full((256, 256), UNKNOWN, np.int32)
    for i, line in enumerate(BLOSUM80.split("\n")[1:-1]):
        for j, v in enumerate(line.split()):
            m[ord(AMINO[i]), ord(AMINO[j])] = m[ord(AMINO[j]), ord(AMINO[i])] = int(v)
    return m


@dataclass(frozen=True)
class Alignment:
    score: int
    a: str
    b: str

    @property
    def matches(self) -> int:
        return sum(x == y != "-" for x, y in zip(self.a, self.b, strict=True))

    @property
    def leading(self) -> int:
        """Gaps before ``a`` less gaps before ``b``."""
        return _lead(self.a) - _lead(self.b)

    @property
    def trailing(self) -> int:
        return _lead(self.a[::-1]) - _lead(self.b[::-1])


def _lead(s: str) -> int:
    return len(s) - len(s.lstrip("-"))


def align(a: str, b: str) -> Alignment:
    """Global alignment with affine gaps (a gap of n costs open + n * extend), a row of the matrix at a time.

    Within a row, a gap in ``a`` is a running maximum of the row without such gaps, so rows need no inner
    loop. Of equal alignments a match is preferred to a gap.
    """
    x, y = np.frombuffer(a.encode("latin1", "replace"), np.uint8), np.frombuffer(b.encode("latin1", "replace"), np.uint8)
    n, m = x.size, y.size
    low = np.int32(-(1 << 29))
    steps = np.arange(m + 1, dtype=np.int32) * GAP_EXTEND
    best = np.empty((n + 1, m + 1), np.int32)
    down = np.full((n + 1, m + 1), low, np.int32)
    side = np.full((n + 1, m + 1), low, np.int32)
    best[0] = -GAP_OPEN - steps
    best[0, 0] = 0
    side[0] = best[0]
    table = scores()
    for i in range(1, n + 1):
        down[i] = np.maximum(best[i - 1] - GAP_OPEN, down[i - 1]) - GAP_EXTEND
        row = down[i].copy()
        row[1:] = np.maximum(row[1:], best[i - 1, :-1] + table[x[i - 1], y])
        reach = np.maximum.accumulate(row + steps)
        side[i, 1:] = reach[:-1] - steps[1:] - GAP_OPEN
        best[i] = np.maximum(row, side[i])
    out_a, out_b = [], []
    i, j, state = n, m, 0
    while i or j:
        if state == 0:
            if i and j and best[i, j] == best[i - 1, j - 1] + table[x[i - 1], y[j - 1]]:
                out_a.append(a[i - 1])
                out_b.append(b[j - 1])
                i, j = i - 1, j - 1
                continue
            state = 1 if i and best[i, j] == down[i, j] else 2
        if state == 1:
            out_a.append(a[i - 1])
            out_b.append("-")
            state = 0 if down[i, j] == best[i - 1, j] - GAP_OPEN - GAP_EXTEND else 1
            i -= 1
        else:
            out_a.append("-")
            out_b.append(b[j - 1])
            state = 0 if i == 0 and j == 1 or side[i, j] == best[i, j - 1] - GAP_OPEN - GAP_EXTEND and best[i, j - 1] != side[i, j - 1] else 2
            if i == 0:
                state = 2
            j -= 1
    return Alignment(int(best[n, m]), "".join(reversed(out_a)), "".join(reversed(out_b)))


def self_score(a: str) -> int:
    x = np.frombuffer(a.encode("latin1", "replace"), np.uint8)
    return int(scores()[x, x].sum())


def compare(query: str | None, target: str | None) -> tuple[float | None, float | None, int | None, int | None]:
    """(pctid, similarity, gap_leading, gap_trailing) of a target, seen from the query; NULL where a sequence is NULL or empty."""
    if not query or not target:
        return None, None, None, None
    r = align(query, target)
    own = self_score(query)
    return 100.0 * r.matches / len(query), (100.0 * r.score / own if own else None), r.leading, r.trailing


#: Cells of a matrix that are held at once, and pairs in one pass; queries that are bounded together.
CELLS, PAIRS, TOGETHER = 12_000_000, 256, 128


def _codes(texts: Sequence[str], size: int) -> np.ndarray:
    """Bytes of the texts, one text a column, padded with zeros."""
    flat = np.zeros((len(texts), size), np.uint8)
    for k, t in enumerate(texts):
        flat[k, : len(t)] = np.frombuffer(t.encode("latin1", "replace"), np.uint8)
    return np.ascontiguousarray(flat.T)


def _whole_type(n: int, m: int) -> tuple[type, int]:
    """The smallest whole-number type that holds every score of n by m letters, and a value below them."""
    return (np.int16, -16000) if 20 * n + 4 * m + 40 < 32000 and 4 * (n + m) + 40 < 16000 else (np.int32, -(1 << 29))


def _align_block(queries: Sequence[str], targets: Sequence[str]) -> np.ndarray:
    """(score, matches, leading, trailing) of each pair: the same recurrences and the same choices as ``align``, a pair a column."""
    n, m, size = np.array([len(q) for q in queries]), np.array([len(t) for t in targets]), len(queries)
    top, wide = int(n.max()), int(m.max())
    kind, low = _whole_type(top, wide)
    x, y = _codes(queries, top), _codes(targets, wide)
    table = scores().astype(kind).ravel()
    own = y.astype(np.int32)
    steps = (np.arange(wide + 1) * GAP_EXTEND).astype(kind)[:, None]
    best, down, side = (np.full((top + 1, wide + 1, size), low, kind) for _ in range(3))
    best[0] = -GAP_OPEN - steps
    best[0, 0] = 0
    side[0] = best[0]
    for i in range(1, top + 1):
        np.maximum(best[i - 1] - kind(GAP_OPEN), down[i - 1], out=down[i])
        down[i] -= kind(GAP_EXTEND)
        row = down[i].copy()
        np.maximum(row[1:], best[i - 1, :-1] + table.take(own + x[i - 1].astype(np.int32) * 256), out=row[1:])
        reach = np.maximum.accumulate(row + steps, axis=0)
        side[i, 1:] = reach[:-1] - steps[1:] - kind(GAP_OPEN)
        np.maximum(row, side[i], out=best[i])
    out = np.zeros((size, 4), np.int64)
    out[:, 0] = best[n, m, np.arange(size)]
    pair, i, j = np.arange(size), n.copy(), m.copy()
    state, last, run = (np.zeros(size, np.int64) for _ in range(3))
    last -= 1
    first = np.ones(size, bool)
    gap = GAP_OPEN + GAP_EXTEND
    while pair.size:
        here, both = best[i, j, pair], (i > 0) & (j > 0)
        xi, yj = x[i - 1, pair], y[j - 1, pair]
        met = (state == 0) & both & (here == best[i - 1, j - 1, pair] + table[xi.astype(np.int64) * 256 + yj])
        op = np.where(met, 0, np.where(state > 0, state, np.where((i > 0) & (here == down[i, j, pair]), 1, 2)))
        before = best[i, j - 1, pair].astype(np.int64)
        opened = ((i == 0) & (j == 1)) | ((side[i, j, pair] == before - gap) & (before != side[i, j - 1, pair]))
        state = np.where(op == 0, 0, np.where(op == 1, np.where(down[i, j, pair] == best[i - 1, j, pair].astype(np.int64) - gap, 0, 1), np.where(opened & (i > 0), 0, 2)))
        out[pair, 1] += met & (xi == yj)
        run = np.where(op == last, run + 1, 1)
        first &= (last < 0) | (op == last)
        signed = np.where(op == 2, run, np.where(op == 1, -run, 0))
        out[pair, 2] = signed
        out[pair[first], 3] = signed[first]
        last, i, j = op, i - (op != 2), j - (op != 1)
        left = (i > 0) | (j > 0)
        pair, i, j, state, last, run, first = (v[left] for v in (pair, i, j, state, last, run, first))
    return out


def compare_many(queries: Sequence[str | None], targets: Sequence[str | None]) -> list[tuple[float | None, float | None, int | None, int | None]]:
    """``compare`` of each pair. Pairs are aligned together by size; a text with a gap sign or letters beyond ASCII is aligned by itself."""
    out: list[tuple[float | None, float | None, int | None, int | None]] = [(None, None, None, None)] * len(queries)
    ready = []
    for k, (q, t) in enumerate(zip(queries, targets, strict=True)):
        if q and t:
            if (q + t).isascii() and "-" not in q and "-" not in t:
                ready.append(k)
            else:
                out[k] = compare(q, t)
    ready.sort(key=lambda k: (len(queries[k]), len(targets[k])))
    own = {q: self_score(q) for q in {queries[k] for k in ready}}
    at = 0
    while at < len(ready):
        end, wide = at, 0
        while end < len(ready) and end - at < PAIRS:
            wide = max(wide, len(targets[ready[end]]) + 1)
            if end > at and (len(queries[ready[end]]) + 1) * wide * (end - at + 1) > CELLS:
                break
            end += 1
        block, at = ready[at:end], end
        for k, (score, matches, lead, tail) in zip(block, _align_block([queries[k] for k in block], [targets[k] for k in block]).tolist(), strict=True):
            q = queries[k]
            out[k] = 100.0 * matches / len(q), (100.0 * score / own[q] if own[q] else None), lead, tail
    return out


@lru_cache(maxsize=1024)
def _profile(targets: tuple[str, ...]) -> np.ndarray:
    """The best score of each letter at each position of targets of one length."""
    return np.stack([scores()[:, np.unique(column)].max(axis=1) for column in _codes(targets, len(targets[0]))], axis=1)


def _profile_scores(queries: Sequence[str], targets: Sequence[str], need: np.ndarray | None = None) -> np.ndarray:
    """For each query, a score that no alignment with any of the targets (all of one length) exceeds.

    The query is aligned to the column-wise best letter of the targets; with one target this is its score.
    A query that can no longer reach the score it needs is left, and has the least whole number.
    """
    n, m = np.array([len(q) for q in queries]), len(targets[0])
    top = int(n.max())
    kind, low = _whole_type(top, m)
    x = _codes(queries, top)
    # What each letter can score at each position, and what the letters of a query after each of its own can score at most.
    table = _profile(tuple(targets)).astype(kind)
    if need is not None:
        ends_at = np.arange(top)[:, None] < n
        gain = np.where(ends_at, np.maximum(table.max(axis=1), 0).astype(np.int64)[x], 0)
        rest = gain.sum(axis=0) - np.cumsum(gain, axis=0)
    steps = (np.arange(m + 1) * GAP_EXTEND).astype(kind)
    after = steps[1:] + kind(GAP_OPEN)
    best = np.empty((len(queries), m + 1), kind)
    best[:] = -GAP_OPEN - steps
    best[:, 0] = 0
    down, row, reach = np.full_like(best, low), np.empty_like(best), np.empty_like(best)
    out = np.full(len(queries), np.iinfo(np.int64).min, np.int64)
    at = np.arange(len(queries))
    for i in range(1, top + 1):
        np.subtract(best, kind(GAP_OPEN), out=row)
        np.maximum(down, row, out=down)
        down -= kind(GAP_EXTEND)
        met = table.take(x[i - 1, at], axis=0)
        met += best[:, :-1]
        row[:, 0] = down[:, 0]
        np.maximum(down[:, 1:], met, out=row[:, 1:])
        np.add(row, steps, out=reach)
        np.maximum.accumulate(reach, axis=1, out=reach)
        np.subtract(reach[:, :-1], after, out=met)
        np.maximum(row[:, 1:], met, out=row[:, 1:])
        best, row = row, best
        ends = n[at] == i
        if ends.any():
            out[at[ends]] = best[ends, m]
        if i % 16 == 0:
            on = n[at] > i
            if need is not None:
                on &= best.max(axis=1) + rest[i - 1, at] >= need[at]
            if not on.all():
                at, best, down = at[on], best[on], down[on]
                row, reach = np.empty_like(best), np.empty_like(best)
                if not at.size:
                    break
    return out


def may_reach(queries: Sequence[str], targets: Sequence[str], threshold: float) -> list[bool]:
    """Whether a target may have ``threshold`` similarity to each query. False is certain: it is said only by an upper bound of the score.

    Targets of one length are bounded together, then by halves, down to one target, whose bound is its
    score. A query without letters of positive score is not judged (True), nor is one beyond ASCII.
    """
    answer = [False] * len(queries)
    need, judged = {}, []
    for k, q in enumerate(queries):
        own = self_score(q) if q else 0
        if not q:
            continue
        if own <= 0 or not q.isascii():
            answer[k] = True
        else:
            need[k] = threshold * own / 100.0
            judged.append(k)
    groups: dict[int, list[str]] = {}
    for t in targets:
        if t:
            groups.setdefault(len(t), []).append(t)
    judged.sort(key=lambda k: len(queries[k]))
    for start in range(0, len(judged), TOGETHER):
        todo = [(sorted(g), judged[start : start + TOGETHER]) for g in groups.values()]
        while todo:
            some, ks = todo.pop()
            ks = [k for k in ks if not answer[k]]
            if not ks:
                continue
            bound = _profile_scores([queries[k] for k in ks], some, np.array([need[k] - 1e-6 for k in ks]))
            ks = [k for k, b in zip(ks, bound, strict=True) if b >= need[k] - 1e-6]
            if len(some) == 1:
                for k in ks:
                    answer[k] = True
            elif ks:
                half = len(some) // 2
                todo += [(some[:half], ks), (some[half:], ks)]
    return answer


COMPARED = T.StructType([T.StructField("pctid", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("gap_leading", T.IntegerType()),
    T.StructField("gap_trailing", T.IntegerType())])


@F.pandas_udf(COMPARED)
def compared(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    """``compare`` as a column over pairs."""
    rows = compare_many(query.tolist(), target.tolist())
    out = pd.DataFrame(rows, columns=["pctid", "similarity", "gap_leading", "gap_trailing"])
    return out.astype({"pctid": "float64", "similarity": "float64", "gap_leading": "Int32", "gap_trailing": "Int32"})


def score_pairs(pairs: DataFrame, query: str = "query", target: str = "target") -> DataFrame:
    """Pairs with their scores; each distinct pair of texts is aligned once and found again by its hash. A NULL text has NULL scores."""
    ship(pairs.sparkSession)
    text = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    named = pairs.withColumn("_pair", F.md5(F.concat(text(query), F.lit("\n"), text(target))))
    distinct = named.groupBy("_pair").agg(F.first(query).alias("_q"), F.first(target).alias("_t")).select("_pair", compared("_q", "_t").alias("_r"))
    return named.join(distinct, "_pair").select(*pairs.columns, "_r.*")


def multiple_alignment(seqs: Sequence[str], copies: Sequence[int] | None = None) -> list[str]:
    """Centre-star alignment: all sequences are aligned to the one that is nearest to all, each counted with its copies; gaps once made are kept."""
    seqs = list(seqs)
    copies = [1] * len(seqs) if copies is None else list(copies)
    if len(seqs) < 2:
        return seqs
    pair = {(i, j): align(seqs[i], seqs[j]) for i in range(len(seqs)) for j in range(i + 1, len(seqs))}
    total = [sum(pair[min(i, j), max(i, j)].score * copies[j] for j in range(len(seqs)) if j != i) for i in range(len(seqs))]
    c = total.index(max(total))
    centre = seqs[c]
    rows = {c: centre}
    frame = centre
    for i, s in enumerate(seqs):
        if i == c:
            continue
        r = align(centre, s)
        # Walk the frame (the centre with all gaps so far) and the new pair side by side.
        new_frame: list[str] = []
        added: list[str] = []
        opened: list[int] = []
        p = q = 0
        while p < len(frame) or q < len(r.a):
            old_gap = p < len(frame) and frame[p] == "-"
            new_gap = q < len(r.a) and r.a[q] == "-"
            if new_gap and not old_gap:
                opened.append(len(new_frame))
                new_frame.append("-")
                added.append(r.b[q])
                q += 1
            elif old_gap and not new_gap:
                new_frame.append("-")
                added.append("-")
                p += 1
            else:
                new_frame.append(frame[p])
                added.append(r.b[q])
                p, q = p + 1, q + 1
        for k, row in rows.items():
            cells = list(row)
            for at in opened:
                cells.insert(at, "-")
            rows[k] = "".join(cells)
        frame = "".join(new_frame)
        rows[i] = "".join(added)
    return [rows[i] for i in range(len(seqs))]


def distances(aligned: Sequence[str]) -> np.ndarray:
    """Share of differing columns of each pair, over columns in which not both have a gap."""
    m = np.array([list(s) for s in aligned]) if aligned and aligned[0] else np.empty((len(aligned), 0), "<U1")
    n = len(aligned)
    d = np.zeros((n, n))
    for i in range(n):
        both = (m[i] != "-") | (m != "-")
        d[i] = np.where(both.sum(1) > 0, ((m[i] != m) & both).sum(1) / np.maximum(both.sum(1), 1), 0.0)
    return d


def cluster_order(d: np.ndarray) -> list[int]:
    """Leaf order of complete-linkage clustering; of equal distances the earlier pair is joined."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        _, i, j = min((max(d[a, b] for a in x for b in y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[i] = groups[i] + groups.pop(j)
    return groups[0] if groups else []


def alignment_report(df: DataFrame, group: str, name: str, sequence: str, most: int = 500) -> DataFrame:
    """(group, name, ord, aligned, mean_distance): the alignment of each group in cluster order.

    Each distinct sequence of a group is aligned once, weighed with its copies, which share its place ``ord`` and its
    row; ``mean_distance`` is that to all other rows of the group. All pairs of distinct sequences of a group are aligned, so a group
    is for one gene of an export; one with over ``most`` distinct sequences is refused rather than cut. NULL and empty
    sequences are left out; a NULL group is a group, repeated rows are copies.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most:
            raise ValueError(f"a group of {len(frame)} different sequences is too large to align; the limit is {most}")
        frame = frame.sort_values("seq")
        copies = frame["copies"].to_numpy()
        aligned = multiple_alignment(frame["seq"].tolist(), copies.tolist())
        d = distances(aligned)
        order = cluster_order(d)
        mean = d @ copies / max(int(copies.sum()) - 1, 1)
        return pd.DataFrame({"grp": frame["grp"].iloc[0], "id": [frame["id"].iloc[i] for i in order], "ord": range(1, len(order) + 1), "aligned": [aligned[i] for i in order], "mean_distance": [float(mean[i]) for i in order]})

    ship(df.sparkSession)
    kept = df.where(F.col(sequence).isNotNull() & (F.col(sequence) != "")).select(F.col(group).cast("string").alias("grp"), F.col(name).alias("name"), F.col(sequence).alias("seq"), F.md5(sequence).alias("id"))
    # Copies are counted before they meet; a task holds the distinct sequences of a group.
    distinct = kept.groupBy("grp", "id").agg(F.min("seq").alias("seq"), F.count("*").alias("copies"))
    # The groups are few rows and much work, so they are spread by number, not brought together by size.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.repartition(4 * parts, "grp").groupBy("grp").applyInPandas(run, "grp string, id string, ord int, aligned string, mean_distance double")
    both = kept.alias("k").join(rows.alias("r"), F.col("k.grp").eqNullSafe(F.col("r.grp")) & (F.col("k.id") == F.col("r.id")))
    return both.select(F.col("k.grp").alias("group"), "name", "ord", "aligned", "mean_distance")
