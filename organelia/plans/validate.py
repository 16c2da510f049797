"""Warnings of gene calls against rules, and the summary of a sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from organelia.operators.intervals import overlap_join, overlap_length, point_join, worst_overlaps

#: Positions per bucket of the range joins. Gene calls are some hundred positions long.
BUCKET = 4096


def count_range(count: Any) -> tuple[int, int]:
    """Least and greatest number of calls that a rule's count allows: a number, or a list of the numbers that are right; without one, 1."""
    counts = [int(c) for c in (count if isinstance(count, (list, tuple)) else [count]) if c is not None]
    return (min(counts), max(counts)) if counts else (1, 1)


def _listed(rules: Sequence[Mapping[str, Any]]) -> Column:
    """The genes of the rules with the calls they allow, as an array in the plan: a parameter set has a few dozen."""
    rows = [(i, r["gene"], *count_range(r["count"])) for i, r in enumerate(rules)]
    return F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(g).alias("gene"), F.lit(a).cast("long").alias("least"), F.lit(b).cast("long").alias("most")) for i, g, a,
        b in rows])


def count_findings(calls: DataFrame, samples: DataFrame, rules: Sequence[Mapping[str, Any]], sample: Sequence[str]) -> DataFrame:
    """(sample, gene, rank, n_calls, missing, extra) for every gene of the rules: fewer calls than one needs, or more than the rules allow. ``rank`` is the rule's place."""
    n = calls.groupBy(*sample, "gene").agg(F.count("*").alias("n_calls"))
    expected = samples.select(*sample).distinct().select(*sample, F.inline(_listed(rules)))
    zero = F.lit(0).cast("long")
    d = expected.join(n, [*sample, "gene"], "left").withColumn("n_calls", F.coalesce("n_calls", zero))
    # A gene that is missing is not counted as extra too.
    missing = F.col("n_calls") < F.col("least")
    return d.select(*sample, "gene", "rank", "n_calls", missing.alias("missing"), F.when(missing,
        zero).otherwise(F.greatest(F.col("n_calls") - F.col("most"), zero)).alias("extra"))


def with_duplicates(calls: DataFrame, every: DataFrame, rules: Sequence[Mapping[str, Any]], sample: Sequence[str]) -> DataFrame:
    """Calls with ``duplicate``: whether ``every`` call of their sample has more of the gene than the rules allow."""
    n = every.groupBy(*sample, "gene").agg(F.count("*").alias("_n"))
    most = F.try_element_at(F.create_map(*[x for r in rules for x in (F.lit(r["gene"]), F.lit(count_range(r["count"])[1]))]), F.col("gene"))
    several = n.withColumn("_most", most).where("_n > _most").select(*sample, "gene", F.lit(True).alias("duplicate"))
    return calls.join(several, [*sample, "gene"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def with_ends(calls: DataFrame, sample: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Calls with ``is_first`` and ``is_last`` of their sample in the given order; the ends are a minimum and a maximum, combined before the shuffle."""
    at = F.struct(*order)
    ends = calls.groupBy(*sample).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    return calls.join(ends, list(sample)).withColumns({"is_first": at == F.col("_first"), "is_last": at == F.col("_last")}).drop("_first", "_last")


def segments(calls: DataFrame, contig_length: str) -> DataFrame:
    """Calls as (start, end) pieces; one over the origin gives two. A call over the origin of a contig of unknown length ends at its own pos1."""
    wraps = F.col("pos1") > F.col("pos2")
    piece = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    parts = F.when(wraps, F.array(piece(F.col("pos1"), F.greatest(F.coalesce(contig_length, "pos1"), F.col("pos1"))), piece(F.lit(1),
        F.col("pos2")))).otherwise(F.array(piece(F.col("pos1"), F.col("pos2"))))
    return calls.select("*", F.inline(parts))


def overlaps(pieces: DataFrame, keys: Sequence[str], call: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """(keys, call, r_call, overlap): positions shared by two calls of one contig and strand, summed over their pieces."""
    side = pieces.select(*keys, *call, "start", "end")
    j = overlap_join(side, side, keys, bucket)
    same = F.lit(True)
    for c in call:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    shared = overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    return j.where(~same).groupBy(*keys, *call, *[f"r_{c}" for c in call]).agg(F.sum(shared).alias("overlap"))


def call_warnings(calls: DataFrame, worst: DataFrame, rules: DataFrame, keys: Sequence[str], call: Sequence[str], max_overlap: float, hit_threshold: float, own: DataFrame | None = None, own_by: Sequence[str] = ()) -> DataFrame:
    """Calls with ``warnings``: an array of what the rules say, in a fixed order.

    ``calls`` has length, type, start_codon, stop_codon, translation and hits (array of similarity,
    gap_leading, gap_trailing; NULL is none), and may have duplicate (``with_duplicates``), low_coverage and
    high_error (``weak_regions``), and is_first and is_last (``with_ends``): the end of the first and of the last call of a sample that lies
    outward may overlap. ``worst`` are their ``worst_overlaps``. Calls of a gene without rules are only checked for overlap.
    ``own`` are rules of ``own_by`` (a sample) and gene, that go before ``rules`` wherever they say something.
    """
    on = [*keys, *call]
    plus = F.col("direction") == "+"
    r = F.broadcast(rules.drop("type", "count").withColumnRenamed("gene", "_gene"))
    d = calls.join(worst, on, "left").join(r, F.col("gene") == F.col("_gene"), "left").drop("_gene")
    if own is not None:
        says = ("max_len", "min_len", "overlap_start", "overlap_stop", "start_codons", "stop_codons")
        o = own.select(*own_by, "gene", *[F.col(c).alias(f"_own_{c}") for c in says])
        d = d.join(o, [*own_by, "gene"], "left").withColumns({c: F.coalesce(f"_own_{c}", c) for c in says}).drop(*[f"_own_{c}" for c in says])
    over = F.coalesce(F.col("any_overlap") / F.col("length") > max_overlap, F.lit(False))
    pcg = F.col("type") == "PCG"
    no_hit = lambda test: pcg & ~F.coalesce(F.exists("hits", test), F.lit(False))
    has = lambda c: F.col(c) if c in calls.columns else F.lit(False)
    free_start = F.when(plus, has("is_first")).otherwise(has("is_last"))
    free_stop = F.when(plus, has("is_last")).otherwise(has("is_first"))
    # The texts of the warnings.
    checks = [
        (has("duplicate"), "possible duplicate"),
        (over, "exceeds max overlap"),
        (~over & ~free_start & (F.col("start_overlap") > F.col("overlap_start")), "exceeds max start overlap"),
        (~over & ~free_stop & (F.col("stop_overlap") > 1) & ~F.col("overlap_stop"), "exceeds max stop overlap"),
        (F.col("length") > F.col("max_len"), "exceeds max length"),
        (F.col("length") < F.col("min_len"), "below min length"),
        (has("low_coverage"), "low coverage region"),
        (has("high_error"), "high error region"),
        (pcg & F.contains("translation", F.lit("*")), "internal stop codon"),
        (pcg & ~F.array_contains("stop_codons", F.col("stop_codon")), "non-standard stop codon"),
        (pcg & ~F.array_contains("start_codons", F.col("start_codon")), "non-standard start codon"),
        (no_hit(lambda h: h["similarity"] >= hit_threshold), "low reference similarity"),
        (no_hit(lambda h: h["gap_leading"] == 0), "check reference start alignment"),
        (no_hit(lambda h: h["gap_trailing"] == 0), "check reference stop alignment"),
    ]
    # A comparison with NULL warns of nothing.
    return d.withColumn("warnings", F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), w) for c, w in checks]), lambda x: x.isNotNull()))


def worst_of(found: DataFrame, keys: Sequence[str], call: Sequence[str]) -> DataFrame:
    """(keys, call, any_overlap, start_overlap, stop_overlap) from all ``overlaps``: the greatest, and those with a call that holds the call's own start or stop. pos1 and pos2 must be among ``call``."""
    inside = lambda p: (F.col(p) >= F.col("r_pos1")) & (F.col(p) <= F.col("r_pos2"))
    plus = F.col("direction") == "+"
    at_start = F.when(plus, inside("pos1")).otherwise(inside("pos2"))
    at_stop = F.when(plus, inside("pos2")).otherwise(inside("pos1"))
    return found.groupBy(*keys, *call).agg(F.max("overlap").alias("any_overlap"), F.max(F.when(at_start, F.col("overlap"))).alias("start_overlap"),
        F.max(F.when(at_stop, F.col("overlap"))).alias("stop_overlap"))


def worst_overlaps_of(calls: DataFrame, keys: Sequence[str], call: Sequence[str], contig_length: str, bucket: int = BUCKET) -> DataFrame:
    """As ``worst_of`` over all ``overlaps``, without making them: calls that do not run over the origin are not paired.

    ``calls`` are distinct and are read four times. A pair of which one call runs over the origin is made, for its two pieces add up; such calls are few.
    """
    own = [*keys, *call]
    plus = F.col("direction") == "+"
    plain = calls.where("pos1 <= pos2").select(*own)
    spans = worst_overlaps(plain, keys, "pos1", "pos2")
    direct = plain.join(spans, [*keys, "pos1", "pos2"]).select(
        *own,
        "any_overlap",
        F.when(plus, F.col("left_overlap")).otherwise(F.col("right_overlap")).alias("start_overlap"),
        F.when(plus, F.col("right_overlap")).otherwise(F.col("left_overlap")).alias("stop_overlap"),
    )
    pieces = segments(calls.select(*own, contig_length), contig_length).drop(contig_length)
    j = overlap_join(pieces.where("pos1 > pos2"), pieces, keys, bucket)
    same = F.lit(True)
    for c in call:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    other = [f"r_{c}" for c in call]
    pairs = j.where(~same).groupBy(*own, *other).agg(F.sum(overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("overlap"))
    # Seen from the other call too, unless it runs over the origin itself and so has the pair on its own side.
    back = pairs.where("r_pos1 <= r_pos2").select(*keys, *[F.col(f"r_{c}").alias(c) for c in call], *[F.col(c).alias(f"r_{c}") for c in call], "overlap")
    around = worst_of(pairs.unionByName(back), keys, call)
    return direct.unionByName(around).groupBy(*own).agg(*[F.max(c).alias(c) for c in ("any_overlap", "start_overlap", "stop_overlap")])


def weak_regions(track: DataFrame, pieces: DataFrame, keys: Sequence[str], call: Sequence[str], share: float = 0.05, bucket: int = BUCKET) -> DataFrame:
    """(keys, call, n_bases, low_coverage, high_error): calls with over ``share`` of their bases at depth 10 or less, or at an error of 0.05 or more. NULL counts as neither."""
    j = point_join(track, pieces.select(*keys, *call, "start", "end"), keys, "position", bucket)
    part = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")) / F.count("*") > share
    return j.groupBy(*keys, *call).agg(F.count("*").alias("n_bases"), part(F.col("depth") <= 10).alias("low_coverage"),
        part(F.col("error_rate") >= 0.05).alias("high_error"))


def sample_summary(calls: DataFrame, sample: Sequence[str], contig: Sequence[str], order: Sequence[str], findings: DataFrame | None = None) -> DataFrame:
    """Per sample: contigs, genes in order joined by ``|``, calls by type and warned calls (NULL or an empty array is none).

    With ``findings`` (``count_findings``) also the missing genes in the order of the rules, joined by ``; `` (NULL
    if none is missing), and the number of calls more than allowed.

    The genes of a sample are its result and stand in one text, so they meet in one task.
    """
    genes = F.transform(F.array_sort(F.collect_list(F.struct(*order, "gene"))), lambda x: x["gene"])
    summary = calls.groupBy(*sample).agg(
        F.count_distinct(F.struct(*contig)).alias("scaffolds"),
        F.array_join(genes, "|").alias("structure"),
        *[F.count_if(F.col("type") == t).alias(n) for t, n in (("PCG", "pcg_count"), ("tRNA", "trna_count"), ("rRNA", "rrna_count"))],
        F.count_if(F.coalesce(F.size("warnings"), F.lit(0)) > 0).alias("warned"),
    )
    if findings is None:
        return summary
    # A sample has a row for each rule here, a few dozen.
    lost = F.transform(F.array_sort(F.collect_list(F.when(F.col("missing"), F.struct("rank", "gene")))), lambda x: x["gene"])
    counted = findings.groupBy(*sample).agg(F.nullif(F.array_join(lost, "; "), F.lit("")).alias("missing"), F.sum("extra").alias("extra"))
    return summary.join(counted, list(sample), "left")


def cut_guard(calls: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cut, n_split): calls that a cut before position ``cut`` would split."""
    d = cuts.join(calls, list(keys), "left").withColumn("split", (F.col("pos1") < F.col("cut")) & (F.col("pos2") >= F.col("cut")))
    return d.groupBy(*keys, "cut").agg(F.count_if("split").alias("n_split"))


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
