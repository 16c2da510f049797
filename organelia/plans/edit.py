"""Edits of an assembly: the common region of alternative paths, linearizing, moving a start, deleting a call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from organelia.functions.align import score_pairs
from organelia.functions.seq import codons, reverse_complement
from organelia.functions.text import hit_json
from organelia.operators.dml import update_rows
from organelia.operators.windows import islands, longest_run, top_per_group
from organelia.plans.annotate import rotated_calls
from organelia.plans.validate import cut_guard


def agreement(aligned: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """(keys, position, agree): per column of an alignment whether all its rows hold the same base; a gap agrees with nothing."""
    cells = aligned.select(*keys, F.posexplode(F.filter(F.split(sequence, ""), lambda b: b != "")).alias("_p", "b"))
    return cells.groupBy(*keys, (F.col("_p") + 1).cast("long").alias("position")).agg(((F.min("b") == F.max("b")) & (F.min("b") != "-")).alias("agree"))


def common_region(aligned: DataFrame, keys: Sequence[str], sequence: str, circular: Column | None = None, first: bool = False) -> DataFrame:
    """(keys, run_start, run_end, run_length): the longest run of columns in which all rows agree.

    Where ``circular`` holds, a run at the end goes on in one at the start: run_end is then beyond the last
    column. ``first`` takes the first run instead of the longest.
    """
    columns = agreement(aligned, keys, sequence)
    size = columns.groupBy(*keys).agg(F.max("position").alias("_n"))
    runs = islands(columns, keys, "position", F.col("agree"))
    if circular is not None:
        head = runs.where("run_start = 1").select(*keys, F.col("run_length").alias("_head"))
        r = runs.join(size, list(keys)).join(head, list(keys), "left").withColumn("_on",
            circular & (F.col("run_end") == F.col("_n")) & (F.col("run_start") > 1) & F.col("_head").isNotNull())
        runs = r.withColumns({"run_end": F.when(F.col("_on"), F.col("run_end") + F.col("_head")).otherwise(F.col("run_end")), "run_length": F.when(F.col("_on"),
            F.col("run_length") + F.col("_head")).otherwise(F.col("run_length"))}).drop("_n", "_head", "_on")
    return longest_run(runs, keys, first)


def linearized(calls: DataFrame, cuts: DataFrame, keys: Sequence[str], length: str) -> tuple[DataFrame, DataFrame]:
    """Calls of circular contigs opened before ``cut``, and the cuts that would split a call and are refused."""
    checked = cut_guard(calls, cuts, keys)
    good = checked.where("n_split = 0").select(*keys, F.col("cut").alias("cut1"), F.lit(None).cast("long").alias("cut2"), F.lit("+").alias("cut_strand"))
    return rotated_calls(calls, good, keys, length), checked.where("n_split > 0")


def deleted_calls(calls: DataFrame, chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calls with the chosen ones marked as deleted: both positions and the length are 0."""
    zero = F.lit(0).cast("long")
    return update_rows(calls, chosen.select(*by).distinct().withColumns({"pos2": zero, "length": zero, "_gone": F.lit(True)}), by).withColumn("pos1",
        F.when((F.col("pos2") == 0) & (F.col("length") == 0), zero).otherwise(F.col("pos1")))


def with_start(calls: DataFrame, codons: Column) -> DataFrame:
    """Calls whose start is moved by whole codons: below 0 upstream, above 0 downstream; NULL and 0 move nothing."""
    step = F.coalesce(codons, F.lit(0)) * 3
    plus = F.col("direction") == "+"
    return calls.withColumns({"pos1": F.when(plus, F.col("pos1") + step).otherwise(F.col("pos1")), "pos2": F.when(plus,
        F.col("pos2")).otherwise(F.col("pos2") - step)}).withColumn("length", F.abs(F.col("pos2") - F.col("pos1")) + 1)


def next_stop(sequence: str, stops: Sequence[str], reach: int) -> tuple[Column, Column, Column, Column]:
    """Columns (inward, its stop, outward, its stop): codons from a call's stop codon to the nearest codons that begin with a valid stop.

    The longest stop that fits counts, so a partial stop is used only where no whole one does. Positions are
    on the call's own strand; NULL where there is none within ``reach`` codons.
    """
    seq, size = F.col(sequence), F.length(sequence)
    back = F.col("direction") == "-"
    own = F.when(back, reverse_complement(seq)).otherwise(seq)
    last = F.when(back, size - F.col("pos1") + 1).otherwise(F.col("pos2")).cast("int")
    codon_at = last - F.length("stop_codon") + 1
    order = sorted(stops, key=len, reverse=True)

    def fit(c: Column) -> Column:
        return F.coalesce(*[F.when(F.startswith(c, F.lit(s)), F.lit(s)) for s in order])

    def nearest(cells: Column) -> tuple[Column, Column]:
        found = F.transform(cells, lambda c, i: F.struct((i + 1).alias("n"), fit(c).alias("s")))
        first = F.get(F.filter(found, lambda x: x["s"].isNotNull()), F.lit(0))
        return first["n"], first["s"]

    room = F.least(F.lit(reach), F.floor((codon_at - 1) / 3)).cast("int")
    inward = F.reverse(codons(F.substr(own, codon_at - 3 * room, 3 * room)))
    outward = codons(F.substr(own, codon_at + 3, F.lit(3 * reach)))
    return (*nearest(inward), *nearest(outward))


def with_stop(calls: DataFrame, steps: Column, stop: Column) -> DataFrame:
    """Calls whose stop codon is moved by whole codons (below 0 inward) and becomes ``stop``; NULL moves nothing."""
    move = F.coalesce(steps * 3 + F.length(stop) - F.length("stop_codon"), F.lit(0))
    plus = F.col("direction") == "+"
    return calls.withColumns({"pos1": F.when(plus, F.col("pos1")).otherwise(F.col("pos1") - move), "pos2": F.when(plus, F.col("pos2") + move).otherwise(F.col("pos2")),
        "stop_codon": F.when(steps.isNotNull(), stop).otherwise(F.col("stop_codon"))}).withColumn("length", F.abs(F.col("pos2") - F.col("pos1")) + 1)


def cut_to(contigs: DataFrame, regions: DataFrame, keys: Sequence[str], first: str, last: str, tracks: Sequence[str] = (), only: Column | None = None) -> DataFrame:
    """Contigs and their packed tracks cut to the bases ``first`` to ``last`` of their region; ``last`` beyond the end goes on at the start.

    Contigs without a region, and those for which ``only`` does not hold, stay whole; a region without bases leaves none.
    """
    d = contigs.join(regions.select(*keys, F.col(first).alias("_first"), F.col(last).alias("_last")), list(keys), "left")
    on = F.col("_first").isNotNull() & (F.lit(True) if only is None else F.coalesce(only, F.lit(False)))
    size, n = F.length("sequence"), F.greatest(F.col("_last") - F.col("_first") + 1, F.lit(0)).cast("int")
    start = F.col("_first").cast("int")
    out = {"sequence": F.when(on, F.when(F.col("_last") > size,
        F.concat(F.substr("sequence", start), F.substr("sequence", F.lit(1), (F.col("_last") - size).cast("int")))).otherwise(F.substr("sequence", start,
        n))).otherwise(F.col("sequence"))}
    for t in tracks:
        values = F.split(F.trim(F.col(t)), r"\s+")
        more = F.when(F.col("_last") > size, F.slice(values, 1, (F.col("_last") - size).cast("int"))).otherwise(F.array().cast("array<string>"))
        out[t] = F.when(on, F.array_join(F.concat(F.slice(values, start, n), more), " ")).otherwise(F.col(t))
    return d.withColumns(out).drop("_first", "_last")


def rescored(calls: DataFrame, references: DataFrame, most: int) -> DataFrame:
    """Calls with ``hits``: their proteins as they are after an edit against the references (gene, acc, target) of their gene.

    Each distinct protein is aligned once with each reference; the ``most`` most similar are kept, as column-oriented JSON.
    """
    pairs = calls.where("translation is not null").select("gene", F.col("translation").alias("query")).distinct().join(references.select("gene", "acc",
        "target").distinct(), "gene")
    top = top_per_group(score_pairs(pairs).where("similarity is not null"), ["gene", "query"], [F.desc("similarity"), F.col("acc"), F.col("target")], most)
    rows = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("similarity", "acc", "pctid", "gap_leading", "gap_trailing")))), lambda x: x)
    hits = top.groupBy("gene", "query").agg(hit_json(rows, ["acc", "pctid", "similarity", "gap_leading", "gap_trailing"]).alias("hits"))
    return calls.join(hits.withColumnRenamed("query", "translation"), ["gene", "translation"], "left")
