"""Per-base coverage: densify, fold circular contigs, rolling statistics and masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from organelia.functions.text import masked
from organelia.operators.windows import full_window_fraction, outlier_mask, rolling_any, rolling_mean


def fold_circular(counts: DataFrame, contigs: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Positions beyond the end of a circular contig (contigs: keys, topology, length) counted at its start."""
    over = (F.col("topology") == "circular") & (F.col("position") > F.col("length"))
    d = counts.join(contigs.select(*keys, "topology", "length"), list(keys)).withColumn("_from", F.col("position")).withColumn("position", F.when(over,
        F.col("position") - F.col("length")).otherwise(F.col("position")))
    return (
        d.groupBy(*keys, "position")
        .agg(F.min_by("call", "_from").alias("call"), F.sum("depth").alias("depth"), F.sum("correct").alias("correct"))
        .withColumn("error_rate", F.try_divide(F.col("depth") - F.col("correct"), F.col("depth")))
    )


def fill_gaps(counts: DataFrame, contigs: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """A row for every base of each contig (keys, sequence): missing ones have depth 0, the reference base and no error rate.

    Both sides of the join have a row a base, so it is a merge join: neither is ever brought to the driver.
    """
    spine = contigs.select(*keys, F.posexplode(F.filter(F.split("sequence", ""), lambda b: b != "")).alias("_p", "_base")).withColumn("position",
        (F.col("_p") + 1).cast("long"))
    d = spine.join(counts.hint("merge"), [*keys, "position"], "left")
    zero = F.lit(0.0)
    return d.select(*keys, "position", F.coalesce("call", "_base").alias("call"), F.coalesce("depth", zero).alias("depth"), F.coalesce("correct",
        F.when(F.col("depth").isNull(), zero)).alias("correct"), "error_rate")


def statistics(counts: DataFrame, keys: Sequence[str] = ("seq_id",), width: int = 5, gc_width: int = 200) -> DataFrame:
    """Rolling depth, error and GC with their masks; the error mask looks at the smoothed error."""
    d = outlier_mask(counts, "depth", keys, 8.0, "mean_depth_mask")
    d = d.withColumns({"mean_depth": rolling_mean(F.col("depth"), keys, "position", width), "error_rate": rolling_mean(F.col("error_rate"), keys, "position", width),
        "gc": F.bround(full_window_fraction(F.upper("call").isin("G", "C"), keys, "position", gc_width), 2)})
    return d.withColumn("error_rate_mask", rolling_any(F.col("error_rate") > 0.05, keys, "position", width))


def long_form(stats: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """One row per position and statistic with its mask, for plotting; NULL values are left out."""
    cells = F.array(
        F.struct(F.lit("MeanDepth").alias("stat"), F.col("mean_depth").alias("val"), F.col("mean_depth_mask").alias("mask")),
        F.struct(F.lit("ErrorRate").alias("stat"), F.col("error_rate").alias("val"), F.col("error_rate_mask").alias("mask")),
        F.struct(F.lit("GC").alias("stat"), F.col("gc").alias("val"), F.lit(False).alias("mask")),
    )
    return stats.select(*keys, "position", F.inline(cells)).where("val is not null")


def encoded(stats: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Statistics in their file form: a masked value has ``#`` in front."""
    return stats.select(*keys, "position", "call", "depth", "correct", masked(F.col("error_rate"), F.col("error_rate_mask")).alias("error_rate"),
        masked(F.col("mean_depth"), F.col("mean_depth_mask")).alias("mean_depth"), "gc")


def pack_track(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """A per-base value as one text per contig, in order of position; NULL is written as NA."""
    item = F.struct("position", F.coalesce(F.col(value).cast("string"), F.lit("NA")).alias("v"))
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]), " ").alias(out))


def unpack_track(df: DataFrame, keys: Sequence[str], track: str, out: str) -> DataFrame:
    """A packed track as one row per base; what is no number is NULL."""
    return df.where(F.col(track).isNotNull()).select(*keys, F.posexplode(F.split(F.trim(track), r"\s+")).alias("_p", "_v")).select(*keys,
        (F.col("_p") + 1).cast("long").alias("position"), F.col("_v").try_cast("double").alias(out))
