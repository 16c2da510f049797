"""Ordered analytics along a position axis.

Windows over the rows of a contig that are one a position hold at most as many rows as the contig is long. What
orders gene calls, of which a contig may have any number, is split by position: a window within a position, and one
over a summary row a position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centred(keys: Sequence[str], order: str, before: int, after: int) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)


def rolling_mean(value: Column, keys: Sequence[str], order: str, width: int = 5, digits: int = 2) -> Column:
    """Mean over a centred window that is shorter at the ends, rounded half to even."""
    half = width // 2
    return F.bround(F.avg(value).over(centred(keys, order, half, width - 1 - half)), digits)


def rolling_any(condition: Column, keys: Sequence[str], order: str, width: int = 5) -> Column:
    """True if the condition holds anywhere in the centred window; NULL counts as false."""
    half = width // 2
    return F.max(F.coalesce(condition, F.lit(False))).over(centred(keys, order, half, width - 1 - half))


def full_window_fraction(condition: Column, keys: Sequence[str], order: str, width: int) -> Column:
    """Share of rows of a centred window for which the condition holds; NULL where the window is not full."""
    w = centred(keys, order, (width - 1) // 2, width // 2)
    return F.when(F.count(F.lit(1)).over(w) == width, F.sum(condition.cast("int")).over(w) / width)


def outlier_mask(df: DataFrame, value: str, keys: Sequence[str], factor: float = 8.0, out: str = "mask") -> DataFrame:
    """Rows further from the group's median than ``factor`` times its median absolute deviation.

    Two aggregations that are joined back, so no group is held in a window. NULL values are not masked.
    """
    med = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    with_med = df.join(med, list(keys))
    mad = with_med.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    return with_med.join(mad, list(keys)).withColumn(out, F.coalesce(F.abs(F.col(value) - F.col("_med")) > F.lit(factor) * F.col("_mad"), F.lit(False))).drop("_med",
        "_mad")


def densify(df: DataFrame, lengths: DataFrame, keys: Sequence[str], position: str, length: str, fill: dict) -> DataFrame:
    """A row for every position 1 to ``length`` of each key; missing ones get the fill values."""
    spine = lengths.where(F.col(length) >= 1).select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col(length).cast("long"))).alias(position))
    return spine.join(df, [*keys, position], "left").na.fill(fill)


def islands(df: DataFrame, keys: Sequence[str], order: str, condition: Column) -> DataFrame:
    """Runs of rows for which the condition holds, by gaps-and-islands: (keys, run_start, run_end, run_length)."""
    numbered = df.withColumn("_all", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(condition)
    tagged = numbered.withColumn("_island", F.col("_all") - F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return tagged.groupBy(*keys, "_island").agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("run_length")).drop("_island")


def longest_run(runs: DataFrame, keys: Sequence[str], first: bool = False) -> DataFrame:
    """The longest run of each key, the earlier of equal ones; ``first`` takes the first run instead."""
    rank = F.struct(F.when(F.lit(first), F.lit(0).cast("long")).otherwise(F.col("run_length")).alias("n"), (-F.col("run_start")).alias("s"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("run_start", "run_end", "run_length"), rank).alias("r")).select(*keys, "r.*")


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: Mapping[str, str], after: Mapping[str, str]) -> DataFrame:
    """Rows with values of the row before (``before``: new column to column) and after in the order within the keys.

    The first order column is the position by which a key is split: neighbours are looked for among the rows of one
    position, and for the first and last of these in the nearest position that has rows. NULL where there is no such row. NULL keys are keys.
    """
    position, rest = order[0], [*order[1:]] or [order[0]]
    inner = Window.partitionBy(*keys, position).orderBy(*rest)
    lag_of = F.struct(*[F.col(c).alias(n) for n, c in before.items()])
    lead_of = F.struct(*[F.col(c).alias(n) for n, c in after.items()])
    edges = df.groupBy(*keys, position).agg(F.min_by(lead_of, F.struct(*rest)).alias("_first"), F.max_by(lag_of, F.struct(*rest)).alias("_last"))
    along = Window.partitionBy(*keys).orderBy(position)
    edges = edges.withColumns({"_before": F.lag("_last").over(along), "_after": F.lead("_first").over(along)}).drop("_first", "_last")
    d = df.withColumns({"_lag": F.lag(lag_of).over(inner), "_lead": F.lead(lead_of).over(inner)})
    j = d.alias("d").join(edges.alias("e"), _same("d", "e", [*keys, position]))
    return j.select(
        *[F.col(f"d.{c}") for c in df.columns],
        *[F.coalesce("d._lag", "e._before")[n].alias(n) for n in before],
        *[F.coalesce("d._lead", "e._after")[n].alias(n) for n in after],
    )


def make_unique(df: DataFrame, keys: Sequence[str], name: str, order: Sequence[str], out: str) -> DataFrame:
    """Names within the keys made unique: x, x.1, x.2 in the given order; a number that makes a name which is there already is passed over.

    The first order column is the position by which the rows of a name are split. NULL names stay NULL.
    """
    position, rest = order[0], [*order[1:]] or [order[0]]
    here = F.row_number().over(Window.partitionBy(*keys, name, position).orderBy(*rest))
    counts = df.groupBy(*keys, name, position).agg(F.count("*").alias("_n"))
    earlier = counts.withColumn("_earlier", F.sum("_n").over(Window.partitionBy(*keys, name).orderBy(position)) - F.col("_n")).drop("_n")
    numbered = r"^(.*)\.([1-9][0-9]{0,8})$"
    taken = (
        df.where(F.col(name).rlike(numbered))
        .select(*keys, F.regexp_extract(name, numbered, 1).alias(name), F.regexp_extract(name, numbered, 2).cast("long").alias("_k"))
        .groupBy(*keys, name)
        .agg(F.array_sort(F.collect_set("_k")).alias("_taken"))
    )
    d = df.withColumn("_here", here).alias("d").join(earlier.alias("e"), _same("d", "e", [*keys, name, position])).join(taken.alias("t"), _same("d", "t", [*keys, name]),
        "left")
    n = F.col("_here") + F.col("_earlier") - 1
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), n, lambda v, t: F.when(t <= v, v + 1).otherwise(v))
    return d.select(*[F.col(f"d.{c}") for c in df.columns], F.when(n == 0,
        F.col(f"d.{name}")).otherwise(F.concat(F.col(f"d.{name}"), F.lit("."), free.cast("string"))).alias(out))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps no more than k rows a group before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def trim_points(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last position to keep of each linear contig, from (position, depth_mean, mask).

    An end is trimmed if over 10 of its 100 outermost positions are masked. Its good depth is looked for
    at over 10; where that is more than 100 positions in, everything up to the first position over 15 is
    masked. The cut is at the first position after which 51 positions are unmasked. A contig that never
    is good keeps nothing: ``keep_from > keep_to``.
    """
    size = stats.groupBy(*keys).agg(F.max("position").alias("n"))
    s = stats.join(size, list(keys)).withColumn("rev", F.col("n") - F.col("position") + 1).withColumn("mask", F.coalesce("mask", F.lit(True))).withColumn("depth_mean",
        F.coalesce("depth_mean", F.lit(0.0)))
    good = s.groupBy(*keys).agg(
        F.min(F.when(F.col("depth_mean") > 10, F.col("position"))).alias("lead10"),
        F.min(F.when(F.col("depth_mean") > 15, F.col("position"))).alias("lead15"),
        F.min(F.when(F.col("depth_mean") > 10, F.col("rev"))).alias("tail10"),
        F.min(F.when(F.col("depth_mean") > 15, F.col("rev"))).alias("tail15"),
    )
    far = F.lit(1 << 60)
    lead = F.when(F.coalesce("lead10", far) > 100, F.coalesce("lead15", far)).otherwise(0)
    tail = F.when(F.coalesce("tail10", far) > 100, F.coalesce("tail15", far)).otherwise(0)
    s = s.join(good, list(keys)).withColumn("mask", F.col("mask") | (F.col("position") <= lead) | (F.col("rev") <= tail))
    w = Window.partitionBy(*keys).orderBy("position")
    s = s.withColumn("after", F.max("mask").over(w.rowsBetween(1, 51))).withColumn("before", F.max("mask").over(w.rowsBetween(-51, -1)))
    return (
        s.groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.sum(F.when(F.col("position") <= 100, F.col("mask").cast("int"))).alias("lead_masked"),
            F.sum(F.when(F.col("rev") <= 100, F.col("mask").cast("int"))).alias("tail_masked"),
            F.min(F.when(~F.coalesce("after", F.lit(True)), F.col("position"))).alias("lead_cut"),
            F.max(F.when(~F.coalesce("before", F.lit(True)), F.col("position"))).alias("tail_cut"),
        )
        .select(
            *keys,
            F.when(F.col("lead_masked") > 10, F.coalesce(F.col("lead_cut"), F.col("n")) + 1).otherwise(F.lit(1)).cast("long").alias("keep_from"),
            F.when(F.col("tail_masked") > 10, F.coalesce(F.col("tail_cut"), F.lit(1)) - 1).otherwise(F.col("n")).cast("long").alias("keep_to"),
        )
    )
