"""Interval algebra: sweep line over keyed intervals, overlap and point joins, circular maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from organelia.session import cut

#: Positions of one key handled by one task. An event row is one distinct position, so a task never holds more rows of a key.
BUCKET = 1 << 16


def _lead_in_key(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` of the next row of the key, for rows that are split over (k, bucket).

    Within a bucket it is a plain lead; the last row of a bucket takes the first value of the next
    bucket that has rows, found over one summary row per bucket.
    """
    inner = Window.partitionBy("k", "bucket").orderBy("pos")
    firsts = df.groupBy("k", "bucket").agg(F.min(value).alias("first"))
    nexts = firsts.select("k", "bucket", F.lead("first").over(Window.partitionBy("k").orderBy("bucket")).alias("beyond"))
    return (
        df.withColumn("_lead", F.lead(value).over(inner))
        .join(nexts, ["k", "bucket"])
        .withColumn(out, F.coalesce("_lead", "beyond"))
        .drop("_lead", "beyond")
    )


def sweep(df: DataFrame, keys: Sequence[str], start: Column, end: Column, bucket: int = BUCKET) -> DataFrame:
    """Sweep line over closed integer intervals: the covered periods of each key and the gaps between.

    Every interval becomes a plus event at ``start`` and a minus event after ``end``. Events are summed
    per (key, position) before they are shuffled on (key, position bucket), so neither many copies of an
    interval nor one key with most of the rows meets in one task: the running count is a prefix sum
    within the bucket plus the prefix sum of the bucket totals before it.

    Returns the key columns, ``kind`` (``covered`` or ``gap``), ``seg_start`` and ``seg_end``.

    * ``end`` NULL: the interval is open and never closes; its covered period has ``seg_end`` NULL.
    * ``start`` NULL or ``end < start``: the row is ignored.
    * NULL in a key column is a key of its own. Repeated rows and ties change nothing. Adjacent
      intervals (end + 1 = start) form one period. No rows in, no rows out.
    """
    k = F.struct(*[df[c].alias(f"k{i}") for i, c in enumerate(keys)])
    raw = df.select(k.alias("k"), start.cast("long").alias("s"), end.cast("long").alias("e")).where("s is not null and (e is null or e >= s)")
    events = (
        raw.select("k", F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("pos"),
            F.lit(-1).alias("d")))).alias("x"))
        .select("k", "x.pos", "x.d")
        .where("pos is not null")
        .groupBy("k", F.floor(F.col("pos") / F.lit(bucket)).alias("bucket"), "pos")
        .agg(F.sum("d").alias("d"))
        .where("d <> 0")
    )
    totals = events.groupBy("k", "bucket").agg(F.sum("d").alias("t"))
    before = totals.select("k", "bucket", (F.sum("t").over(Window.partitionBy("k").orderBy("bucket")) - F.col("t")).alias("base"))
    running = (
        events.withColumn("run", F.sum("d").over(Window.partitionBy("k", "bucket").orderBy("pos")))
        .join(before, ["k", "bucket"])
        .select("k", "bucket", "pos", (F.col("base") + F.col("run")).alias("active"), "d")
    )
    edges = running.where("active = 0 or active = d").select("k", "bucket", "pos", (F.col("active") > 0).alias("opens"))
    return (
        _lead_in_key(edges, "pos", "nxt")
        .where("opens or nxt is not null")
        .select(
            *[F.col(f"k.k{i}").alias(c) for i, c in enumerate(keys)],
            F.when(F.col("opens"), "covered").otherwise("gap").alias("kind"),
            F.col("pos").alias("seg_start"),
            (F.col("nxt") - 1).alias("seg_end"),
        )
    )


def covered_and_gaps(annotations: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Covered periods and gaps of each contig strand, from gene calls.

    Input columns: id, path, scaffold, direction, pos1, pos2; others are not read. Positions are 1-based
    and closed; ``pos1 > pos2`` covers pos1 to the contig's end and 1 to pos2. Rows with a NULL direction,
    a NULL position or a position below 1 are ignored. A covered period up to the contig's end has
    ``seg_end`` NULL, for the end is not known from the calls. NULL id, path or scaffold is a value of its
    own. Overlapping, nested, adjacent and repeated calls merge.
    """
    calls = annotations.where("direction is not null and pos1 >= 1 and pos2 >= 1")
    parts = calls.select(
        "id",
        "path",
        "scaffold",
        "direction",
        F.inline(
            F.when(F.col("pos1") <= F.col("pos2"), F.array(F.struct(F.col("pos1").cast("long").alias("s"), F.col("pos2").cast("long").alias("e")))).otherwise(
                F.array(F.struct(F.col("pos1").cast("long").alias("s"), F.lit(None).cast("long").alias("e")), F.struct(F.lit(1).cast("long").alias("s"),
                    F.col("pos2").cast("long").alias("e")))
            )
        ),
    )
    return sweep(parts, ["id", "path", "scaffold", "direction"], F.col("s"), F.col("e"), bucket)


def _two_ends(spans: DataFrame, keys: Sequence[str], at: str, other: str, greatest: bool) -> DataFrame:
    """(keys, at, one, two, last, beyond, later): of the spans with an end at ``at`` the two farthest other ends and the nearest; the farthest of all
    spans whose end lies before, and the nearest of all whose end lies behind.

    ``greatest``: far is large, and before is lower; else the other way round. A key has one row a position here, and a
    position has no more ends than there are positions.
    """
    ends = spans.groupBy(*keys, at).agg(F.sort_array(F.collect_set(other), not greatest).alias("_all"))
    ends = ends.select(*keys, at, F.get("_all", F.lit(0)).alias("one"), F.get("_all", F.lit(1)).alias("two"), F.element_at("_all", -1).alias("last"))
    along = Window.partitionBy(*keys).orderBy(F.asc(at) if greatest else F.desc(at))
    far, near = (F.max, F.min) if greatest else (F.min, F.max)
    return ends.withColumns({"beyond": far("one").over(along.rowsBetween(Window.unboundedPreceding, -1)),
        "later": near("last").over(along.rowsBetween(1, Window.unboundedFollowing))})


def _longest_inside(inner: DataFrame, outer: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """(keys, s, e, inside): the length of the longest other span of ``inner`` that lies within each span of ``outer``.

    Starts are sorted into the nodes of a binary tree over the positions. The starts from ``s`` on are the leaf ``s`` and
    the right neighbours of the nodes above it, one a level at most; within a node the answer is a running maximum of
    lengths along the ends. Lengths are reduced to one a node and end before the shuffle, and so are the questions, so a
    window has at most two rows a position, however many spans a key has.
    """
    above = lambda step: F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda j: F.struct(j.alias("j"),
        (F.call_function("shiftright", F.col("s"), j) + step).alias("node")))
    right = lambda nodes: F.filter(nodes, lambda x: x["node"] % 2 == 1)
    # The leaf stands apart, as level -1: in it only spans that end before may count, elsewhere all that end by then.
    leaf = lambda *more: F.array(F.struct(F.lit(-1).alias("j"), F.col("s").alias("node"), *more))
    points = inner.select(*keys, "e", (F.col("e") - F.col("s") + 1).alias("n"), F.inline(F.concat(leaf(), right(above(0))))).groupBy(*keys, "j", "node",
        "e").agg(F.max("n").alias("n"))
    asked = F.transform(right(above(1)), lambda x: F.struct(x["j"].alias("j"), x["node"].alias("node"), F.col("e").alias("by")))
    questions = outer.select(*keys, "s", "e", F.inline(F.concat(leaf((F.col("e") - 1).alias("by")), asked)))
    both = points.withColumn("asks", F.lit(0)).unionByName(questions.select(*keys, "j", "node", F.col("by").alias("e")).distinct().withColumn("asks", F.lit(1)),
        allowMissingColumns=True)
    along = Window.partitionBy(*keys, "j", "node").orderBy("e", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = both.withColumn("inside", F.max("n").over(along)).where("asks = 1 and inside is not null").select(*keys, "j", "node", F.col("e").alias("by"), "inside")
    return questions.join(answers, [*keys, "j", "node", "by"]).groupBy(*keys, "s", "e").agg(F.max("inside").alias("inside"))


def worst_overlaps(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, any_overlap, left_overlap, right_overlap) of each distinct closed span: the most positions that it
    shares with another row, with another row that holds its start, and with one that holds its end.

    Nothing is paired: what begins before a span is a running maximum of ends, what ends after it one of starts, and what
    lies within is found in a tree of the starts, which only spans within others and around others enter. So the work grows
    with n log n also where one key has most of the rows. Copies of a span overlap each other; NULL means no overlap. Rows
    with NULL keys or bounds, a start below 0 or an end before the start are left out.
    """
    d = spans.select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s >= 0 and e >= s").dropna(subset=[*keys])
    d = d.groupBy(*keys, "s", "e").agg(F.count("*").alias("m"))
    left = _two_ends(d, keys, "s", "e", True).select(*keys, "s", F.col("one").alias("l1"), F.col("two").alias("l2"), F.col("beyond").alias("lb"),
        F.col("last").alias("lo"), "later")
    right = _two_ends(d, keys, "e", "s", False).select(*keys, "e", F.col("one").alias("r1"), F.col("two").alias("r2"), F.col("beyond").alias("rb"))
    j = cut(d.join(left, [*keys, "s"]).join(right, [*keys, "e"]))
    inner = j.where("coalesce(lb >= e, false) or l1 > e")
    outer = j.where("coalesce(later <= e, false) or lo < e")
    # One number comes to the driver: how many levels the tree needs.
    levels = int(j.agg(F.max("s")).first()[0] or 0).bit_length()
    j = j.join(_longest_inside(inner, outer, keys, levels), [*keys, "s", "e"], "left")
    copies = F.when(F.col("m") > 1, F.col("e") - F.col("s") + 1)
    # The span itself is the farthest at its own position, or not.
    at_left = F.greatest("lb", F.when(F.col("l1") > F.col("e"), F.col("l1")).otherwise(F.col("l2")))
    at_right = F.least("rb", F.when(F.col("r1") < F.col("s"), F.col("r1")).otherwise(F.col("r2")))
    shared_left = F.when(at_left >= F.col("s"), F.least(at_left, F.col("e")) - F.col("s") + 1)
    shared_right = F.when(at_right <= F.col("e"), F.col("e") - F.greatest(at_right, F.col("s")) + 1)
    return j.select(
        *keys,
        F.col("s").alias(start),
        F.col("e").alias(end),
        F.greatest(shared_left, shared_right, "inside", copies).alias("any_overlap"),
        F.greatest(shared_left, copies).alias("left_overlap"),
        F.greatest(shared_right, copies).alias("right_overlap"),
    )


def overlap_length(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Positions that two closed intervals share; NULL if a bound is NULL."""
    return F.when(a1.isNull() | a2.isNull() | b1.isNull() | b2.isNull(), None).otherwise(F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1) + 1))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """Pairs of rows that overlap within equal keys; both sides have ``start`` and ``end``.

    Each side is listed once per position bucket it touches, so a key with many intervals is split over
    tasks; a pair is kept only in the bucket of the later of the two starts, hence once. Right columns get
    the prefix ``r_``. NULL keys or bounds join nothing.
    """

    def cells(d: DataFrame) -> DataFrame:
        return d.where("start is not null and `end` >= start").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))

    r = cells(right.select([F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns]).withColumnsRenamed({"r_start": "start",
        "r_end": "end"})).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    joined = cells(left).join(r, [*keys, "cell"])
    return joined.where((F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) & (F.col("cell") == F.floor(F.greatest("start",
        "r_start") / bucket))).drop("cell")


def point_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], position: str, bucket: int) -> DataFrame:
    """Each point with every span of the same key that holds it; spans have ``start`` and ``end``."""
    s = spans.where("start is not null and `end` >= start").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    return points.withColumn("cell", F.floor(F.col(position) / bucket)).join(s, [*keys, "cell"]).where(F.col(position).between(F.col("start"), F.col("end"))).drop("cell")


def rotate(pos1: Column, pos2: Column, origin: Column, length: Column) -> tuple[Column, Column]:
    """Positions after a circular contig of ``length`` is cut so that ``origin`` becomes 1."""
    return F.pmod(pos1 - origin, length) + 1, F.pmod(pos2 - origin, length) + 1


def rotate_reverse(pos1: Column, pos2: Column, origin_end: Column, length: Column) -> tuple[Column, Column]:
    """As ``rotate`` for a start gene on the minus strand that ends at ``origin_end``: the contig is also reverse-complemented."""
    return F.pmod(origin_end - pos2, length) + 1, F.pmod(origin_end - pos1, length) + 1


def flip(pos1: Column, pos2: Column, length: Column) -> tuple[Column, Column]:
    """Positions on the reverse complement of a contig."""
    return length - pos2 + 1, length - pos1 + 1


def flip_strand(direction: Column) -> Column:
    return F.when(direction == "+", "-").when(direction == "-", "+").otherwise(direction)


def span_length(pos1: Column, pos2: Column, contig_length: Column) -> Column:
    """Length of a call; ``pos1 > pos2`` crosses the origin."""
    return F.when(pos1 <= pos2, pos2 - pos1 + 1).otherwise(contig_length - pos1 + 1 + pos2)
