"""References to records that do not exist, are withdrawn or are loaded later."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from organelia.operators.intervals import sweep
from organelia.session import cut

#: Sub-dictionaries of the key dictionary; each numbers its keys on its own, so no task sees all keys. There are more of them
#: where these would hold over ``DICTIONARY`` referred (key, month) groups each.
DICTIONARIES = 256
DICTIONARY = 1_000_000
#: The month of rows without a time: no parent is live in it.
NO_MONTH = -(1 << 20)
#: Width in microseconds of the time buckets in which live spans are merged.
SPAN_BUCKET = 30 * 86_400 * 1_000_000
#: A group of more than one thousandth of a relation's rows is split into this many stretches of its month, and each into hash parts.
CELLS = 32
CELL = 31 * 86_400 * 1_000_000 // CELLS
SALTS = 4


@dataclass(frozen=True)
class Reference:
    """A referring field and the table it refers to. ``child_id`` names the referring row in the report."""

    name: str
    child: DataFrame
    child_id: str
    field: str
    parent: DataFrame
    parent_key: str


def reference_key(c: Column) -> Column:
    """The form in which keys are compared: outer white space off, lower case."""
    return F.lower(F.btrim(c.cast("string"), F.lit(" \t\r\n\f\x0b\u00a0")))


def _month(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _months_from_epoch(us: Column) -> Column:
    t = F.timestamp_micros(us)
    return (F.year(t) - 1970) * 12 + F.month(t) - 1


def _month_start(m: Column) -> Column:
    return F.unix_micros(F.make_timestamp(F.lit(1970) + F.floor(m / 12), F.pmod(m, F.lit(12)) + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def orphans(references: Sequence[Reference], dictionaries: int = DICTIONARIES, salts: int = SALTS) -> DataFrame:
    """Orphan references as (table_name, period, id, ref_key), distinct.

    A reference is an orphan if no parent row with its key has
    ``parent.loaded_at <= child.loaded_at < parent.removed_at`` (``removed_at`` NULL: never withdrawn).

    1. Keys are dictionary-encoded: a code is the sub-dictionary (hash of the key) and the key's rank in
       it, so codes do not depend on how rows are partitioned and survive lost executors.
    2. Per (relation, key range of 64, month) the referred keys and the keys that are live throughout the
       month are or-ed into 64-bit words; words without a bit are never stored.
    3. ``refs AND NOT parents`` leaves the (key, month) bits that may hold orphans; they are decoded.
    4. Rows of those bits are held exactly against the parents' live spans, which are merged by a sweep
       line and cut at month ends. A (key, month) with over a thousandth of a relation's rows is cut into
       stretches of time and salted, so that neither its rows nor their comparisons meet in one task.

    NULL keys refer to nothing. Empty text is a key like any other. A child without ``loaded_at`` finds no
    parent: it goes the same way in a month of its own and is an orphan with ``period`` NULL. A parent without ``loaded_at``, or withdrawn before it
    was loaded, is never live. Repeated rows are reported once. Other columns are not read.
    """
    childs = []
    parents = []
    for t, r in enumerate(references):
        childs.append(
            r.child.select(
                F.lit(t).alias("t"),
                F.col(r.child_id).cast("string").alias("id"),
                reference_key(F.col(r.field)).alias("key"),
                _micros(F.col("loaded_at")).alias("ts"),
            ).where("key is not null")
        )
        parents.append(
            r.parent.select(
                F.lit(t).alias("t"),
                reference_key(F.col(r.parent_key)).alias("key"),
                _micros(F.col("loaded_at")).alias("s"),
                _micros(F.col("removed_at")).alias("x"),
            )
            .where("key is not null and s is not null and (x is null or x > s)")
            .distinct()
        )
    children = reduce(DataFrame.unionAll, childs).withColumn("m", F.coalesce(_months_from_epoch(F.col("ts")), F.lit(NO_MONTH)))
    live = sweep(reduce(DataFrame.unionAll, parents), ["t", "key"], F.col("s"), F.col("x") - 1, SPAN_BUCKET).where("kind = 'covered'").select("t", "key",
        F.col("seg_start").alias("s"), F.col("seg_end").alias("e"))

    referred = cut(children.groupBy("t", "key", "m").agg(F.count("*").alias("n")))
    # One row per relation: how far live spans have to be carried on, and what counts as a hot group.
    dated = F.when(F.col("m") != NO_MONTH, F.col("m"))
    relations = F.broadcast(referred.groupBy("t").agg(F.min(dated).alias("first_m"), F.max(dated).alias("last_m"), F.sum("n").alias("all_n")))

    spans = cut(
        live.join(relations, "t")
        .withColumn("from_m", F.greatest(_months_from_epoch(F.col("s")), F.col("first_m")))
        .withColumn("to_m", F.least(F.coalesce(_months_from_epoch(F.col("e")), F.col("last_m")), F.col("last_m")))
        .where("from_m <= to_m")
        .select("t", "key", "s", "e", F.explode(F.sequence("from_m", "to_m")).alias("m"))
        .withColumn("whole", (F.col("s") <= _month_start(F.col("m"))) & (F.col("e").isNull() | (F.col("e") >= _month_start(F.col("m") + 1) - 1)))
    )

    # One number comes to the driver.
    dictionaries *= max(1, -(-referred.count() // (dictionaries * DICTIONARY)))
    sub = F.pmod(F.xxhash64("key"), F.lit(dictionaries))
    names = referred.select("t", "key").distinct().withColumn("sub", sub)
    rank = F.row_number().over(Window.partitionBy("t", "sub").orderBy("key")).cast("long")
    codes = names.select("t", "key", (F.shiftleft(F.col("sub").cast("long"), 40) + rank - 1).alias("code"))

    marks = referred.select("t", "key", "m", F.lit(False).alias("parent")).unionByName(spans.where("whole").select("t", "key", "m", F.lit(True).alias("parent")))
    bit = F.expr("shiftleft(1L, cast(code & 63 as int))")
    words = marks.join(codes, ["t", "key"]).groupBy("t", F.shiftright("code", 6).alias("rng"), "m").agg(F.bit_or(F.when(~F.col("parent"), bit)).alias("refs"),
        F.bit_or(F.when(F.col("parent"), bit)).alias("parents"))
    left = words.withColumn("rest", F.col("refs").bitwiseAND(F.bitwise_not(F.coalesce("parents", F.lit(0).cast("long"))))).where("rest <> 0")
    bits = left.select("t", "m", "rng", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftright(rest, b) & 1L) = 1L)")).alias("bit"))
    open_bits = bits.select("t", "m", (F.shiftleft("rng", 6) + F.col("bit")).alias("code")).join(codes, ["t", "code"]).select("t", "key", "m")

    # A group is hot from a thousandth of its relation's rows on, so there are at most a thousand a relation.
    hot = F.broadcast(referred.join(relations, "t").where("n * 1000 >= all_n").select("t", "key", "m", F.lit(True).alias("hot")))
    split = F.coalesce("hot", F.lit(False))
    start = _month_start(F.col("m"))
    cell = lambda us: F.when(F.col("m") == NO_MONTH, 0).otherwise(F.least(F.greatest(F.floor((us - start) / F.lit(CELL)), F.lit(0)),
        F.lit(CELLS - 1)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.when(split, n - 1).otherwise(0)))

    rows = children.join(hot, ["t", "key", "m"], "left")
    rows = rows.withColumn("cell", F.when(split, cell(F.col("ts"))).otherwise(0)).withColumn("salt", F.when(split,
        F.pmod(F.xxhash64("id", "ts"), F.lit(salts))).otherwise(0).cast("int")).drop("hot")
    wanted = open_bits.join(hot, ["t", "key", "m"], "left").withColumn("cell", every(CELLS)).withColumn("salt", every(salts)).drop("hot")
    on = ["t", "key", "m", "cell", "salt"]
    suspects = rows.join(wanted, on, "left_semi")
    last = F.coalesce("e", F.lit((1 << 62)))
    alive = (
        spans.select("t", "key", "m", "s", "e")
        .join(open_bits, ["t", "key", "m"], "left_semi")
        .join(hot, ["t", "key", "m"], "left")
        .withColumn("cell", F.explode(F.when(split, F.sequence(cell(F.col("s")), cell(last))).otherwise(F.array(F.lit(0)))))
        .withColumn("salt", every(salts))
        .drop("hot")
    )
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"c.{c}") == F.col(f"p.{c}"))
    missing = suspects.alias("c").join(alive.alias("p"), same & (F.col("c.ts") >= F.col("p.s")) & (F.col("p.e").isNull() | (F.col("c.ts") <= F.col("p.e"))), "left_anti")
    name = F.element_at(F.array(*[F.lit(r.name) for r in references]), F.col("t") + 1)
    return missing.select(name.alias("table_name"), _month(F.col("ts")).alias("period"), "id", F.col("key").alias("ref_key")).distinct()
