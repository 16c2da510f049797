"""Mixing sources to target token shares: subset-sum fitting on counts of exact token lengths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from organelia.llm.tokens import TOKENIZER, token_count
from organelia.session import cut, ship

#: Tokens of a source's budget that are fitted exactly, as bits of a number; what a budget has above half of this is taken evenly over the lengths first.
WINDOW = 1 << 16
#: Hash ranges that a (source, length) group is counted in, so that choosing from it needs no task that holds it whole.
RANGES = 256


@dataclass(frozen=True)
class Target:
    """A source's wanted share of all tokens and how often one of its documents may be used."""

    source: str
    share: float
    max_repeats: int


def source_key(c: Column) -> Column:
    """The form in which sources are compared."""
    return F.lower(F.btrim(c.cast("string"), F.lit(" \t\r\n\f\x0b ")))


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take so that the tokens come as near to ``budget`` as is possible from below.

    Most of the budget is taken evenly over the lengths. What is left, below ``window`` where the lengths
    allow it, is a bounded knapsack over the documents that remain: reachable sums are the bits of a whole
    number, counts are split into powers of two, and the chosen ones are read back from the kept sums.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * max(budget - window // 2, 0) // total if total else 0 for c in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if rest <= window or not lengths[i]:
            break
        k = min(counts[i] - take[i], (rest - window // 2) // lengths[i])
        take[i] += k
        rest -= k * lengths[i]
    mask = (1 << (rest + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for i in order:
        left, power = counts[i] - take[i], 1
        if not lengths[i]:
            continue
        while left and not reach >> rest & 1:
            k = min(power, left)
            size = k * lengths[i]
            if size > rest:
                break
            steps.append((i, k, reach))
            reach |= (reach << size) & mask
            left -= k
            power *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def mix_sources(documents: DataFrame, targets: Sequence[Target], total_tokens: int | None = None, seed: int = 7, path: str = TOKENIZER, window: int = WINDOW,
    ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """Documents of each source so that the token shares meet the targets, and the shares that come out.

    Returns ``chosen`` (doc_id, source, n_tokens, copies) and ``shares`` (source, target_share, max_repeats,
    available_docs, available_tokens, budget_tokens, chosen_docs, chosen_tokens, actual_share).

    1. Documents are sized in tokens and counted by source and exact length.
    2. ``total_tokens`` None: the largest total at which every source that has tokens can give its share
       with its repeats, the shares being those among such sources. A total beyond that is filled as far
       as the repeats allow; the report shows what is short.
    3. A source's budget is whole passes over all its documents and a rest, fitted by ``fit_lengths`` on its
       counts by length.
    4. Of each length the wanted number of documents is chosen in the order of a seeded hash. Hash ranges
       are counted first, so only the range in which the choice ends is ordered, never a whole group.

    Sources are compared without case and outer blanks. Documents with NULL doc_id, text or source, or of a
    source without target, are left out; so are empty texts, which have no tokens. A repeated row counts
    once. A source without documents is reported with 0 tokens. Targets with a share or repeats of 0 or
    less get nothing. Other columns are not read.
    """
    wanted = {t.source.strip().lower(): t for t in targets if t.source is not None and (t.share or 0) > 0 and (t.max_repeats or 0) > 0}
    ship(documents.sparkSession)
    known = source_key(F.col("source"))
    sized = cut(
        documents.where(known.isin(list(wanted) or [""]) & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), known.alias("source"), token_count(F.col("text").cast("string"), path).alias("n"))
        .where("n > 0")
        .distinct()
    )
    lengths = sized.groupBy("source", "n").agg(F.count("*").alias("c"))
    # At most a row per target comes to the driver.
    have = {r["source"]: (r["docs"], r["tokens"]) for r in lengths.groupBy("source").agg(F.sum("c").alias("docs"),
        F.sum(F.col("n") * F.col("c")).alias("tokens")).collect()}
    share_of = sum(wanted[s].share for s in have) or 1.0
    if total_tokens is None:
        total_tokens = int(min((have[s][1] * wanted[s].max_repeats / (wanted[s].share / share_of) for s in have), default=0))
    budgets = {s: min(round(total_tokens * wanted[s].share / share_of), have[s][1] * wanted[s].max_repeats) for s in have}
    passes = {s: budgets[s] // have[s][1] for s in have}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        s = group["source"].iloc[0]
        group = group.sort_values("n")
        rest = budgets[s] - passes[s] * have[s][1]
        return group.assign(take=fit_lengths(group["n"].tolist(), group["c"].tolist(), rest, window))[["source", "n", "take"]]

    # A group is the distinct lengths of a source, bounded by the longest text.
    take = lengths.groupBy("source").applyInPandas(fit, "source string, n int, take long")
    hashed = sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.pmod("h", F.lit(ranges)))
    counted = hashed.groupBy("source", "n", "part").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("source", "n").orderBy("part")) - F.col("here")
    quota = (
        counted.withColumn("before", before)
        .join(take, ["source", "n"])
        .select("source", "n", "part", "here", F.greatest(F.lit(0), F.least(F.col("here"), F.col("take") - F.col("before"))).alias("quota"))
    )
    base = F.element_at(F.create_map(*([x for s in passes for x in (F.lit(s), F.lit(passes[s]))] or [F.lit(""), F.lit(0)])), F.col("source")).cast("int")
    offered = hashed.join(quota, ["source", "n", "part"])
    rank = F.row_number().over(Window.partitionBy("source", "n", "part").orderBy("h", "doc_id"))
    chosen = (
        offered.withColumn("extra", F.when(rank <= F.col("quota"), 1).otherwise(0))
        .select("doc_id", "source", F.col("n").alias("n_tokens"), (base + F.col("extra")).cast("int").alias("copies"))
        .where("copies > 0")
    )
    spark = documents.sparkSession
    goals = spark.createDataFrame(
        [(s, float(t.share), int(t.max_repeats), int(have.get(s, (0, 0))[0]), int(have.get(s, (0, 0))[1]), int(budgets.get(s, 0))) for s, t in wanted.items()],
        "source string, target_share double, max_repeats int, available_docs long, available_tokens long, budget_tokens long",
    )
    got = chosen.groupBy("source").agg(F.count("*").alias("chosen_docs"), F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("chosen_tokens"))
    zero = F.lit(0).cast("long")
    shares = goals.join(got, "source", "left").withColumns({"chosen_docs": F.coalesce("chosen_docs", zero), "chosen_tokens": F.coalesce("chosen_tokens", zero)})
    # The window spans one row per target.
    shares = shares.withColumn("actual_share", F.try_divide(F.col("chosen_tokens"), F.sum("chosen_tokens").over(Window.partitionBy())))
    return chosen, shares


def mixture_faults(chosen: DataFrame, shares: DataFrame, documents: DataFrame, targets: Sequence[Target], path: str = TOKENIZER) -> DataFrame:
    """(source, n_foreign, n_repeated, n_misjudged, off_target): what a mixture must not have, of each source.

    Chosen documents that are not of the source; used more often than its limit; with another number of tokens than
    the text has; and whether the tokens are more than the source's longest document away from its share of all tokens
    chosen, the shares being those among sources that have tokens. All are 0 or false for a right mixture without a
    ``total_tokens`` beyond what there is. Documents are told apart by doc_id.
    """
    limits = F.create_map(*([x for t in targets for x in (F.lit(t.source.strip().lower()), F.lit(t.max_repeats))] or [F.lit(""), F.lit(0)]))
    true = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("of"),
        token_count(F.col("text").cast("string"), path).alias("n"))
    both = chosen.join(true.groupBy("doc_id").agg(F.collect_set("of").alias("of"), F.collect_set("n").alias("n")), "doc_id", "left")
    found = both.groupBy("source").agg(
        F.count_if(~F.coalesce(F.array_contains("of", F.col("source")), F.lit(False))).alias("n_foreign"),
        F.count_if(F.col("copies") > F.coalesce(F.element_at(limits, F.col("source")), F.lit(0))).alias("n_repeated"),
        F.count_if(~F.coalesce(F.array_contains("n", F.col("n_tokens")), F.lit(False))).alias("n_misjudged"),
        F.max("n_tokens").alias("longest"),
    )
    # The windows span one row per target.
    everything = Window.partitionBy()
    has = F.col("available_tokens") > 0
    wanted = F.when(has, F.col("target_share") / F.sum(F.when(has, F.col("target_share"))).over(everything)).otherwise(0.0)
    off = F.abs(F.col("chosen_tokens") - wanted * F.sum("chosen_tokens").over(everything)) > F.coalesce("longest", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return shares.join(found, "source", "left").select("source", zero("n_foreign"), zero("n_repeated"), zero("n_misjudged"), off.alias("off_target"))
