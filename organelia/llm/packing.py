"""Filling containers of a fixed token capacity: bin completion over blocks of documents."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from organelia.llm.tokens import TOKENIZER, tokenizer
from organelia.session import cut, send_file, ship

#: Documents that are packed together, on the average: a task holds the sizes of one block.
BLOCK = 8192
#: Fillings that the search looks at beyond those of one whole descent; ``None`` searches until the least number is proved.
NODES = 4000


def best_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes into the fullest container that still takes it."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(room, (s, -1))
        if i < len(room):
            left, b = room.pop(i)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        insort(room, (left - s, b))
    return bins


def lower_bound(counts: Mapping[int, int], capacity: int) -> int:
    """Containers that any packing needs.

    For each k: items over ``capacity - k`` are alone, items over half the capacity are in containers of
    their own, and what items of at least k do not find room for beside these needs more containers.
    """
    order = sorted(s for s, n in counts.items() for _ in range(n))
    sums = [0]
    for s in order:
        sums.append(sums[-1] + s)
    half = bisect_right(order, capacity // 2)
    least = -(-sums[-1] // capacity)
    for k in [0, *sorted(set(order[:half]))]:
        alone = bisect_right(order, capacity - k)
        large = alone - half
        over = sums[half] - sums[bisect_left(order, k)] - (large * capacity - (sums[alone] - sums[half]))
        least = max(least, len(order) - half + max(0, -(-over // capacity)))
    return least


def fillings(counts: Mapping[int, int], order: Sequence[int], room: int) -> Iterator[tuple[int, list[int]]]:
    """Every set of items that fits into ``room``, as (waste, items), least waste first.

    Reachable sums are the bits of a whole number, size after size in the given order; a filling is read
    back from the sums before each size. One without waste is given as soon as the sizes so far allow it.
    """
    full = (1 << room + 1) - 1
    sizes: list[int] = []
    before: list[int] = []
    after: list[int] = []
    reach = 1

    def sets(last: int, total: int) -> Iterator[list[int]]:
        """Items of the first ``last + 1`` sizes that make ``total``."""
        if not total:
            yield []
            return
        for i in range(bisect_left(after, 1, 0, last + 1, key=lambda a: a >> total & 1), last + 1):
            yield from ending(i, total)

    def ending(i: int, total: int) -> Iterator[list[int]]:
        """The same with at least one item of size ``i`` and none of a later one."""
        s, rest = sizes[i], total
        for k in range(1, min(counts[s], total // s) + 1):
            rest -= s
            if before[i] >> rest & 1:
                for items in sets(i - 1, rest):
                    yield [*items, *[s] * k]

    if not room:
        yield 0, []
        return
    for s in order:
        n = min(counts[s], room // s)
        if n <= 0:
            continue
        sizes.append(s)
        before.append(reach)
        power = 1
        while n:
            k = min(power, n)
            reach |= reach << k * s & full
            n -= k
            power *= 2
        after.append(reach)
        if reach >> room & 1:
            for items in ending(len(sizes) - 1, room):
                yield 0, items
    for waste in range(1, room + 1):
        if reach >> room - waste & 1:
            for items in sets(len(sizes) - 1, room - waste):
                yield waste, items


def _smear(bits: int, by: int) -> int:
    """Each bit and the ``by`` positions above it."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def undominated(items: Sequence[int], waste: int, left: int) -> bool:
    """Whether no item left out (sizes as bits of ``left``) could be added, or take the place of a set of the items.

    Such an exchange keeps the container within its capacity and leaves smaller items outside, so to a packing
    with this filling there is one at least as good with the other. An item exactly as large as a set of several is the
    better choice; one as large as a single item is the same choice.
    """
    one = several = 0
    for s in items:
        several |= (one | several) << s
        one |= 1 << s
    better = several | (1 << waste + 1) - 2
    if waste:
        better |= _smear((one | several) << 1, waste - 1)
    return not better & left


class _Node:
    """A container to be completed around the largest item left, and the filling it has just now."""

    __slots__ = ("largest", "others", "tried", "waste", "items")

    def __init__(self, largest: int, others: Iterator[tuple[int, list[int]]]) -> None:
        self.largest, self.others, self.tried, self.waste, self.items = largest, others, 0, 0, None


def bin_completion(sizes: Sequence[int], capacity: int, nodes: int | None = NODES, most: int | None = None, seed: int = 7) -> list[list[int]]:
    """Branch and bound over fillings: the best packing of ``sizes`` (each 1 to ``capacity``) that is found.

    Best-fit decreasing is the first incumbent; if it meets the lower bound it is optimal. Else containers are
    completed one by one, each around the largest item left, by undominated fillings, least waste first. A
    branch is cut as soon as its waste is more than a packing with one container less than the incumbent's can
    have. Among fillings of equal waste those come first whose sizes are drawn early in a seeded order,
    in which frequent sizes are likelier to be early: so the sizes left keep their proportions, and
    the last containers still find items that fit.

    A descent that is never cut looks at a filling a container, more where some are dominated. After as many
    fillings as best-fit has containers and ``nodes`` more the search ends, and best-fit completes the branch it
    is in. ``most`` bounds the fillings tried at a node. With both ``None`` the search ends only when no packing
    with fewer containers exists.
    """
    best = best_fit(sizes, capacity)
    counts = Counter(sizes)
    least = lower_bound(counts, capacity)
    if len(best) <= least:
        return best
    rng = random.Random(seed)
    known = sorted(counts, reverse=True)
    total, limit = sum(sizes), None if nodes is None else len(best) + nodes
    left = sum(1 << s for s in known)
    stack: list[_Node] = []
    used = waste = 0

    def take(items: Sequence[int]) -> None:
        nonlocal left
        for s in items:
            counts[s] -= 1
            if not counts[s]:
                left ^= 1 << s

    def put(items: Sequence[int]) -> None:
        nonlocal left
        for s in items:
            counts[s] += 1
            left |= 1 << s

    def advance(node: _Node) -> bool:
        """The next filling of a node that may lead to a better packing."""
        nonlocal waste, used
        if node.items is not None:
            put(node.items)
            waste -= node.waste
            node.items = None
        for w, items in node.others if most is None or node.tried < most else ():
            if waste + w > (len(best) - 1) * capacity - total or (limit is not None and used >= limit):
                return False
            used += 1
            take(items)
            if undominated(items, w, left):
                node.tried += 1
                node.waste, node.items = w, items
                waste += w
                return True
            put(items)
        return False

    while limit is None or used < limit:
        if left:
            largest = left.bit_length() - 1
            take([largest])
            order = sorted((s for s in known if counts[s]), key=lambda s: -counts[s] * rng.random())
            stack.append(_Node(largest, fillings(counts, order, capacity - largest)))
        else:
            best = [[n.largest, *n.items] for n in stack]
            if len(best) <= least:
                return best
        while stack and not advance(stack[-1]):
            put([stack.pop().largest])
        if not stack:
            return best
    done = [[n.largest, *n.items] for n in stack]
    rest = best_fit(list(counts.elements()), capacity)
    return done + rest if len(done) + len(rest) < len(best) else best


def pack_block(docs: Sequence[tuple[int | None, int, int]], capacity: int, nodes: int | None = NODES, most: int | None = None) -> Iterator[tuple[int, int, int | None,
    int, int]]:
    """(container, slot, doc_id, first token, tokens) for one block of (doc_id, size, copies).

    A document larger than the capacity is cut into full containers and a rest; no other is cut. An
    empty document goes into the first container.
    """
    bins: list[list[tuple[int | None, int, int]]] = []
    items: dict[int, list[tuple[int | None, int]]] = {}
    empty: list[int | None] = []
    for doc, size, copies in docs:
        whole, rest = divmod(size, capacity)
        for _ in range(copies):
            bins += [[(doc, k * capacity, capacity)] for k in range(whole)]
            if not size:
                empty.append(doc)
            elif rest:
                items.setdefault(rest, []).append((doc, whole * capacity))
    sizes = [s for s, v in items.items() for _ in v]
    for b in bin_completion(sizes, capacity, nodes, most) if sizes else []:
        bins.append([(*items[s].pop(), s) for s in b])
    if empty:
        if not bins:
            bins.append([])
        bins[0] += [(doc, 0, 0) for doc in empty]
    for container, content in enumerate(bins):
        for slot, (doc, at, n) in enumerate(content):
            yield container, slot, doc, at, n


def token_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, h, n): id, hash of the text and tokens of each document with a text; one Arrow pass over whole texts."""
    name = send_file(documents.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, name)
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], schema=schema)

    ship(documents.sparkSession)
    text = F.col("text").cast("string")
    d = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return d.mapInArrow(run, "doc_id bigint, h bigint, n int")


PACKED = "pack_name string, container string, slot int, doc_id bigint, token_start int, n_tokens int"


def pack_documents(
    documents: DataFrame, capacities: Mapping[str, int], path: str = TOKENIZER, block: int = BLOCK, nodes: int | None = NODES, most: int | None = None, seed: int = 7
) -> DataFrame:
    """(pack_name, container, slot, doc_id, token_start, n_tokens): the content of each container.

    1. Texts are sized in tokens in one pass. What moves from then on is (doc_id, text hash, size), with
       copies counted before the shuffle, written to the checkpoint folder.
    2. A document's block is a seeded hash of these three, so containers do not depend on how the rows were
       split when they were read; there are as many blocks as hold ``block`` documents each. The copies of a document are
       dealt out over all blocks in turn, so one text that is most of the rows fills no block.
    3. Each block is packed for every capacity by ``bin_completion``; ``nodes`` and ``most`` are its.

    ``container`` is ``block.number``, unique within its pack. ``token_start`` counts from 0; a document is
    cut only if it alone exceeds the capacity.

    NULL text is in no container; an empty text has 0 tokens and takes no room. NULL doc_id and repeated
    rows are packed like others. Capacities must be at least 1. No rows in, no rows out. Other columns are not read.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a container's capacity must be at least 1")
    named = list(capacities.items())
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip(("pack_name", "container", "slot", "doc_id", "token_start", "n_tokens"), types, strict=True)))

    sized = cut(token_sizes(documents, path).groupBy("doc_id", "h", "n").agg(F.count("*").alias("copies")))
    # One number comes to the driver.
    count = sized.agg(F.sum("copies")).first()[0] or 0
    blocks = max(1, -(-count // block))
    spread = F.least(F.col("copies"), F.lit(blocks))
    dealt = sized.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)))
    dealt = dealt.select(
        F.pmod(F.xxhash64("doc_id", "h", "n", F.lit(seed)) + F.col("i"), F.lit(blocks)).cast("long").alias("block"),
        "doc_id",
        "h",
        "n",
        (F.floor(F.col("copies") / blocks) + (F.col("i") < F.col("copies") % blocks).cast("int")).cast("int").alias("copies"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, int]] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            for name, capacity in named:
                rows = [(name, f"{now}.{c}", slot, doc, at, n) for c, slot, doc, at, n in pack_block(held, capacity, nodes, most)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

        for batch in batches:
            for b, doc, n, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != now:
                    yield from flush()
                    held, now = [], b
                held.append((doc, n, copies))
        yield from flush()

    parts = min(blocks, max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = dealt.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", "doc_id", "h")
    return placed.select("block", "doc_id", "n", "copies").mapInArrow(run, PACKED)


def fill_report(packed: DataFrame, capacities: Mapping[str, int]) -> DataFrame:
    """(pack_name, capacity, n_containers, n_pieces, used_tokens, used_share) of each pack."""
    sizes = F.create_map(*[x for n, c in capacities.items() for x in (F.lit(n), F.lit(c))])
    # Containers begin with slot 0, so counting these counts the containers.
    return (
        packed.groupBy("pack_name")
        .agg(F.count_if(F.col("slot") == 0).alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").cast("long").alias("used_tokens"))
        .withColumn("capacity", F.element_at(sizes, F.col("pack_name")))
        .withColumn("used_share", F.col("used_tokens") / (F.col("capacity") * F.col("n_containers")))
    )


def packing_faults(packed: DataFrame, documents: DataFrame, capacities: Mapping[str, int], path: str = TOKENIZER) -> DataFrame:
    """(pack_name, n_documents, n_overfull, n_cut, n_broken): what a packing must not have, as counts.

    Containers over the capacity; documents cut although they fit a container; documents whose tokens are not each
    in the packing as often as the document is in the table. All are 0 for a right packing. ``n_documents`` are the rows with
    a text. Documents are told apart by doc_id.
    """
    sizes = F.create_map(*[x for n, c in capacities.items() for x in (F.lit(n), F.lit(c))])
    capacity = F.element_at(sizes, F.col("pack_name"))
    over = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("t")).groupBy("pack_name").agg(F.count_if(F.col("t") > capacity).alias("n_overfull"))
    # The sum over first and last tokens of pieces without gaps is a telescope: only its ends are left.
    ends = F.sum(F.col("token_start").cast("long")), F.sum((F.col("token_start") + F.col("n_tokens")).cast("long"))
    got = packed.groupBy("pack_name", "doc_id").agg(
        F.count_if(F.col("token_start") == 0).alias("firsts"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), (ends[1] - ends[0]).alias("span"),
            F.max(F.col("token_start") + F.col("n_tokens")).alias("longest")
    )
    true = token_sizes(documents, path).groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.max("n").alias("most"))
    named = true.select("*", F.explode(F.array(*[F.lit(n) for n in capacities] or [F.lit(None).cast("string")])).alias("pack_name")).where("pack_name is not null")
    both = named.alias("d").join(got.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.pack_name") == F.col("g.pack_name")),
        "left").select("d.pack_name", "rows", "n", "most", "firsts", "tokens", "pieces", "span", "longest")
    wrong = ~F.coalesce((F.col("firsts") == F.col("rows")) & (F.col("tokens") == F.col("n")) & (F.col("span") == F.col("n")) & (F.col("longest") == F.col("most")),
        F.lit(False))
    found = both.groupBy("pack_name").agg(F.sum("rows").alias("n_documents"), F.count_if((F.col("most") <= capacity) & (F.col("pieces") > F.col("rows"))).alias("n_cut"),
        F.count_if(wrong).alias("n_broken"))
    return found.join(over, "pack_name", "left").select("pack_name", "n_documents", F.coalesce("n_overfull", F.lit(0).cast("long")).alias("n_overfull"), "n_cut",
        "n_broken")
