"""Cuts and edits of contigs and calls as queries over the project tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from organelia.operators import windows as W
from organelia.plans import annotate as A
from organelia.plans import coverage as C
from organelia.plans import curate, edit, params
from organelia.plans.engine import (
    _BY, _CONTIGS, _LENGTHS, _STATS, _TRACK, CONTIG, _calls_sql, _proteins, _PROTEINS, _revcomp_sql, calls, contigs, lengths, track,
)
from organelia.session import table
from organelia.sinks import files as K

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Codons within which an edit looks for the next start or stop.
REACH = 30


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# Coverage trim -----------------------------------------------------------------------------------

_POINTS = f"""{_TRACK}, {_STATS}, s AS (
  SELECT id, path, scaffold, position, coalesce(mean_depth, 0) AS dm, mean_depth_mask OR error_rate_mask AS mask, max(position) OVER ({_BY}) AS n FROM stats
), r AS (SELECT *, n - position + 1 AS rev FROM s
), g AS (
  SELECT *, min(CASE WHEN dm > 10 THEN position END) OVER ({_BY}) AS l10, min(CASE WHEN dm > 15 THEN position END) OVER ({_BY}) AS l15,
    min(CASE WHEN dm > 10 THEN rev END) OVER ({_BY}) AS t10, min(CASE WHEN dm > 15 THEN rev END) OVER ({_BY}) AS t15 FROM r
), m AS (
  SELECT *, mask OR position <= CASE WHEN coalesce(l10, 1e18) > 100 THEN coalesce(l15, 1e18) ELSE 0 END
    OR rev <= CASE WHEN coalesce(t10, 1e18) > 100 THEN coalesce(t15, 1e18) ELSE 0 END AS mk FROM g
), w AS (
  SELECT *, max(mk) OVER ({_BY} ORDER BY position ROWS BETWEEN 1 FOLLOWING AND 51 FOLLOWING) AS aft,
    max(mk) OVER ({_BY} ORDER BY position ROWS BETWEEN 51 PRECEDING AND 1 PRECEDING) AS bef FROM m
), a AS (
  SELECT id, path, scaffold, max(n) AS n, count_if(position <= 100 AND mk) AS lm, count_if(rev <= 100 AND mk) AS tm,
    min(CASE WHEN NOT coalesce(aft, true) THEN position END) AS lc, max(CASE WHEN NOT coalesce(bef, true) THEN position END) AS tc FROM w GROUP BY ALL
), points AS (
  SELECT a.id, a.path, a.scaffold, topology, CASE WHEN topology = 'linear' AND lm > 10 THEN coalesce(lc, n) + 1 ELSE 1 END AS keep_from,
    CASE WHEN topology = 'linear' AND tm > 10 THEN coalesce(tc, 1) - 1 ELSE n END AS keep_to
  FROM a JOIN (SELECT DISTINCT id, path, scaffold, topology FROM track) t USING (id, path, scaffold)
)"""


def _points(t):
    s = C.statistics(t, CONTIG)
    mask = F.col("mean_depth_mask") | F.col("error_rate_mask")
    found = W.trim_points(s.select(*CONTIG, "position", F.col("mean_depth").alias("depth_mean"), mask.alias("mask")), CONTIG)
    kept = t.groupBy(*CONTIG).agg(F.min("topology").alias("topology"), F.max("position").alias("n"))
    linear = F.col("topology") == "linear"
    return found.join(kept, CONTIG).select(*CONTIG, F.when(linear, F.col("keep_from")).otherwise(F.lit(1).cast("long")).alias("keep_from"), F.when(linear,
        F.col("keep_to")).otherwise(F.col("n")).alias("keep_to"))


@_query(f"WITH {_POINTS} SELECT id, path, scaffold, keep_from, keep_to FROM points")
def coverage_trim(spark, base):
    """Where linear contigs are cut by their coverage; circular ones stay whole."""
    return _points(track(spark, base))


@_query(
    f"""WITH {_POINTS}, c AS (SELECT id, path, scaffold, upper(min(sequence)) AS sequence, string_split(trim(min(depth)), ' ') AS d FROM assemblies
  WHERE depth IS NOT NULL AND sequence IS NOT NULL GROUP BY ALL)
SELECT id, path, scaffold, greatest(keep_to - keep_from + 1, 0)::INT AS bases, md5(CASE WHEN keep_to < keep_from THEN '' ELSE substr(sequence, keep_from,
  keep_to - keep_from + 1) END) AS sequence_md5,
 md5(array_to_string(CASE WHEN keep_to < keep_from THEN [] ELSE d[keep_from:keep_to] END, ' ')) AS depth_md5 FROM c JOIN points USING (id, path, scaffold)"""
)
def coverage_trimmed(spark, base):
    """The contigs and depth tracks that are left after the cut."""
    d = table(spark, base, "assemblies").where("depth is not null and sequence is not null").groupBy(*CONTIG).agg(F.upper(F.min("sequence")).alias("sequence"),
        F.min("depth").alias("depth"))
    cut = edit.cut_to(d, _points(track(spark, base)), CONTIG, "keep_from", "keep_to", ["depth"])
    return cut.select(*CONTIG, F.length("sequence").alias("bases"), F.md5("sequence").alias("sequence_md5"), F.md5("depth").alias("depth_md5"))


# Common region of alternative paths --------------------------------------------------------------

_SEVERAL = f"""{_CONTIGS}, first AS (SELECT * FROM contigs WHERE scaffold = 1
), many AS (SELECT id, max(length(sequence)) AS n, count(*) AS k FROM first GROUP BY id HAVING count(*) > 1
), cells AS (SELECT id, position, k, CASE WHEN position <= length(sequence) THEN substr(sequence, position, 1) ELSE '-' END AS b FROM (SELECT *, unnest(range(1,
  n + 1)) AS position FROM first JOIN many USING (id))
), agree AS (SELECT id, position, min(b) = max(b) AND min(b) <> '-' AS same FROM cells GROUP BY id, position
), numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) - row_number() OVER (PARTITION BY id, same ORDER BY position) AS island FROM agree
), runs AS (SELECT id, min(position) AS run_start, max(position) AS run_end, count(*) AS run_length FROM numbered WHERE same GROUP BY id, island
), region AS (SELECT id, run_start, run_end, run_length FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run_length DESC, run_start) AS r FROM runs)
  WHERE r = 1)"""


def _paths(spark, base):
    """First scaffolds of samples with several paths, filled up with gaps to one width: an alignment without inner gaps."""
    first = contigs(spark, base).where("scaffold = 1")
    many = first.groupBy("id").agg(F.max(F.length("sequence")).alias("n"), F.count("*").alias("k")).where("k > 1")
    return first.join(many, "id").withColumn("aligned", F.rpad("sequence", F.col("n"), F.lit("-")))


@_query(f"WITH {_SEVERAL} SELECT id, run_start, run_end, run_length FROM region")
def consensus_region(spark, base):
    return edit.common_region(_paths(spark, base).select("id", "aligned"), ["id"], "aligned")


@_query(f"WITH {_SEVERAL} SELECT f.id, f.path, run_length::INT AS bases, md5(substr(sequence, run_start, run_length)) AS sequence_md5 FROM first f JOIN region USING (id)")
def consensus_cut(spark, base):
    """The paths cut to the longest region in which they agree."""
    paths = _paths(spark, base)
    region = edit.common_region(paths.select("id", "aligned"), ["id"], "aligned")
    cut = edit.cut_to(paths.select("id", "path", "sequence").join(region.select("id"), "id", "left_semi"), region, ["id"], "run_start", "run_end")
    return cut.select("id", "path", F.length("sequence").alias("bases"), F.md5("sequence").alias("sequence_md5"))


# Ends and origins --------------------------------------------------------------------------------

_ENDS = f"""{_calls_sql()}, {_CONTIGS}, s AS (SELECT id, path, scaffold, min(least(pos1, pos2)) AS a, max(greatest(pos1, pos2)) AS b FROM calls GROUP BY ALL
), ends AS (SELECT c.*, topology = 'linear' AND a IS NOT NULL AS cut, a, b FROM contigs c LEFT JOIN s USING (id, path, scaffold))"""


@_query(f"WITH {_ENDS} SELECT id, path, scaffold, topology, md5(CASE WHEN cut THEN substr(sequence, a, b - a + 1) ELSE sequence END) AS sequence_md5 FROM ends")
def end_trim(spark, base):
    """Linear contigs cut to the span of their calls."""
    return K.end_trimmed(calls(spark, base), contigs(spark, base), CONTIG)[0].select(*CONTIG, "topology", F.md5("sequence").alias("sequence_md5"))


@_query(f"WITH {_ENDS} SELECT c.id, c.path, c.scaffold, type, gene, direction, pos1 - CASE WHEN cut THEN a - 1 ELSE 0 END AS pos1, pos2 - CASE WHEN cut THEN a - 1 ELSE 0 END AS pos2 FROM calls c JOIN ends e USING (id, path, scaffold)")
def end_trim_calls(spark, base):
    return K.end_trimmed(calls(spark, base), contigs(spark, base), CONTIG)[1].select(*CONTIG, "type", "gene", "direction", "pos1", "pos2")


_FIRST = "s AS (SELECT id, path, scaffold, arg_min(struct_pack(p1 := pos1, p2 := pos2, d := direction), (pos1, pos2, direction)) AS s FROM calls WHERE gene = 'trnF' GROUP BY ALL)"


@_query(
    f"""WITH {_TRACK}, {_calls_sql()}, {_FIRST} SELECT t.id, t.path, t.scaffold, position AS old_position, depth,
 CASE WHEN s IS NULL THEN position WHEN s.s.d = '-' THEN ((s.s.p2 - position) % length + length) % length + 1
   ELSE ((position - s.s.p1) % length + length) % length + 1 END AS position
FROM track t LEFT JOIN s USING (id, path, scaffold)"""
)
def rotate_track(spark, base):
    """Per-base tracks of contigs that are turned to their start gene."""
    t = track(spark, base).join(A.start_points(calls(spark, base), CONTIG, "trnF"), CONTIG, "left")
    at = A.rotated_positions(F.col("position"), F.col("length"), F.col("cut1"), F.col("cut2"), F.col("cut_strand"))
    return t.select(*CONTIG, F.col("position").alias("old_position"), "depth", at.alias("position"))


_NEAR = "PARTITION BY id, path, scaffold ORDER BY pos1, pos2, replace(gene, 'ctrl', 'OH'), direction, type"


@_query(
    f"""WITH {_calls_sql()}, {_LENGTHS}, j AS (SELECT c.*, contig_length FROM calls c JOIN lengths USING (id, path, scaffold)),
n AS (SELECT *, lag(pos2) OVER w AS b, lead(pos1) OVER w AS a FROM j WINDOW w AS ({_NEAR})),
k AS (SELECT * FROM n WHERE gene <> 'ctrl' OR coalesce(b, 0) < pos1 AND coalesce(a, pos2 + 1) > pos2),
m AS (SELECT *, lag(pos2) OVER w AS b2, lead(pos1) OVER w AS a2 FROM k WINDOW w AS ({_NEAR}))
SELECT id, path, scaffold, direction, pos1 AS old1, pos2 AS old2, coalesce(b2 + 1, 1) AS new1, coalesce(a2 - 1, contig_length) AS new2 FROM m WHERE gene = 'ctrl'"""
)
def control_region_clear(spark, base):
    """Control regions widened as in ``control_region_extend``, but those that overlap a neighbour are dropped before."""
    d = calls(spark, base).join(lengths(spark, base).select(*CONTIG, "contig_length"), CONTIG)
    d = d.withColumns({"old1": F.col("pos1"), "old2": F.col("pos2"), "length": F.lit(0).cast("long"), "gene": F.when(F.col("gene") == "ctrl",
        "OH").otherwise(F.col("gene"))})
    found = A.control_regions(d, CONTIG, "contig_length", drop_overlapping=True).where("gene = 'ctrl'")
    return found.select(*CONTIG, "direction", "old1", "old2", F.col("pos1").alias("new1"), F.col("pos2").alias("new2"))


@_query(
    f"""WITH {_calls_sql()}, {_LENGTHS}, c AS (SELECT c.*, contig_length AS n FROM calls c JOIN lengths USING (id, path, scaffold) WHERE topology = 'circular'),
k AS (SELECT id, path, scaffold, min(pos1) AS cut FROM c WHERE gene = 'cox1' GROUP BY ALL),
g AS (SELECT k.id, k.path, k.scaffold, k.cut FROM k JOIN c USING (id, path, scaffold) GROUP BY ALL HAVING count_if(pos1 < k.cut AND pos2 >= k.cut) = 0)
SELECT id, path, scaffold, type, gene, direction, c.pos1 AS old1, c.pos2 AS old2, CASE WHEN cut IS NULL THEN c.pos1 ELSE ((c.pos1 - cut) % n + n) % n + 1 END AS pos1,
  CASE WHEN cut IS NULL THEN c.pos2 ELSE ((c.pos2 - cut) % n + n) % n + 1 END AS pos2
FROM c LEFT JOIN g USING (id, path, scaffold)"""
)
def linearize(spark, base):
    """Calls of circular contigs that are opened before their first cox1, where that splits no call."""
    d = calls(spark, base).join(lengths(spark, base).where("topology = 'circular'").select(*CONTIG, "contig_length"), CONTIG).withColumns({"old1": F.col("pos1"),
        "old2": F.col("pos2")})
    cuts = d.where("gene = 'cox1'").groupBy(*CONTIG).agg(F.min("pos1").alias("cut"))
    return edit.linearized(d, cuts, CONTIG, "contig_length")[0].select(*CONTIG, "type", "gene", "direction", "old1", "old2", "pos1", "pos2")


# Edits of calls ----------------------------------------------------------------------------------

_OWN = f"own AS (SELECT *, CASE WHEN direction = '-' THEN {_revcomp_sql('sequence')} ELSE sequence END AS o, length(sequence) AS n FROM (SELECT c.*, sequence FROM calls c JOIN contigs USING (id, path, scaffold) WHERE type = 'PCG' AND greatest(pos1, pos2) <= length(sequence)))"
_START_SQL = "('ATG', 'GTG', 'ATA', 'ATT', 'TTA', 'ATC')"
_AT = "substr(o, (first_ {sign} 3 * i)::BIGINT, 3)"


@_query(
    f"""WITH {_calls_sql()}, {_CONTIGS}, {_OWN}, f AS (SELECT *, CASE WHEN direction = '-' THEN n - pos2 + 1 ELSE pos1 END AS first_ FROM own),
x AS (SELECT *, list_filter(range(1, least({REACH}, (first_ - 1) // 3) + 1), lambda i: {_AT.format(sign='-')} IN {_START_SQL})[1]::INT AS up, list_filter(range(1,
  {REACH} + 1), lambda i: {_AT.format(sign='+')} IN {_START_SQL})[1]::INT AS down FROM f)
SELECT id, path, scaffold, gene, direction, pos1 AS old1, pos2 AS old2, up, down, CASE WHEN direction = '+' THEN pos1 - coalesce(up, 0) * 3 ELSE pos1 END AS pos1, CASE
  WHEN direction = '+' THEN pos2 ELSE pos2 + coalesce(up, 0) * 3 END AS pos2 FROM x"""
)
def edit_starts(spark, base):
    """The next start codons before and after each protein call's start, and the call moved to the one before."""
    d = _proteins(spark, base).withColumns({"old1": F.col("pos1"), "old2": F.col("pos2")})
    up, down = curate.next_start("sequence", params.FISH_STARTS, REACH)
    d = d.withColumn("up", up).withColumn("down", down)
    return edit.with_start(d, -F.col("up")).select(*CONTIG, "gene", "direction", "old1", "old2", "up", "down", "pos1", "pos2")


_FIT = "CASE WHEN {c} LIKE 'TAA%' THEN 'TAA' WHEN {c} LIKE 'TAG%' THEN 'TAG' WHEN {c} LIKE 'AGA%' THEN 'AGA' WHEN {c} LIKE 'AGG%' THEN 'AGG' WHEN {c} LIKE 'AG%' THEN 'AG' WHEN {c} LIKE 'TA%' THEN 'TA' WHEN {c} LIKE 'T%' THEN 'T' END"
_IN, _OUT = (_FIT.format(c=f"substr(o, (codon_at {sign} 3 * i)::BIGINT, 3)") for sign in "-+")


@_query(
    f"""WITH {_calls_sql("stop_codon")}, {_CONTIGS}, {_OWN}, f AS (SELECT *, CASE WHEN direction = '-' THEN n - pos1 + 1
  ELSE pos2 END - length(stop_codon) + 1 AS codon_at FROM own WHERE stop_codon IS NOT NULL),
x AS (SELECT *, list_filter(range(1, least({REACH}, (codon_at - 1) // 3) + 1), lambda i: {_IN} IS NOT NULL)[1] AS a, list_filter(range(1, {REACH} + 1),
  lambda i: {_OUT} IS NOT NULL)[1] AS b FROM f),
y AS (SELECT *, (SELECT {_IN} FROM (SELECT x.a AS i)) AS inward_stop, (SELECT {_OUT} FROM (SELECT x.b AS i)) AS outward_stop FROM x)
SELECT id, path, scaffold, gene, direction, pos1 AS old1, pos2 AS old2, stop_codon AS old_stop, a::INT AS inward, inward_stop, b::INT AS outward, outward_stop,
 CASE WHEN direction = '+' THEN pos1 ELSE pos1 - coalesce(b * 3 + length(outward_stop) - length(stop_codon), 0) END AS pos1,
 CASE WHEN direction = '+' THEN pos2 + coalesce(b * 3 + length(outward_stop) - length(stop_codon), 0) ELSE pos2 END AS pos2 FROM y"""
)
def edit_stops(spark, base):
    """The next stop codons within and beyond each protein call, and the call moved to the one beyond."""
    d = calls(spark, base, "stop_codon").where("type = 'PCG' and stop_codon is not null").join(contigs(spark, base).select(*CONTIG, "sequence"),
        CONTIG).where(F.greatest("pos1", "pos2") <= F.length("sequence"))
    d = d.withColumns({"old1": F.col("pos1"), "old2": F.col("pos2"), "old_stop": F.col("stop_codon")})
    names = ("inward", "inward_stop", "outward", "outward_stop")
    d = d.select("*", *[c.alias(n) for n, c in zip(names, edit.next_stop("sequence", params.FISH_STOPS, REACH), strict=True)])
    return edit.with_stop(d, F.col("outward"), F.col("outward_stop")).select(*CONTIG, "gene", "direction", "old1", "old2", "old_stop", *names, "pos1", "pos2")


_SHORT = "abs(pos2 - pos1) < 60"


@_query(
    f"""WITH {_calls_sql()}, gone AS (SELECT DISTINCT id, path, scaffold, gene, pos1 FROM calls WHERE {_SHORT}), m AS (SELECT c.*, g.gene IS NOT NULL AS g FROM calls c
  LEFT JOIN gone g ON g.id = c.id AND g.path = c.path AND g.scaffold = c.scaffold AND g.gene = c.gene AND g.pos1 = c.pos1)
SELECT id, path, scaffold, type, gene, direction, CASE WHEN g THEN 0 ELSE pos1 END AS pos1, CASE WHEN g THEN 0 ELSE pos2 END AS pos2, CASE WHEN g THEN 0
  ELSE abs(pos2 - pos1) + 1 END AS length FROM m"""
)
def edit_deletes(spark, base):
    """Short calls marked as deleted."""
    d = calls(spark, base).withColumn("length", F.abs(F.col("pos2") - F.col("pos1")) + 1)
    return edit.deleted_calls(d, d.where(_SHORT), [*CONTIG, "gene", "pos1"]).select(*CONTIG, "type", "gene", "direction", "pos1", "pos2", "length")
