"""The rule checks of gene calls as queries over the project tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from organelia.functions import text as X
from organelia.operators.intervals import span_length
from organelia.plans import coverage as C
from organelia.plans import params
from organelia.plans import validate as V
from organelia.plans.engine import _LENGTHS, _SIMILARITY, _STATS, _TRACK, CONTIG, SPAN, _calls_sql, _gap_sql, calls, lengths, track
from organelia.plans.sql_tables import RULES
from organelia.session import cut

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SAMPLE = ["id", "path"]
KEYS, CALL = [*CONTIG, "direction"], ["type", "gene", "pos1", "pos2"]
ORDER = ["scaffold", "pos1", "pos2", "gene", "direction", "type"]


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _long_calls(spark: SparkSession, base: str, *more: str) -> DataFrame:
    d = calls(spark, base, *more).join(lengths(spark, base).select(*CONTIG, "contig_length"), CONTIG)
    return d.withColumn("length", span_length(F.col("pos1"), F.col("pos2"), F.col("contig_length")))


def _pieces(c: DataFrame) -> DataFrame:
    return V.segments(c.select(*KEYS, *CALL, "contig_length").distinct(), "contig_length")


def _weak(spark: SparkSession, base: str, pieces: DataFrame) -> DataFrame:
    """Weak regions by the smoothed depth and error of the tracks."""
    stats = C.statistics(track(spark, base), CONTIG).select(*CONTIG, "position", F.col("mean_depth").alias("depth"), "error_rate")
    return V.weak_regions(stats, pieces, CONTIG, SPAN, bucket=256)


_KEYS = "id, path, scaffold, direction, type, gene, pos1, pos2"
_PIECES = f"""d AS (
  SELECT c.*, CASE WHEN pos1 <= pos2 THEN pos2 - pos1 + 1 ELSE contig_length - pos1 + 1 + pos2 END AS len, contig_length
  FROM calls c JOIN lengths USING (id, path, scaffold)
), p AS (
  SELECT DISTINCT {_KEYS}, pos1 AS s, CASE WHEN pos1 <= pos2 THEN pos2 ELSE greatest(contig_length, pos1) END AS e FROM d
  UNION ALL SELECT DISTINCT {_KEYS}, 1, pos2 FROM d WHERE pos1 > pos2
)"""
_WEAK = f"""weak AS (
  SELECT {", ".join(f"p.{c}" for c in _KEYS.split(", "))}, count(*) AS n_bases,
    count_if(coalesce(t.mean_depth <= 10, false)) / count(*) > 0.05 AS low_coverage, count_if(coalesce(t.error_rate >= 0.05, false)) / count(*) > 0.05 AS high_error
  FROM p JOIN stats t ON p.id = t.id AND p.path = t.path AND p.scaffold = t.scaffold AND t.position BETWEEN p.s AND p.e
  GROUP BY ALL
)"""


@_query(f"WITH {_calls_sql()}, {_LENGTHS}, {_TRACK}, {_STATS}, {_PIECES}, {_WEAK} SELECT {_KEYS}, n_bases, low_coverage, high_error FROM weak")
def weak_coverage(spark, base):
    return _weak(spark, base, _pieces(_long_calls(spark, base))).select(*CONTIG, *SPAN, "n_bases", "low_coverage", "high_error")


_COUNTS = """n AS (SELECT id, path, gene, count(*) AS n FROM (SELECT DISTINCT id, path, scaffold, type, gene, pos1, pos2, direction FROM calls) GROUP BY ALL
), counted AS (
  SELECT s.id, s.path, rgene AS gene, rank, coalesce(n, 0) AS n_calls, coalesce(n, 0) < allowed AS missing, greatest(coalesce(n, 0) - allowed, 0)::BIGINT AS extra
  FROM (SELECT DISTINCT id, path FROM calls) s CROSS JOIN rules LEFT JOIN n ON n.id = s.id AND n.path = s.path AND n.gene = rgene
)"""


def _counted(spark, base):
    c = calls(spark, base)
    return V.count_findings(c, c, params.effective_rules(params.fish()), SAMPLE)


@_query(f"WITH {_calls_sql()}, {RULES}, {_COUNTS} SELECT id, path, gene, n_calls, missing, extra FROM counted")
def rules_count(spark, base):
    return _counted(spark, base).drop("rank")


_AB = ", ".join(f"a.{c}" for c in _KEYS.split(", "))
_WARNED = f"""{_calls_sql("start_codon, stop_codon, translation, refhits")}, {RULES}, {_LENGTHS}, {_TRACK}, {_STATS}, {_PIECES}, {_WEAK}, {_COUNTS}
, o AS (
  SELECT {_AB}, b.pos1 AS q1, b.pos2 AS q2, sum(least(a.e, b.e) - greatest(a.s, b.s) + 1) AS ov FROM p a JOIN p b USING (id, path, scaffold, direction)
  WHERE a.s <= b.e AND b.s <= a.e AND (a.type, a.gene, a.pos1, a.pos2) <> (b.type, b.gene, b.pos1, b.pos2)
  GROUP BY {_AB}, b.type, b.gene, b.pos1, b.pos2
), x AS (
  SELECT {_KEYS}, max(ov) AS a, max(CASE WHEN CASE direction WHEN '+' THEN pos1 ELSE pos2 END BETWEEN q1 AND q2 THEN ov END) AS st,
    max(CASE WHEN CASE direction WHEN '+' THEN pos2 ELSE pos1 END BETWEEN q1 AND q2 THEN ov END) AS sp FROM o GROUP BY ALL
), w AS (
  SELECT d.*, a, st, sp, r.*, coalesce(a / len > 0.25, false) AS over_, coalesce(low_coverage, false) AS low_, coalesce(high_error, false) AS high_, coalesce(n > allowed,
    false) AS dup,
    rank() OVER (PARTITION BY d.id, d.path ORDER BY scaffold, pos1, pos2, gene, direction, type) = 1 AS f,
    rank() OVER (PARTITION BY d.id, d.path ORDER BY scaffold DESC, pos1 DESC, pos2 DESC, gene DESC, direction DESC, type DESC) = 1 AS l
  FROM d LEFT JOIN x USING ({_KEYS}) LEFT JOIN rules r ON rgene = gene LEFT JOIN weak USING ({_KEYS}) LEFT JOIN n USING (id, path, gene)
), h AS (SELECT *, {_SIMILARITY} AS sims, {_gap_sql("gap_leading")} AS gl, {_gap_sql("gap_trailing")} AS gt FROM w
), warned AS (
  SELECT id, path, scaffold, type, gene, pos1, pos2, direction, start_codon, stop_codon, len AS length, concat_ws('; ',
    CASE WHEN dup THEN 'possible duplicate' END,
    CASE WHEN over_ THEN 'exceeds max overlap' END,
    CASE WHEN NOT over_ AND NOT (CASE direction WHEN '+' THEN f ELSE l END) AND st > overlap_start THEN 'exceeds max start overlap' END,
    CASE WHEN NOT over_ AND NOT (CASE direction WHEN '+' THEN l ELSE f END) AND sp > 1 AND NOT overlap_stop THEN 'exceeds max stop overlap' END,
    CASE WHEN len > max_len THEN 'exceeds max length' END,
    CASE WHEN len < min_len THEN 'below min length' END,
    CASE WHEN low_ THEN 'low coverage region' END,
    CASE WHEN high_ THEN 'high error region' END,
    CASE WHEN type = 'PCG' AND translation LIKE '%*%' THEN 'internal stop codon' END,
    CASE WHEN type = 'PCG' AND NOT list_contains(stops, stop_codon) THEN 'non-standard stop codon' END,
    CASE WHEN type = 'PCG' AND NOT list_contains(starts, start_codon) THEN 'non-standard start codon' END,
    CASE WHEN type = 'PCG' AND len(list_filter(sims, lambda z: z >= 90)) = 0 THEN 'low reference similarity' END,
    CASE WHEN type = 'PCG' AND len(list_filter(gl, lambda z: z = 0)) = 0 THEN 'check reference start alignment' END,
    CASE WHEN type = 'PCG' AND len(list_filter(gt, lambda z: z = 0)) = 0 THEN 'check reference stop alignment' END) AS warnings
  FROM h
)"""


def _warned(spark: SparkSession, base: str, own: DataFrame | None = None) -> DataFrame:
    # What the checks between calls need is narrow, is read five times, and so is written once.
    narrow = cut(_long_calls(spark, base))
    c = _long_calls(spark, base, "start_codon", "stop_codon", "translation", "refhits").withColumn("hits", X.hit_rows(F.col("refhits")))
    rules = params.effective_rules(params.fish())
    of_call = V.with_ends(V.with_duplicates(narrow, calls(spark, base), rules, SAMPLE), SAMPLE, ORDER).select(*CONTIG, *SPAN, "duplicate", "is_first", "is_last")
    of_call = of_call.join(_weak(spark, base, _pieces(narrow)).drop("n_bases"), [*CONTIG, *SPAN], "left")
    worst = V.worst_overlaps_of(narrow, KEYS, CALL, "contig_length")
    return V.call_warnings(c.join(of_call, [*CONTIG, *SPAN]), worst, params.rules_frame(spark, params.fish()), KEYS, CALL, 0.25, 90, own, ["id"])


@_query(f"WITH {_WARNED} SELECT id, path, scaffold, type, gene, pos1, pos2, direction, start_codon, stop_codon, length, warnings FROM warned")
def rules_warnings(spark, base):
    d = _warned(spark, base)
    return d.select(*CONTIG, *SPAN, "start_codon", "stop_codon", "length", F.array_join("warnings", "; ").alias("warnings"))


@_query(
    f"""WITH {_WARNED}, m AS (SELECT id, path, string_agg(CASE WHEN missing THEN gene END, '; ' ORDER BY rank) AS missing, sum(extra)::BIGINT AS extra FROM counted
  GROUP BY ALL)
SELECT id, path, count(DISTINCT scaffold) AS scaffolds, string_agg(gene, '|' ORDER BY scaffold, pos1, pos2, gene) AS structure,
 count_if(type = 'PCG')::BIGINT AS pcg_count, count_if(type = 'tRNA')::BIGINT AS trna_count, count_if(type = 'rRNA')::BIGINT AS rrna_count,
 count_if(warnings <> '')::BIGINT AS warned, any_value(m.missing) AS missing, any_value(m.extra) AS extra FROM warned JOIN m USING (id, path) GROUP BY id, path"""
)
def sample_summary(spark, base):
    return V.sample_summary(_warned(spark, base), SAMPLE, ["scaffold"], ["scaffold", "pos1", "pos2"], _counted(spark, base))
