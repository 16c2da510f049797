"""The engine's own operators as queries over the project tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from organelia.functions import align
from organelia.functions import seq as S
from organelia.functions import text as X
from organelia.operators import dml
from organelia.operators import windows as W
from organelia.operators.intervals import flip, flip_strand, span_length
from organelia.plans import annotate as A
from organelia.plans import coverage as C
from organelia.plans import curate, params
from organelia.plans import validate as V
from organelia.plans.sql_tables import PRODUCT_SQL, RULES as _RULES, amino_sql
from organelia.session import table
from organelia.sinks import files as K
from organelia.streaming.ingest import last_values, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CONTIG = ["id", "path", "scaffold"]
SPAN = ["type", "gene", "pos1", "pos2", "direction"]
CODE = 2


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# What most queries start from: calls that are not deleted, without copies; one sequence per contig.
def calls(spark: SparkSession, base: str, *more: str) -> DataFrame:
    d = table(spark, base, "annotations").where("pos1 > 0 and pos2 > 0 and direction is not null")
    return d.select(*CONTIG, *SPAN, *more).distinct()


def contigs(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "assemblies").where("sequence is not null")
    return d.groupBy(*CONTIG).agg(F.min("topology").alias("topology"), F.upper(F.min("sequence")).alias("sequence"))


def lengths(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "assemblies").where("sequence is not null")
    return d.groupBy(*CONTIG).agg(F.min("topology").alias("topology"), F.min(F.length("sequence")).cast("long").alias("contig_length"))


def _calls_sql(more: str = "") -> str:
    return f"calls AS (SELECT DISTINCT id, path, scaffold, type, gene, pos1, pos2, direction{', ' + more if more else ''} FROM annotations WHERE pos1 > 0 AND pos2 > 0 AND direction IS NOT NULL)"


_CONTIGS = "contigs AS (SELECT id, path, scaffold, min(topology) AS topology, upper(min(sequence)) AS sequence FROM assemblies WHERE sequence IS NOT NULL GROUP BY ALL)"
_LENGTHS = "lengths AS (SELECT id, path, scaffold, min(topology) AS topology, min(length(sequence))::BIGINT AS contig_length FROM assemblies WHERE sequence IS NOT NULL GROUP BY ALL)"


def _revcomp_sql(s: str) -> str:
    return f"reverse(translate({s}, '{S.BASES}', '{S.COMPLEMENTS}'))"


_OVER = "CASE WHEN pos1 <= pos2 THEN substr(sequence, pos1, pos2 - pos1 + 1) ELSE substr(sequence, pos1) || substr(sequence, 1, pos2) END"
_CODING = f"CASE WHEN direction = '-' THEN {_revcomp_sql(_OVER)} ELSE {_OVER} END"


# Sequences ---------------------------------------------------------------------------------------
# What is asked of a sequence is computed where the row is read; only the answers are made distinct.

_SEQS = "seqs AS (SELECT id, path, scaffold, topology, upper(sequence) AS sequence FROM assemblies WHERE sequence IS NOT NULL)"


def sequences(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "assemblies").where("sequence is not null").select(*CONTIG, "topology", F.upper("sequence").alias("sequence"))


@query(f"WITH {_SEQS} SELECT DISTINCT id, path, scaffold, md5({_revcomp_sql('sequence')}) AS rc_md5, length(sequence)::INT AS bases FROM seqs")
def seq_revcomp(spark, base):
    return sequences(spark, base).select(*CONTIG, F.md5(S.reverse_complement(F.col("sequence"))).alias("rc_md5"), F.length("sequence").alias("bases")).distinct()


@query(
    f"""WITH {_SEQS} SELECT DISTINCT id, path, scaffold, (length(sequence) - length(translate(sequence, 'GC', '')))::INT AS gc,
  (length(sequence) - length(translate(sequence, 'ACGT', '')))::INT AS acgt,
(length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence) AS gc_fraction FROM seqs"""
)
def seq_gc(spark, base):
    s = F.col("sequence")
    return sequences(spark, base).select(*CONTIG, S.count_bases(s, "GC").alias("gc"), S.count_bases(s, "ACGT").alias("acgt"),
        S.gc_fraction(s).alias("gc_fraction")).distinct()


@query(f"WITH {_SEQS}, d AS (SELECT DISTINCT md5(sequence) AS h, id || '.' || path || '.' || scaffold AS key FROM seqs) SELECT min(key) AS kept, count(*) AS n FROM d GROUP BY h")
def seq_dedup_first(spark, base):
    key = F.concat_ws(".", *[F.col(c).cast("string") for c in CONTIG])
    return sequences(spark, base).select(F.md5("sequence").alias("h"), key.alias("key")).distinct().groupBy("h").agg(F.min("key").alias("kept"),
        F.count("*").alias("n")).select("kept", "n")


@query(f"WITH {_SEQS} SELECT DISTINCT id, md5('>' || id || ' [topology=' || topology || '] path ' || path || chr(10) || regexp_replace(sequence, '(.{{80}})', '\\1' || chr(10), 'g')) AS record_md5 FROM seqs")
def fasta_records(spark, base):
    body = F.regexp_replace("sequence", "(.{80})", "$1\n")
    return sequences(spark, base).select("id", F.md5(K.fasta_lines(X.glue("{id} [topology={topology}] path {path}"), body)).alias("record_md5")).distinct()


def _proteins(spark, base):
    d = calls(spark, base).where("type = 'PCG'").join(contigs(spark, base).select(*CONTIG, "sequence"), CONTIG)
    return d.where(F.greatest("pos1", "pos2") <= F.length("sequence"))


_PROTEINS = f"{_calls_sql()}, {_CONTIGS}, pcg AS (SELECT id, path, scaffold, gene, pos1, pos2, direction, {_CODING} AS coding FROM calls JOIN contigs USING (id, path, scaffold) WHERE type = 'PCG' AND greatest(pos1, pos2) <= length(sequence))"


@query(
    f"""WITH {_PROTEINS}, s AS (SELECT *, CASE WHEN length(coding) % 3 = 0 THEN 3 ELSE length(coding) % 3 END AS k FROM pcg)
SELECT id, path, scaffold, gene, pos1, pos2, direction, length(coding)::BIGINT AS length, substr(coding, 1, 3) AS start_codon, substr(coding,
  length(coding) - k + 1) AS stop_codon,
 array_to_string(list_transform(range(0, (length(coding) - k) // 3), lambda i: {amino_sql('substr(coding, (3 * i + 1)::INT, 3)')}), '') AS translation FROM s"""
)
def seq_translate(spark, base):
    d = A.with_codons(_proteins(spark, base), CODE)
    return d.select(*CONTIG, "gene", "pos1", "pos2", "direction", F.col("length").cast("long").alias("length"), "start_codon", "stop_codon", "translation")


@query(
    f"""WITH {_PROTEINS}, c AS (SELECT substr(coding, (3 * i + 1)::BIGINT, 3) AS codon FROM (SELECT coding, unnest(range(0, (length(coding) + 2) // 3)) AS i FROM pcg))
SELECT codon, count(*) AS n FROM c WHERE length(codon) = 3 GROUP BY codon"""
)
def seq_codon_usage(spark, base):
    coding = S.stranded(S.circular_subseq(F.col("sequence"), F.col("pos1"), F.col("pos2")), F.col("direction"))
    return _proteins(spark, base).select(F.explode(S.codons(coding)).alias("codon")).where("length(codon) = 3").groupBy("codon").agg(F.count("*").alias("n"))


# The distinct proteins of each gene are its reference database.
def _proteins_of_genes(spark, base):
    return table(spark, base, "annotations").where("type = 'PCG' and translation is not null and translation <> ''").select("gene", "translation").distinct()


#: ``max_blast_hits`` where a parameter set names none.
MAX_HITS = 100


@query(None)
def protein_similarity(spark, base):
    p = _proteins_of_genes(spark, base)
    pairs = p.withColumnRenamed("translation", "query").join(p.withColumnRenamed("translation", "target"), "gene")
    top = W.top_per_group(align.score_pairs(pairs), ["gene", "query"], [F.desc("similarity"), F.col("target")], MAX_HITS)
    return top.select("gene", F.md5("query").alias("query_md5"), F.md5("target").alias("target_md5"), "pctid", "similarity", "gap_leading", "gap_trailing")


@query(None)
def curate_boundaries(spark, base):
    d = calls(spark, base, "stop_codon").where("type = 'PCG' and stop_codon is not null").join(contigs(spark, base),
        CONTIG).where("greatest(pos1, pos2) <= length(sequence)")
    refs = _proteins_of_genes(spark, base).groupBy("gene").agg(F.transform(F.array_sort(F.collect_set("translation")),
        lambda t: F.struct(F.md5(t).alias("acc"), t.alias("target"))).alias("references"))
    refs = refs.select("gene", curate.packed_references(F.col("references")).alias("references"))
    d = d.join(F.broadcast(refs), "gene").join(F.broadcast(_rules(spark).select("gene", "start_codons", "stop_codons")), "gene")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in (*CONTIG, "gene", "pos1", "pos2", "direction", "stop_codon")])
    refined = curate.refined_calls(d.withColumns({"row_id": key, "notes": F.lit(None).cast("string")}), CODE, params.fish()["hit_threshold"], MAX_HITS, every_hit=False)
    return refined.select("row_id", "pos1", "pos2", "length", "start_codon", "stop_codon", "notes")


@query(None)
def gene_alignments(spark, base):
    """The proteins of each gene aligned with each other, in cluster order."""
    d = table(spark, base, "annotations").where("type = 'PCG' and pos1 > 0").select("id", "gene", "translation").distinct()
    return align.alignment_report(d, "gene", "id", "translation").select("group", "name", "ord", F.md5("aligned").alias("aligned_md5"), "mean_distance")


# Per-base tracks ---------------------------------------------------------------------------------


def track(spark, base):
    d = table(spark, base, "assemblies").where("depth is not null and sequence is not null").groupBy(*CONTIG).agg(*[F.min(c).alias(c) for c in ("topology", "depth",
        "errors", "sequence")])
    # Merge joins: Spark estimates a row a base by the packed texts, which are far smaller, and a broadcast would bring every base to the driver.
    errors = C.unpack_track(d, CONTIG, "errors", "error_rate").hint("merge")
    counts = C.unpack_track(d, CONTIG, "depth", "depth").join(errors, [*CONTIG, "position"], "left")
    called = d.select(*CONTIG, "topology", F.length("sequence").cast("long").alias("length"), F.posexplode(S.bases(F.upper("sequence"))).alias("p",
        "call")).withColumn("position", (F.col("p") + 1).cast("long")).drop("p")
    return called.join(counts.hint("merge"), [*CONTIG, "position"], "left").withColumn("correct", F.col("depth"))


_TRACK = """src AS (SELECT id, path, scaffold, min(topology) AS topology, string_split(trim(min(depth)), ' ') AS d, string_split(trim(min(errors)), ' ') AS e,
  upper(min(sequence)) AS s FROM assemblies WHERE depth IS NOT NULL AND sequence IS NOT NULL GROUP BY ALL
), pos AS (SELECT *, unnest(range(1, length(s) + 1))::BIGINT AS position FROM src
), track AS (SELECT id, path, scaffold, topology, length(s)::BIGINT AS length, position, s[position] AS call, try_cast(d[position] AS DOUBLE) AS depth,
  try_cast(e[position] AS DOUBLE) AS error_rate FROM pos)"""
_BY = "PARTITION BY id, path, scaffold"
_FIVE = f"({_BY} ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f"WITH {_TRACK} SELECT id, path, scaffold, position, call, depth, error_rate FROM track")
def coverage_track(spark, base):
    return track(spark, base).select(*CONTIG, "position", "call", "depth", "error_rate")


_WIDE = f"({_BY} ORDER BY position ROWS BETWEEN 99 PRECEDING AND 100 FOLLOWING)"
_STATS = f"""med AS (SELECT *, median(depth) OVER ({_BY}) AS m FROM track
), mad AS (SELECT *, median(abs(depth - m)) OVER ({_BY}) AS a FROM med
), smooth AS (SELECT *, coalesce(abs(depth - m) > 8 * a, false) AS mean_depth_mask, round_even(avg(depth) OVER {_FIVE}, 2) AS mean_depth,
  round_even(avg(error_rate) OVER {_FIVE}, 2) AS smooth_error,
  CASE WHEN count(*) OVER {_WIDE} = 200 THEN sum((call IN ('G', 'C'))::INT) OVER {_WIDE} END AS bases FROM mad
), share AS (
  -- Halves of a hundredth go to the even one, on whole numbers.
  SELECT *, CASE WHEN bases % 2 = 0 THEN bases // 2 ELSE 2 * ((bases + 1) // 4) END / 100 AS gc FROM smooth
), stats AS (SELECT id, path, scaffold, position, call, depth, smooth_error AS error_rate, mean_depth, gc, mean_depth_mask, coalesce(max(coalesce(smooth_error > 0.05,
  false)) OVER {_FIVE}, false) AS error_rate_mask FROM share)"""


@query(f"WITH {_TRACK}, {_STATS} SELECT id, path, scaffold, position, mean_depth, error_rate, gc, mean_depth_mask, error_rate_mask FROM stats")
def coverage_statistics(spark, base):
    return C.statistics(track(spark, base), CONTIG).select(*CONTIG, "position", "mean_depth", "error_rate", "gc", "mean_depth_mask", "error_rate_mask")


@query(
    f"""WITH {_TRACK}, {_STATS}, long AS (SELECT id, path, scaffold, 'MeanDepth' AS stat, mean_depth AS val, mean_depth_mask AS mask FROM stats UNION ALL SELECT id, path,
  scaffold, 'ErrorRate', error_rate, error_rate_mask FROM stats UNION ALL SELECT id, path, scaffold, 'GC', gc, false FROM stats)
SELECT id, path, scaffold, stat, count(*) AS n, count_if(mask)::BIGINT AS n_masked FROM long WHERE val IS NOT NULL GROUP BY ALL"""
)
def coverage_long(spark, base):
    return C.long_form(C.statistics(track(spark, base), CONTIG), CONTIG).groupBy(*CONTIG, "stat").agg(F.count("*").alias("n"), F.count_if("mask").alias("n_masked"))


@query(
    f"""WITH {_TRACK}, moved AS (SELECT id, path, scaffold, CASE WHEN topology = 'circular' AND position > length - 50 THEN position - (length - 50)
  ELSE position END AS to_pos, position, call, depth, error_rate FROM track)
SELECT id, path, scaffold, to_pos AS position, arg_min(call, position) AS call, sum(depth) AS depth, count(*) AS n FROM moved GROUP BY id, path, scaffold, to_pos"""
)
def coverage_fold(spark, base):
    t = track(spark, base)
    c = t.select(*CONTIG, "topology", (F.col("length") - 50).alias("length")).distinct()
    folded = C.fold_circular(t.drop("topology", "length"), c, CONTIG)
    n = t.select(*CONTIG, F.when((F.col("topology") == "circular") & (F.col("position") > F.col("length") - 50),
        F.col("position") - F.col("length") + 50).otherwise(F.col("position")).alias("position")).groupBy(*CONTIG, "position").agg(F.count("*").alias("n"))
    return folded.join(n, [*CONTIG, "position"]).select(*CONTIG, "position", "call", "depth", "n")


@query(
    """WITH src AS (SELECT id, path, scaffold, max(length(sequence))::BIGINT AS n, string_split(trim(min(depth)), ' ') AS d FROM assemblies WHERE sequence IS NOT NULL
  GROUP BY ALL)
SELECT id, path, scaffold, n AS n_positions, n - len(list_filter(coalesce(d[1:n], []), lambda x: coalesce(try_cast(x AS DOUBLE), 0) <> 0)) AS n_zero,
  coalesce(list_sum(list_transform(d[1:n], lambda x: try_cast(x AS DOUBLE))), 0)::DOUBLE AS total FROM src"""
)
def coverage_densify(spark, base):
    """A depth for every base of every contig, 0 where its track is missing or has no number; shown as sums over the contig."""
    d = table(spark, base, "assemblies").where("sequence is not null").groupBy(*CONTIG).agg(F.max(F.length("sequence")).cast("long").alias("length"),
        F.min("depth").alias("depth"))
    return W.densify(C.unpack_track(d, CONTIG, "depth", "depth"), d, CONTIG, "position", "length", {"depth": 0.0}).groupBy(*CONTIG).agg(F.count("*").alias("n_positions"),
        F.count_if(F.col("depth") == 0).alias("n_zero"), F.sum("depth").alias("total"))


@query(f"WITH {_TRACK} SELECT id, path, scaffold, md5(string_agg(depth::BIGINT::VARCHAR, ' ' ORDER BY position)) AS packed_md5 FROM track GROUP BY ALL")
def coverage_pack(spark, base):
    t = track(spark, base).withColumn("d", F.col("depth").cast("long"))
    return C.pack_track(t, CONTIG, "d", "packed").select(*CONTIG, F.md5("packed").alias("packed_md5"))


@query(
    f"""WITH {_TRACK}, n AS (SELECT *, row_number() OVER ({_BY} ORDER BY position) AS r FROM track), i AS (SELECT id, path, scaffold, position,
  r - row_number() OVER ({_BY} ORDER BY position) AS island FROM n WHERE depth >= 20),
runs AS (SELECT id, path, scaffold, min(position) AS run_start, max(position) AS run_end, count(*) AS run_length FROM i GROUP BY id, path, scaffold, island)
SELECT id, path, scaffold, run_start, run_end, run_length FROM (SELECT *, row_number() OVER ({_BY} ORDER BY run_length DESC, run_start) AS k FROM runs) WHERE k = 1"""
)
def islands_longest(spark, base):
    return W.longest_run(W.islands(track(spark, base), CONTIG, "position", F.col("depth") >= 20), CONTIG)


@query(
    f"""WITH {_TRACK}, {_STATS}, e AS (SELECT id, path, scaffold, (CASE WHEN mean_depth_mask THEN '#' ELSE '' END) || round(mean_depth * 100)::BIGINT AS v,
  mean_depth_mask AS k FROM stats WHERE mean_depth IS NOT NULL)
SELECT id, path, scaffold, sum(ltrim(v, '#')::BIGINT)::BIGINT AS total, count_if(v LIKE '#%')::BIGINT AS n_masked FROM e GROUP BY ALL"""
)
def mask_codec(spark, base):
    s = C.statistics(track(spark, base), CONTIG).where("mean_depth is not null")
    value, mask = X.unmasked(X.masked(F.round(F.col("mean_depth") * 100).cast("long"), F.col("mean_depth_mask")))
    return s.select(*CONTIG, value.cast("long").alias("v"), mask.alias("k")).groupBy(*CONTIG).agg(F.sum("v").alias("total"), F.count_if("k").alias("n_masked"))


# Intervals ---------------------------------------------------------------------------------------


@query(
    f"""WITH {_calls_sql()}, {_LENGTHS}, p AS (
  SELECT c.*, pos1 AS s, CASE WHEN pos1 <= pos2 THEN pos2 ELSE greatest(coalesce(contig_length, pos1), pos1) END AS e FROM calls c LEFT JOIN lengths USING (id, path,
    scaffold)
  UNION ALL SELECT c.*, 1, pos2 FROM calls c WHERE pos1 > pos2)
SELECT a.id, a.path, a.scaffold, a.direction, a.type, a.gene, a.pos1, a.pos2, b.type AS r_type, b.gene AS r_gene, b.pos1 AS r_pos1, b.pos2 AS r_pos2, sum(least(a.e,
  b.e) - greatest(a.s, b.s) + 1)::BIGINT AS overlap
FROM p a JOIN p b USING (id, path, scaffold, direction)
WHERE a.s <= b.e AND b.s <= a.e AND (a.type, a.gene, a.pos1, a.pos2) IS DISTINCT FROM (b.type, b.gene, b.pos1, b.pos2)
GROUP BY a.id, a.path, a.scaffold, a.direction, a.type, a.gene, a.pos1, a.pos2, b.type, b.gene, b.pos1, b.pos2"""
)
def overlap_pairs(spark, base):
    c = calls(spark, base).join(lengths(spark, base).select(*CONTIG, "contig_length"), CONTIG, "left")
    return V.overlaps(V.segments(c, "contig_length"), [*CONTIG, "direction"], ["type", "gene", "pos1", "pos2"])


@query(
    f"""WITH {_calls_sql()}, n AS (SELECT *, lag(type) OVER w AS bt, lag(pos2) OVER w AS b2, lead(type) OVER w AS aty, lead(pos1) OVER w AS a1, CASE gene
  WHEN 'rrnL' THEN 1850 WHEN 'rrnS' THEN 1000 END AS lim FROM calls WINDOW w AS (PARTITION BY id, path, scaffold ORDER BY pos1, pos2, gene, direction, type)),
f AS (SELECT *, CASE WHEN type = 'rRNA' AND bt = 'tRNA' AND b2 + 1 <> pos1 AND pos2 - b2 <= lim THEN b2 + 1 END AS n1 FROM n),
g AS (SELECT *, coalesce(n1, pos1) AS q1 FROM f),
h AS (SELECT *, CASE WHEN type = 'rRNA' AND aty = 'tRNA' AND a1 - 1 <> pos2 AND a1 - q1 <= lim THEN a1 - 1 END AS n2 FROM g)
SELECT id, path, scaffold, gene, direction, pos1 AS old1, pos2 AS old2, q1 AS new1, coalesce(n2, pos2) AS new2,
 nullif(concat_ws('; ', CASE WHEN n1 IS NOT NULL THEN 'Applied punctuation model - moved pos1 by ' || (n1 - pos1) || ' bp' END, CASE
   WHEN n2 IS NOT NULL THEN 'Applied punctuation model - moved pos2 by ' || (n2 - pos2) || ' bp' END), '') AS notes
FROM h WHERE type = 'rRNA'"""
)
def punctuation_snap(spark, base):
    limit = F.when(F.col("gene") == "rrnL", 1850).when(F.col("gene") == "rrnS", 1000).cast("long")
    d = calls(spark, base).withColumns({"old1": F.col("pos1"), "old2": F.col("pos2"), "length": F.lit(0).cast("long"), "notes": F.lit(None).cast("string"),
        "max_len": limit})
    return curate.punctuated(d, CONTIG).where("type = 'rRNA'").select(*CONTIG, "gene", "direction", "old1", "old2", F.col("pos1").alias("new1"),
        F.col("pos2").alias("new2"), "notes")


@query(
    f"""WITH {_calls_sql()}, {_LENGTHS}, j AS (SELECT c.*, contig_length FROM calls c JOIN lengths USING (id, path, scaffold)), n AS (SELECT *, lag(pos2) OVER w AS b2,
  lead(pos1) OVER w AS a1 FROM j WINDOW w AS (PARTITION BY id, path, scaffold ORDER BY pos1, pos2, replace(gene, 'ctrl', 'OH'), direction, type))
SELECT id, path, scaffold, direction, pos1 AS old1, pos2 AS old2, coalesce(b2 + 1, 1) AS new1, coalesce(a1 - 1, contig_length) AS new2, abs(coalesce(a1 - 1,
  contig_length) - coalesce(b2 + 1, 1)) + 1 AS length FROM n WHERE gene = 'ctrl'"""
)
def control_region_extend(spark, base):
    d = calls(spark, base).join(lengths(spark, base).select(*CONTIG, "contig_length"), CONTIG).withColumns({"old1": F.col("pos1"), "old2": F.col("pos2"),
        "length": F.lit(0).cast("long"), "gene": F.when(F.col("gene") == "ctrl", "OH").otherwise(F.col("gene"))})
    return A.control_regions(d, CONTIG, "contig_length").where("gene = 'ctrl'").select(*CONTIG, "direction", "old1", "old2", F.col("pos1").alias("new1"),
        F.col("pos2").alias("new2"), "length")


@query(
    f"""WITH {_calls_sql()}, {_LENGTHS}, c AS (SELECT c.*, contig_length AS n FROM calls c JOIN lengths USING (id, path, scaffold) WHERE topology = 'circular'),
s AS (SELECT id, path, scaffold, arg_min(struct_pack(p1 := pos1, p2 := pos2, d := direction), (pos1, pos2, direction)) AS s FROM c WHERE gene = 'trnF' GROUP BY ALL),
j AS (SELECT c.*, s.s.p1 AS c1, s.s.p2 AS c2, s.s.d AS cd FROM c LEFT JOIN s USING (id, path, scaffold))
SELECT id, path, scaffold, type, gene, pos1 AS old1, pos2 AS old2,
 CASE WHEN c1 IS NULL THEN pos1 WHEN cd = '-' THEN ((c2 - pos2) % n + n) % n + 1 ELSE ((pos1 - c1) % n + n) % n + 1 END AS pos1,
 CASE WHEN c1 IS NULL THEN pos2 WHEN cd = '-' THEN ((c2 - pos1) % n + n) % n + 1 ELSE ((pos2 - c1) % n + n) % n + 1 END AS pos2,
 CASE WHEN cd = '-' THEN CASE direction WHEN '+' THEN '-' ELSE '+' END ELSE direction END AS direction FROM j"""
)
def rotate_calls(spark, base):
    d = calls(spark, base).join(lengths(spark, base).where("topology = 'circular'").select(*CONTIG, "contig_length"), CONTIG).withColumns({"old1": F.col("pos1"),
        "old2": F.col("pos2")})
    return A.rotated_calls(d, A.start_points(d, CONTIG, "trnF"), CONTIG, "contig_length").select(*CONTIG, "type", "gene", "old1", "old2", "pos1", "pos2", "direction")


@query(
    f"""WITH {_calls_sql()}, {_CONTIGS}, s AS (SELECT id, path, scaffold, arg_min(struct_pack(p1 := pos1, p2 := pos2, d := direction), (pos1, pos2, direction)) AS s
  FROM calls WHERE gene = 'trnF' GROUP BY ALL)
SELECT id, path, scaffold, md5(CASE WHEN s.s.d = '-' THEN {_revcomp_sql('substr(sequence, s.s.p2 + 1) || substr(sequence, 1, s.s.p2)')} ELSE substr(sequence,
  s.s.p1) || substr(sequence, 1, s.s.p1 - 1) END) AS rotated_md5
FROM contigs JOIN s USING (id, path, scaffold) WHERE topology = 'circular' AND greatest(s.s.p1, s.s.p2) <= length(sequence)"""
)
def rotate_sequence(spark, base):
    d = contigs(spark, base).where("topology = 'circular'").join(A.start_points(calls(spark, base), CONTIG, "trnF"), CONTIG).where(F.greatest("cut1",
        "cut2") <= F.length("sequence"))
    return d.select(*CONTIG, F.md5(A.rotated_sequence(F.col("sequence"), F.col("cut1"), F.col("cut2"), F.col("cut_strand"))).alias("rotated_md5"))


@query(
    f"""WITH {_calls_sql()}, {_LENGTHS}, r AS (SELECT id, path, scaffold FROM calls WHERE type = 'rRNA' GROUP BY ALL HAVING bool_and(direction = '-'))
SELECT c.id, c.path, c.scaffold, type, gene, contig_length - pos2 + 1 AS pos1, contig_length - pos1 + 1 AS pos2, CASE direction WHEN '+' THEN '-'
  ELSE '+' END AS direction FROM calls c JOIN r USING (id, path, scaffold) JOIN lengths USING (id, path, scaffold)"""
)
def flip_contigs(spark, base):
    c = calls(spark, base)
    back = curate.reversed_contigs(c, CONTIG)
    d = c.join(lengths(spark, base).select(*CONTIG, "contig_length"), CONTIG).join(back, CONTIG, "left_semi")
    return curate.flipped_calls(d, back, CONTIG, "contig_length").select(*CONTIG, "type", "gene", "pos1", "pos2", "direction")


@query(
    f"""WITH {_calls_sql()}, {_LENGTHS} SELECT c.id, c.path, c.scaffold, gene, pos1, pos2, direction, CASE WHEN pos1 <= pos2 THEN pos2 - pos1 + 1
  ELSE contig_length - pos1 + 1 + pos2 END AS length, contig_length - pos2 + 1 AS flipped1
FROM calls c JOIN lengths USING (id, path, scaffold)"""
)
def call_lengths(spark, base):
    d = calls(spark, base).join(lengths(spark, base), CONTIG)
    return d.select(*CONTIG, "gene", "pos1", "pos2", "direction", span_length(F.col("pos1"), F.col("pos2"), F.col("contig_length")).alias("length"), flip(F.col("pos1"),
        F.col("pos2"), F.col("contig_length"))[0].alias("flipped1"))


@query(
    f"""WITH {_calls_sql()}, k AS (SELECT id, path, scaffold, min(pos1) AS cut FROM calls WHERE gene = 'cox1' GROUP BY ALL)
SELECT k.id, k.path, k.scaffold, k.cut, count_if(c.pos1 < k.cut AND c.pos2 >= k.cut)::BIGINT AS n_split FROM k LEFT JOIN calls c USING (id, path, scaffold) GROUP BY k.id,
  k.path, k.scaffold, k.cut"""
)
def linearize_guard(spark, base):
    c = calls(spark, base)
    return V.cut_guard(c, c.where("gene = 'cox1'").groupBy(*CONTIG).agg(F.min("pos1").alias("cut")), CONTIG)


def _rules(spark):
    return params.rules_frame(spark, params.fish())


@query(
    f"""WITH {_calls_sql('stop_codon')}, {_RULES}, r AS (SELECT c.*, starts, stops, overlap_stop FROM calls c LEFT JOIN rules ON rgene = gene),
e AS (SELECT *, CASE direction WHEN '+' THEN pos2 - length(stop_codon) + 1 ELSE pos1 END AS s, CASE direction WHEN '+' THEN pos2
  ELSE pos1 + length(stop_codon) - 1 END AS e FROM r WHERE type = 'PCG' AND stop_codon IS NOT NULL AND NOT coalesce(overlap_stop, false)),
h AS (SELECT a.id, a.path, a.scaffold, a.gene, a.pos1, a.pos2, a.direction, a.stop_codon, count(*) AS k, max(least(a.e, b.pos2) - greatest(a.s, b.pos1) + 1) AS cut
  FROM e a JOIN r b ON a.id = b.id AND a.path = b.path AND a.scaffold = b.scaffold AND a.direction = b.direction
  AND CASE a.direction WHEN '+' THEN b.pos1 ELSE b.pos2 END BETWEEN a.s AND a.e AND (a.pos1, a.pos2, a.gene) <> (b.pos1, b.pos2, b.gene) GROUP BY ALL)
SELECT id, path, scaffold, gene, pos1 AS old1, pos2 AS old2, direction, substr(stop_codon, 1, length(stop_codon) - cut) AS stop_codon,
  'stop codon trimmed by ' || cut || ' bp' AS notes
FROM h JOIN rules ON rgene = gene WHERE k = 1 AND length(stop_codon) > cut AND list_contains(stops, substr(stop_codon, 1, length(stop_codon) - cut))"""
)
def stop_trim(spark, base):
    d = calls(spark, base, "stop_codon").join(F.broadcast(_rules(spark).select("gene", "stop_codons", "overlap_stop")), "gene", "left")
    d = d.withColumns({"old1": F.col("pos1"), "old2": F.col("pos2"), "length": F.lit(0).cast("long"), "notes": F.lit(None).cast("string")})
    return curate.trimmed_stops(d, CONTIG).where("notes is not null").select(*CONTIG, "gene", "old1", "old2", "direction", "stop_codon", "notes")


# Hits --------------------------------------------------------------------------------------------

_SIMILARITY = (
    "CASE WHEN json_type(refhits, '$.similarity') = 'ARRAY' THEN from_json(json_extract(refhits, '$.similarity'), '[\"DOUBLE\"]') "
    "WHEN refhits IS NOT NULL THEN [json_extract_string(refhits, '$.similarity')::DOUBLE] ELSE [] END"
)


def _gap_sql(f: str) -> str:
    # A scalar stands for all rows, so one row of it is enough.
    return (
        f"CASE WHEN json_type(refhits, '$.{f}') = 'ARRAY' THEN from_json(json_extract(refhits, '$.{f}'), '[\"INTEGER\"]') "
        f"WHEN refhits IS NOT NULL THEN [json_extract_string(refhits, '$.{f}')::INTEGER] ELSE [] END"
    )


@query(
    f"""WITH h AS (SELECT DISTINCT id, path, scaffold, gene, pos1, {_SIMILARITY} AS sims, {_gap_sql('gap_leading')} AS gl FROM annotations WHERE refhits IS NOT NULL)
SELECT id, path, scaffold, gene, pos1, max(list_max(sims)) AS best, max(list_max(gl)) AS max_gap, max(CASE WHEN len(sims) > 1 THEN 1 ELSE 0 END) AS several FROM h
  GROUP BY ALL"""
)
def hit_table(spark, base):
    d = table(spark, base, "annotations").where("refhits is not null").select(*CONTIG, "gene", "pos1", X.hit_rows(F.col("refhits")).alias("hits"))
    top = lambda f: F.array_max(F.transform("hits", lambda h: h[f]))
    return d.groupBy(*CONTIG, "gene", "pos1").agg(F.max(top("similarity")).alias("best"), F.max(top("gap_leading")).alias("max_gap"),
        F.max((F.size("hits") > 1).cast("int")).alias("several"))


# Relational --------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT DISTINCT id, r1, r2, pre_opts FROM preprocess), o AS (SELECT pre_opts, max(cpus) AS cpus, max(memory) AS memory FROM pre_opts
  WHERE removed_at IS NULL GROUP BY 1)
SELECT p.id, r1, r2, p.pre_opts, cpus, memory FROM p JOIN o USING (pre_opts) WHERE EXISTS (SELECT 1 FROM assemble a WHERE a.id = p.id AND a.assemble_lock = 0)"""
)
def ready_reads(spark, base):
    p = table(spark, base, "preprocess").select("id", "r1", "r2", "pre_opts").distinct()
    o = table(spark, base, "pre_opts").where("removed_at is null").groupBy("pre_opts").agg(F.max("cpus").alias("cpus"), F.max("memory").alias("memory"))
    a = table(spark, base, "assemble").where("assemble_lock = 0").select("id")
    return p.join(o, "pre_opts").join(a, "id", "left_semi").select("id", "r1", "r2", "pre_opts", "cpus", "memory")


@query(
    """SELECT DISTINCT s.id, s.path, n.curate_opts, c.target FROM assemblies s JOIN assemble a ON a.id = s.id AND a.assemble_lock = 1 JOIN annotate n ON n.id = s.id AND n.removed_at IS NULL JOIN curate_opts c ON c.curate_opts = n.curate_opts AND c.removed_at IS NULL WHERE s.ignore = 0"""
)
def ready_assemblies(spark, base):
    s = table(spark, base, "assemblies").where("ignore = 0").select("id", "path").distinct()
    a = table(spark, base, "assemble").where("assemble_lock = 1").select("id")
    n = table(spark, base, "annotate").where("removed_at is null").select("id", "curate_opts").distinct()
    c = table(spark, base, "curate_opts").where("removed_at is null").select("curate_opts", "target").distinct()
    return s.join(a, "id", "left_semi").join(n, "id").join(c, "curate_opts").select("id", "path", "curate_opts", "target").distinct()


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, time_stamp DESC NULLS LAST, {by}) AS k FROM {t}) WHERE k = 1)"


def _last(df: DataFrame, by: str) -> DataFrame:
    return V.last_by(df, ["id"], ["loaded_at", "time_stamp", by])


@query(
    f"""SELECT p.id, p.reads, a.topology AS assembly_topology, a.length AS assembly_length, n.pcgcount, n.missing FROM {_LAST.format(t='preprocess', by='reads DESC NULLS LAST')} p LEFT JOIN {_LAST.format(t='assemble', by='length DESC NULLS LAST')} a USING (id) LEFT JOIN {_LAST.format(t='annotate', by='missing DESC NULLS LAST')} n USING (id)"""
)
def project_snapshot(spark, base):
    p = _last(table(spark, base, "preprocess"), "reads").select("id", "reads")
    a = _last(table(spark, base, "assemble"), "length").select("id", F.col("topology").alias("assembly_topology"), F.col("length").alias("assembly_length"))
    n = _last(table(spark, base, "annotate"), "missing").select("id", "pcgcount", "missing")
    return p.join(a, "id", "left").join(n, "id", "left")


@query(
    f"""SELECT a.id, strftime(make_timestamp(a.time_stamp * 1000000), '%Y-%m-%d') AS assembled_on, p.trimmed_reads FROM {_LAST.format(t='assemble', by='length DESC NULLS LAST')} a LEFT JOIN {_LAST.format(t='preprocess', by='reads DESC NULLS LAST')} p USING (id)"""
)
def assembly_view(spark, base):
    a = _last(table(spark, base, "assemble"), "length")
    p = _last(table(spark, base, "preprocess"), "reads").select("id", "trimmed_reads")
    return a.join(p, "id", "left").select("id", F.date_format(F.timestamp_seconds("time_stamp"), "yyyy-MM-dd").alias("assembled_on"), "trimmed_reads")


@query("SELECT id, length, coalesce(try_cast(length AS BIGINT) >= 500, false) AS long_enough FROM (SELECT DISTINCT id, length FROM assemble)")
def length_gate(spark, base):
    return table(spark, base, "assemble").select("id", "length").distinct().withColumn("long_enough", F.coalesce(F.col("length").try_cast("long") >= 500, F.lit(False)))


@query(
    f"""WITH {_LENGTHS} SELECT id, max(path) AS paths, max(scaffold) AS scaffolds, (SELECT string_agg(v, ';' ORDER BY v::BIGINT DESC) FROM (SELECT DISTINCT contig_length::VARCHAR AS v FROM lengths l WHERE l.id = o.id)) AS lengths, string_agg(DISTINCT topology, ';' ORDER BY topology) AS topologies, sum(contig_length)::BIGINT AS total FROM lengths o GROUP BY id"""
)
def assembly_groups(spark, base):
    return lengths(spark, base).groupBy("id").agg(
        F.max("path").alias("paths"), F.max("scaffold").alias("scaffolds"), F.array_join(F.sort_array(F.collect_set("contig_length"), False).cast("array<string>"),
            ";").alias("lengths"), F.array_join(F.array_sort(F.collect_set("topology")), ";").alias("topologies"), F.sum("contig_length").alias("total")
    )


@query("WITH c AS (SELECT id, max(time_stamp) AS s FROM annotations GROUP BY id) SELECT a.id, count(*) AS n FROM annotations a JOIN c ON a.id = c.id WHERE s IS NULL OR a.time_stamp = s GROUP BY a.id")
def generation_purge(spark, base):
    a = table(spark, base, "annotations")
    now = a.groupBy("id").agg(F.max("time_stamp").alias("time_stamp"))
    return dml.purge_generations(a.select("id", "time_stamp"), now, ["id"], "time_stamp").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT id, r1, NULL::VARCHAR AS topology, NULL::VARCHAR AS remark FROM preprocess UNION ALL SELECT id, NULL, topology, NULL FROM assemble")
def union_by_name(spark, base):
    p = dml.add_columns(table(spark, base, "preprocess").select("id", "r1"), {"remark": "string", "id": "string"})
    return p.unionByName(table(spark, base, "assemble").select("id", "topology"), allowMissingColumns=True)


@query("SELECT id, count(*) AS n_rows, max(length(id))::INT AS id_length FROM assemble GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, base):
    d = table(spark, base, "assemble")
    return dml.duplicate_keys(d, ["id"]).withColumn("id_length", F.length("id"))


@query("SELECT DISTINCT id FROM assemble WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM annotate n WHERE n.id = assemble.id)")
def unannotated(spark, base):
    return table(spark, base, "assemble").where("id is not null").select("id").distinct().join(table(spark, base, "annotate").select("id"), "id", "left_anti")


@query(f"WITH {_calls_sql()} SELECT id, path, scaffold, gene, pos1, pos2, direction, k FROM (SELECT *, row_number() OVER (PARTITION BY id, path, scaffold ORDER BY abs(pos2 - pos1) DESC, pos1, pos2, gene, direction, type) AS k FROM calls) WHERE k <= 3")
def top_calls(spark, base):
    d = calls(spark, base)
    order = [F.desc(F.abs(F.col("pos2") - F.col("pos1"))), *[F.col(c) for c in ("pos1", "pos2", "gene", "direction", "type")]]
    top = W.top_per_group(d, CONTIG, order, 3)
    return top.withColumn("k", F.row_number().over(Window.partitionBy(*CONTIG).orderBy(*order)).cast("long")).select(*CONTIG, "gene", "pos1", "pos2", "direction", "k")


@query("SELECT target, max_blast_hits AS usual FROM (SELECT target, max_blast_hits, row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, max_blast_hits) AS k FROM curate_opts WHERE max_blast_hits IS NOT NULL GROUP BY target, max_blast_hits) WHERE k = 1")
def usual_value(spark, base):
    return table(spark, base, "curate_opts").where("max_blast_hits is not null").groupBy("target").agg(F.mode("max_blast_hits", True).alias("usual"))


@query(f"WITH {_calls_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY id, path, scaffold, gene ORDER BY pos1, pos2, direction, type) - 1 AS k FROM calls) SELECT id, path, scaffold, pos1, pos2, direction, CASE WHEN k = 0 THEN gene ELSE gene || '.' || k END AS name FROM n")
def unique_names(spark, base):
    d = W.make_unique(calls(spark, base), CONTIG, "gene", ["pos1", "pos2", "direction", "type"], "name")
    return d.select(*CONTIG, "pos1", "pos2", "direction", "name")


@query(f"WITH c AS (SELECT type, gene, product, {PRODUCT_SQL} AS expected FROM annotations WHERE type = 'PCG') SELECT gene, count(*) AS n, count_if(product = expected)::BIGINT AS n_same FROM c GROUP BY gene")
def product_lookup(spark, base):
    d = table(spark, base, "annotations").where("type = 'PCG'").select("gene", "product", A.gene_product(F.col("gene")).alias("expected"))
    return d.groupBy("gene").agg(F.count("*").alias("n"), F.count_if(F.col("product") == F.col("expected")).alias("n_same"))


# Export ------------------------------------------------------------------------------------------


def _export(spark, base):
    c = calls(spark, base, "product", "anticodon", "start_codon", "stop_codon").withColumn("seq_name", F.concat_ws(".",
        *[F.col(x).cast("string") for x in CONTIG])).withColumn("genetic_code", F.lit(CODE))
    return K.codon_notes(c.join(F.broadcast(_rules(spark).select("gene", "start_codons")), "gene", "left"))


_EXPORT = f"""{_calls_sql('product, anticodon, start_codon, stop_codon')}, {_RULES}, x AS (SELECT c.*, id || '.' || path || '.' || scaffold AS seq_name,
  coalesce(type = 'PCG' AND NOT list_contains(starts, start_codon), false) AS bad, type = 'PCG' AND length(stop_codon) < 3 AS short FROM calls c LEFT
  JOIN rules ON rgene = gene),
e AS (SELECT *, nullif(concat_ws('; ', CASE WHEN bad THEN 'start codon not determined' END, CASE
  WHEN short THEN 'TAA stop codon is completed by the addition of 3'' A residues to the mRNA' END), '') AS note, (CASE WHEN bad AND direction = '+' THEN '<'
  ELSE '' END) || (CASE direction WHEN '-' THEN pos2 ELSE pos1 END) || chr(9) || (CASE direction WHEN '-' THEN pos1 ELSE pos2 END) || (CASE WHEN bad
  AND direction = '-' THEN '>' ELSE '' END) AS pos FROM x)"""
_Q = "repeat(chr(9), 3)"


@query(
    f"""WITH {_EXPORT}, l AS (SELECT seq_name, pos1, gene, list_filter(CASE WHEN type IN ('PCG', 'tRNA', 'rRNA') THEN [pos || chr(9) || 'gene',
  {_Q} || 'gene' || chr(9) || CASE WHEN gene = 'rrnS' AND type = 'rRNA' THEN 's-rRNA' WHEN type = 'rRNA' THEN 'l-rRNA' ELSE gene END, pos || chr(9) || CASE type
  WHEN 'PCG' THEN 'CDS' ELSE type END,
 {_Q} || 'product' || chr(9) || coalesce(product, ''), CASE WHEN type = 'PCG' THEN {_Q} || 'transl_table' || chr(9) || '{CODE}' END, CASE
   WHEN bad THEN {_Q} || 'codon_start' || chr(9) || '1' END, {_Q} || 'note' || chr(9) || note, CASE WHEN type = 'tRNA'
   AND anticodon <> 'NNN' THEN {_Q} || 'note' || chr(9) || 'anticodon:' || lower(anticodon) END]
 WHEN type = 'ctrl' THEN [pos || chr(9) || 'D-loop', {_Q} || 'note' || chr(9) || 'control region'] END, lambda v: v IS NOT NULL) AS v FROM e)
SELECT seq_name, pos1, gene, (i - 1)::INT AS n, v[i] AS line FROM (SELECT seq_name, pos1, gene, v, unnest(range(1, len(v) + 1)) AS i FROM l)"""
)
def feature_table(spark, base):
    return K.feature_table(_export(spark, base))


@query(
    f"""WITH {_EXPORT}, {_LENGTHS}, g AS (SELECT e.*, contig_length, topology, seq_name || ':' || pos1 || '..' || pos2 AS place FROM e JOIN lengths USING (id, path,
  scaffold)),
l AS (SELECT *, CASE type WHEN 'PCG' THEN ['gene', 'CDS'] WHEN 'ctrl' THEN ['D_loop'] ELSE [type, 'exon'] END AS f, CASE type
 WHEN 'PCG' THEN ['ID=gene-' || gene || ';Name=' || gene || ';gbkey=Gene;gene=' || gene || ';gene_biotype=protein_coding', 'ID=cds-' || gene || ';Parent=gene-' || gene || ';Name=' || gene || ';gbkey=CDS;gene=' || gene || ';product=' || coalesce(product, '') || ';transl_table={CODE}' || coalesce(';Note=' || note, '')]
 WHEN 'ctrl' THEN ['ID=exon-' || place || ';gbkey=D-loop;Note=control region']
   ELSE ['ID=rna-' || place || ';Name=' || gene || ';gbkey=' || type || ';product=' || coalesce(product, ''),
   'ID=exon-' || place || ';Parent=rna-' || place || ';gbkey=' || type || ';product=' || coalesce(product, '')] END AS a FROM g WHERE type IN ('PCG', 'tRNA', 'rRNA',
   'ctrl'))
SELECT seq_name, pos1, gene, (i - 1)::INT AS n, concat_ws(chr(9), seq_name, 'organelia', f[i], pos1, CASE WHEN topology = 'circular'
  AND pos1 > pos2 THEN contig_length + pos2 ELSE pos2 END, '.', direction, CASE WHEN f[i] = 'CDS' THEN '0' ELSE '.' END, a[i]) AS line FROM (SELECT *, unnest(range(1,
  len(f) + 1)) AS i FROM l)"""
)
def gff3_lines(spark, base):
    return K.gff3(_export(spark, base).join(lengths(spark, base), CONTIG))


# Streams and events ------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events
  WHERE ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, base):
    e = table(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = sessions(e, ["user_id"], "ts", "6 hours")
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def last_events(spark, base):
    return last_values(table(spark, base, "events"), ["user_id", "event_type"], "event_id", ["ts", "event_id"])


@query("SELECT flipped, count(*) AS n FROM (SELECT CASE direction WHEN '+' THEN '-' WHEN '-' THEN '+' ELSE direction END AS flipped FROM annotations) GROUP BY 1")
def strand_counts(spark, base):
    return table(spark, base, "annotations").select(flip_strand(F.col("direction")).alias("flipped")).groupBy("flipped").agg(F.count("*").alias("n"))
