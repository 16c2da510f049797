"""Read models: what the project tables say together, as joins, and the few values that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from organelia.functions.text import bullets, named_values, shell_quote
from organelia.operators import dml
from organelia.operators.dml import replace_rows
from organelia.operators.nested import rule_values
from organelia.operators.rejects import classify_records, valid_records
from organelia.plans.params import merged_rules
from organelia.plans.problems import _P3, _P6
from organelia.plans.rules import _WARNED, _warned
from organelia.session import table


def live(options: DataFrame, key: str) -> DataFrame:
    """One row per option set: of those not withdrawn the one loaded last, the greatest by all columns of equal ones."""
    d = options.where(F.col("removed_at").isNull() & F.col(key).isNotNull())
    rest = [c for c in d.columns if c not in (key, "loaded_at")]
    return d.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("loaded_at", *rest)).alias("_row")).select(key, "_row.*")


def latest(df: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """The columns of the row of each key that was loaded last, the greatest by them of equal ones.

    A maximum that is combined before the shuffle; NULL is the least value. Rows without key are left out.
    """
    order = F.struct("loaded_at", *columns)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(key, "_row.*")


def samples(sheets: DataFrame) -> DataFrame:
    """(id, export_group, taxon, r1, r2): the valid records of the sample sheets, the first of an id by sheet and line. The group is the sheet."""
    d = valid_records(classify_records(sheets))
    first = d.groupBy("id").agg(F.min_by(F.struct("sheet", "taxon", "r1", "r2"), F.struct("sheet", "line_no", "taxon", "r1", "r2")).alias("r"))
    return first.select("id", F.col("r.sheet").alias("export_group"), "r.taxon", "r.r1", "r.r2")


def ready_samples(assemble: DataFrame, options: DataFrame, switch: int = 1) -> DataFrame:
    """Samples that wait for assembly, with their option set; those of a set that is not there are left out."""
    a = assemble.where(F.col("assemble_switch") == switch).where("assemble_lock = 0").select("id", "assemble_opts").distinct()
    return a.join(live(options, "assemble_opts"), "assemble_opts").select("id", "assemble_opts", "cpus", "memory", "seeds_db", "labels_db", "getorganelle")


def ready_annotations(assemblies: DataFrame, assemble: DataFrame, annotate: DataFrame, options: DataFrame, switch: int = 1) -> DataFrame:
    """Paths that wait for annotation: not ignored, of a locked assembly, with the options (one row a set) of their annotation."""
    s = assemblies.where("ignore = 0").select("id", "path").distinct()
    b = assemble.where("assemble_lock = 1").select("id").distinct()
    c = annotate.where((F.col("annotate_switch") == switch) & (F.col("annotate_lock") == 0)).select("id", "annotate_opts").distinct()
    return s.join(b, "id", "left_semi").join(c, "id").join(options, "annotate_opts").distinct()


def annotate_view(assemble: DataFrame, annotate: DataFrame, taxa: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Locked assemblies with their annotation, where there is one, and taxon."""
    a = assemble.where("assemble_lock = 1 and id is not null").select("id").distinct()
    return a.join(latest(annotate, columns), "id", "left").join(taxa.select("id", "taxon"), "id", "left")


def export_view(assemble: DataFrame, annotate: DataFrame, taxa: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Samples whose assembly and annotation are locked, with taxon and export group; transfer RNAs in the structure are bullets."""
    a = assemble.where("assemble_lock = 1 and id is not null").select("id").distinct()
    n = latest(annotate, ["annotate_lock", *columns]).where("annotate_lock = 1").drop("annotate_lock")
    d = a.join(n, "id").join(taxa.drop("r1", "r2"), "id", "left")
    return d.withColumn("structure", bullets(F.col("structure"))) if "structure" in columns else d


def sample_rules(annotate: DataFrame, options: DataFrame) -> DataFrame:
    """(id, curate_opts, gene, ...): the rules of each sample's parameter set, gene rules over the defaults of their type; one row with NULL rules where the set is missing or unreadable."""
    n = latest(annotate, ["curate_opts"])
    rules = merged_rules(rule_values(options.where("removed_at is null")))
    return n.join(rules, "curate_opts", "left")


def sample_contigs(taxa: DataFrame, annotate: DataFrame) -> DataFrame:
    """Each sample with every distinct (topology, path) of its annotations."""
    return taxa.select("id", "taxon").join(annotate.select("id", "topology", "path").distinct(), "id", "left")


def group_proteins(taxa: DataFrame, annotations: DataFrame, group: str | None = None) -> DataFrame:
    """The protein calls of the samples of a group (all groups: None), samples without one too."""
    s = taxa if group is None else taxa.where(F.col("export_group") == group)
    calls = annotations.where("pos1 > 0 and type = 'PCG'").select("id", "gene", "pos1", "translation").distinct()
    return s.select("export_group", "id").join(calls, "id", "left")


def waiting(assemble: DataFrame, annotate: DataFrame, assemble_switch: int = 1, annotate_switch: int = 1) -> DataFrame:
    """(module, n): how many samples an update of each module would run."""
    a = assemble.where(F.col("assemble_switch") == assemble_switch).select(F.lit("assemble").alias("module"), "id")
    n = annotate.where(F.col("annotate_switch") == annotate_switch).select("id").join(assemble.where("assemble_lock = 1").select("id"), "id",
        "left_semi").select(F.lit("annotate").alias("module"), "id")
    counted = a.unionAll(n).groupBy("module").agg(F.count_distinct("id").alias("n"))
    modules = assemble.sparkSession.createDataFrame([("assemble",), ("annotate",)], "module string")
    return modules.join(counted, "module", "left").select("module", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def reset_annotations(annotate: DataFrame, changed: DataFrame) -> DataFrame:
    """The annotation table after the assemblies of ``changed`` (id) were made again.

    Their rows keep id and option sets, are to be run, are not locked or reviewed, and lose everything else.
    """
    new = annotate.join(changed.select("id").distinct(), "id", "left_semi").select("id", "annotate_opts", "curate_opts").distinct()
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return replace_rows(annotate, new.withColumns({"annotate_switch": one, "annotate_lock": none, "reviewed": F.lit("no")}), ["id"])


def several_paths(assemblies: DataFrame) -> DataFrame:
    """(id, n_paths): samples with more than one path that is not ignored; they may not be locked."""
    return assemblies.where("ignore = 0").groupBy("id").agg(F.count_distinct("path").alias("n_paths")).where("n_paths > 1")


def read_paths(reads: DataFrame, folder: str) -> DataFrame:
    """Reads with the full paths of their files; a NULL name has none."""
    at = lambda c: F.concat(F.lit(folder.rstrip("/") + "/"), F.col(c))
    return reads.withColumns({"r1_path": at("r1"), "r2_path": at("r2")})


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__.removeprefix("q_")] = f
        ORACLE[f.__name__.removeprefix("q_")] = sql
        return f

    return add


def _latest_sql(name: str, source: str, columns: str) -> str:
    """The row of each id with the greatest (loaded_at, columns), NULL being the least."""
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ["loaded_at", *columns.split(", ")])
    return f"{name} AS (SELECT id, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}) AS k FROM {source} WHERE id IS NOT NULL) WHERE k = 1)"


_SAMPLES = f"""{_P6}, samples AS (SELECT i AS id, sheet AS export_group, t AS taxon, a AS r1, b AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sheet, line_no, t, a, b) AS k FROM done WHERE reason IS NULL) WHERE k = 1)"""
_LOCKED = "locked AS (SELECT DISTINCT id FROM assemble WHERE assemble_lock = 1 AND id IS NOT NULL)"
_EXPORTED = "curate_opts, topology, structure, pcgcount, trnacount, rrnacount, missing, extra, warnings"


_ONE = ", ".join(f"max(CASE WHEN field = '{f}' THEN item END) AS {f.replace('.', '_').replace('count', 'n_calls')}" for f in ("type", "count", "max_len", "min_len",
    "overlap.start", "overlap.stop"))
_LISTS = ", ".join(f"list(item ORDER BY pos, item) FILTER (field = '{f}') AS {f}" for f in ("start_codons", "stop_codons"))
_FIELDS = ("n_calls", "max_len", "min_len", "overlap_start", "overlap_stop", "start_codons", "stop_codons")


def merged_sql(where: str = "true") -> str:
    """The rules of each set, gene over type, as a CTE ``merged`` after those of the nested values."""
    return f"""{_P3.replace("FROM curate_opts\n), texts", f"FROM curate_opts WHERE {where}" + chr(10) + "), texts")}
, flat AS (SELECT curate_opts, section, name, {_ONE}, {_LISTS} FROM (SELECT DISTINCT curate_opts, section, name, field, pos, item FROM found) GROUP BY curate_opts,
  section, name)
, merged AS (SELECT o.curate_opts, o.name AS gene, o.type, {", ".join(f"coalesce(o.{f}, d.{f}) AS {f}" for f in _FIELDS)} FROM flat o LEFT
  JOIN flat d ON d.section = 'default_rules' AND d.curate_opts = o.curate_opts AND d.name = o.type WHERE o.section = 'rules')"""


def _taxa(spark: SparkSession, base: str) -> DataFrame:
    return samples(table(spark, base, "mapping_test"))


@_query(f"{_SAMPLES} SELECT id, export_group, taxon, r1, r2 FROM samples")
def sample_table(spark, base):
    return _taxa(spark, base)


@_query(
    """WITH a AS (SELECT DISTINCT id, assemble_opts FROM assemble WHERE assemble_switch = 3 AND assemble_lock = 0),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assemble_opts ORDER BY loaded_at DESC NULLS LAST, cpus DESC NULLS LAST, memory DESC NULLS LAST,
  getorganelle DESC NULLS LAST) AS k FROM assemble_opts WHERE removed_at IS NULL) WHERE k = 1)
SELECT id, a.assemble_opts, cpus, memory, seeds_db, labels_db, getorganelle FROM a JOIN o ON a.assemble_opts = o.assemble_opts"""
)
def q_ready_samples(spark, base):
    return ready_samples(table(spark, base, "assemble"), table(spark, base, "assemble_opts"), 3)


@_query(
    """WITH o AS (SELECT annotate_opts, count(*) AS n_samples FROM annotate WHERE annotate_opts IS NOT NULL GROUP BY 1)
SELECT DISTINCT s.id, s.path, n.annotate_opts, o.n_samples FROM assemblies s JOIN assemble a ON a.id = s.id AND a.assemble_lock = 1 JOIN annotate n ON n.id = s.id
  AND n.annotate_switch = 2 AND n.annotate_lock = 0 JOIN o ON o.annotate_opts = n.annotate_opts WHERE s.ignore = 0"""
)
def q_ready_annotations(spark, base):
    # The data have no table of annotation options; the sets in use stand for it.
    annotate = table(spark, base, "annotate")
    options = annotate.where("annotate_opts is not null").groupBy("annotate_opts").agg(F.count("*").alias("n_samples"))
    return ready_annotations(table(spark, base, "assemblies"), table(spark, base, "assemble"), annotate, options, 2).select("id", "path", "annotate_opts", "n_samples")


@_query(
    f"""{_SAMPLES}, {_LOCKED}, {_latest_sql("n", "annotate", "annotate_lock, annotate_switch, annotate_opts, curate_opts, reviewed, problematic, structure")}
SELECT id, taxon, annotate_lock, annotate_switch, annotate_opts, curate_opts, reviewed, problematic, structure FROM locked LEFT JOIN n USING (id) LEFT
  JOIN samples USING (id)"""
)
def q_annotate_view(spark, base):
    return annotate_view(table(spark, base, "assemble"), table(spark, base, "annotate"), _taxa(spark, base), ["annotate_lock", "annotate_switch", "annotate_opts",
        "curate_opts", "reviewed", "problematic", "structure"])


@_query(
    f"""{_SAMPLES}, {_LOCKED}, {_latest_sql("n", "annotate", f"annotate_lock, {_EXPORTED}")}
SELECT id, taxon, export_group, curate_opts, topology, regexp_replace(structure, 'trn[A-Z]', '•', 'g') AS structure, pcgcount, trnacount, rrnacount, missing, extra,
  warnings
FROM locked JOIN n USING (id) LEFT JOIN samples USING (id) WHERE annotate_lock = 1"""
)
def q_export_view(spark, base):
    return export_view(table(spark, base, "assemble"), table(spark, base, "annotate"), _taxa(spark, base), _EXPORTED.split(", "))


@_query(
    f"""{merged_sql("removed_at IS NULL")}, {_latest_sql("n", "annotate", "curate_opts")}
SELECT n.id, n.curate_opts, gene, type, n_calls AS count, max_len, min_len, overlap_start, overlap_stop, array_to_string(start_codons, ' ') AS starts,
  array_to_string(stop_codons, ' ') AS stops FROM n LEFT JOIN merged m ON m.curate_opts = n.curate_opts"""
)
def q_sample_rules(spark, base):
    d = sample_rules(table(spark, base, "annotate"), table(spark, base, "curate_opts"))
    return d.select("id", "curate_opts", "gene", "type", "count", "max_len", "min_len", "overlap_start", "overlap_stop", F.array_join("start_codons",
        " ").alias("starts"), F.array_join("stop_codons", " ").alias("stops"))


@_query(f"{_SAMPLES} SELECT s.id, taxon, n.topology, n.path FROM samples s LEFT JOIN (SELECT DISTINCT id, topology, path FROM annotate) n ON n.id = s.id")
def q_sample_contigs(spark, base):
    return sample_contigs(_taxa(spark, base), table(spark, base, "annotate"))


@_query(f"{_SAMPLES} SELECT s.export_group, s.id, c.gene, c.pos1, md5(c.translation) AS translation_md5 FROM samples s LEFT JOIN (SELECT DISTINCT id, gene, pos1, translation FROM annotations WHERE pos1 > 0 AND type = 'PCG') c ON c.id = s.id")
def q_group_proteins(spark, base):
    return group_proteins(_taxa(spark, base), table(spark, base, "annotations")).withColumn("translation_md5", F.md5("translation")).drop("translation")


@_query(
    """SELECT 'assemble' AS module, count(DISTINCT id) AS n FROM assemble WHERE assemble_switch = 3
UNION ALL SELECT 'annotate', count(DISTINCT n.id) FROM annotate n JOIN assemble a ON a.id = n.id AND assemble_lock = 1 WHERE annotate_switch = 1"""
)
def samples_waiting(spark, base):
    return waiting(table(spark, base, "assemble"), table(spark, base, "annotate"), 3, 1)


_CHANGED = "changed AS (SELECT n.id FROM (SELECT id, max(time_stamp) AS t FROM annotate GROUP BY id) n JOIN (SELECT id, max(time_stamp) AS t FROM assemble GROUP BY id) a USING (id) WHERE a.t < n.t - 86400 * 3)"


@_query(
    f"""WITH {_CHANGED} SELECT id, annotate_opts, curate_opts, annotate_switch, annotate_lock, reviewed, structure FROM annotate WHERE id NOT IN (SELECT id FROM changed)
UNION ALL SELECT DISTINCT id, annotate_opts, curate_opts, 1, 0, 'no', NULL FROM annotate WHERE id IN (SELECT id FROM changed)"""
)
def annotations_reset(spark, base):
    # Which assemblies were made again is not in the data; those much older than their annotation stand for them.
    annotate = table(spark, base, "annotate")
    last = lambda d, c: d.groupBy("id").agg(F.max("time_stamp").alias(c))
    changed = last(annotate, "n").join(last(table(spark, base, "assemble"), "a"), "id").where(F.col("a") < F.col("n") - 86400 * 3)
    return reset_annotations(annotate, changed).select("id", "annotate_opts", "curate_opts", "annotate_switch", "annotate_lock", "reviewed", "structure")


@_query("SELECT id, count(DISTINCT path) AS n_paths FROM assemblies WHERE ignore = 0 GROUP BY id HAVING count(DISTINCT path) > 1")
def q_several_paths(spark, base):
    return several_paths(table(spark, base, "assemblies"))


@_query(
    "SELECT DISTINCT id, '/data/raw/' || r1 AS r1_path, '/data/raw/' || r2 AS r2_path, '''' || replace('/data/raw/' || r1, '''', '''\\''''') || '''' AS r1_quoted, printf('%s has %d reads', coalesce(id, 'NA'), coalesce(reads, 0)) AS said FROM preprocess"
)
def q_read_paths(spark, base):
    d = read_paths(table(spark, base, "preprocess"), "/data/raw/")
    said = F.format_string("%s has %d reads", F.coalesce("id", F.lit("NA")), F.coalesce("reads", F.lit(0).cast("long")))
    return d.select("id", "r1_path", "r2_path", shell_quote(F.col("r1_path")).alias("r1_quoted"), said.alias("said")).distinct()


@_query(
    """WITH d AS (SELECT DISTINCT id, id || '.' || path || '.' || scaffold || ' ' || coalesce(topology, 'NA') AS seq_name, length(sequence) AS n FROM assemblies
  WHERE sequence IS NOT NULL AND id IS NOT NULL AND path IS NOT NULL AND scaffold IS NOT NULL),
one AS (SELECT id, seq_name, max(n) AS n FROM d GROUP BY ALL) SELECT id, string_agg(seq_name || '=' || n, '; ' ORDER BY seq_name) AS lengths FROM one GROUP BY id"""
)
def sequence_lengths(spark, base):
    """The sequence lengths of a sample, looked up in a map by the sequences' names."""
    name = F.concat(F.concat_ws(".", "id", F.col("path").cast("string"), F.col("scaffold").cast("string")), F.lit(" "), F.coalesce("topology", F.lit("NA")))
    d = table(spark, base, "assemblies").where("sequence is not null and id is not null and path is not null and scaffold is not null").select("id",
        name.alias("seq_name"), F.length("sequence").alias("n"))
    maps = d.groupBy("id", "seq_name").agg(F.max("n").alias("n")).groupBy("id").agg(named_values(F.col("seq_name"), F.col("n")).alias("m"))
    shown = lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), F.element_at(m, k).cast("string")))
    return maps.select("id", F.array_join(shown(F.col("m")), "; ").alias("lengths"))


@_query(f"{merged_sql()} SELECT curate_opts, gene, type, n_calls AS count, max_len, min_len, overlap_start, overlap_stop, start_codons, stop_codons FROM merged")
def rules_merged(spark, base):
    return merged_rules(rule_values(table(spark, base, "curate_opts")))


# Changes to tables: the reads of the sample sheets against those of the preprocessing table -----------

_OLD = f"""{_SAMPLES}, {_latest_sql("old", "preprocess", "r1, r2, pre_opts, reads")}, new AS (SELECT CASE WHEN export_group = (SELECT max(export_group) FROM samples) THEN id || '-b' ELSE id END AS id, upper(r1) AS r1, taxon FROM samples WHERE export_group <> (SELECT min(export_group) FROM samples))"""


def _old_new(spark, base):
    """The last row of each sample, and other read names for the samples of all sheets but the first; those of the last sheet are new samples."""
    old = latest(table(spark, base, "preprocess"), ["r1", "r2", "pre_opts", "reads"])
    s = _taxa(spark, base)
    ends = s.agg(F.min("export_group").alias("_first"), F.max("export_group").alias("_last"))
    named = F.when(F.col("export_group") == F.col("_last"), F.concat("id", F.lit("-b"))).otherwise(F.col("id"))
    return old, s.join(ends, F.col("export_group") != F.col("_first")).select(named.alias("id"), F.upper("r1").alias("r1"), "taxon")


@_query(f"{_OLD} SELECT id, coalesce(n.r1, o.r1) AS r1, r2, pre_opts, reads, NULL AS taxon FROM old o LEFT JOIN new n USING (id) UNION ALL SELECT id, r1, NULL, NULL, NULL, taxon FROM new ANTI JOIN old USING (id)")
def rows_upsert(spark, base):
    old, new = _old_new(spark, base)
    return dml.upsert_rows(old, new, ["id"]).select("id", "r1", "r2", "pre_opts", "reads", "taxon")


@_query(f"{_OLD} SELECT id, coalesce(n.r1, o.r1) AS r1, r2, pre_opts, reads FROM old o LEFT JOIN new n USING (id)")
def rows_update(spark, base):
    old, new = _old_new(spark, base)
    return dml.update_rows(old, new, ["id"]).select("id", "r1", "r2", "pre_opts", "reads")


@_query(f"{_OLD} SELECT id, r1 FROM old UNION ALL SELECT id, r1 FROM new ANTI JOIN old USING (id)")
def rows_insert(spark, base):
    old, new = _old_new(spark, base)
    return dml.insert_rows(old, new, ["id"]).select("id", "r1")


@_query(f"{_OLD} SELECT id, r1, r2, reads FROM old ANTI JOIN new USING (id) UNION ALL SELECT id, r1, NULL, NULL FROM new")
def rows_replace(spark, base):
    old, new = _old_new(spark, base)
    return dml.replace_rows(old, new, ["id"]).select("id", "r1", "r2", "reads")


@_query(f"{_OLD} SELECT id, r1 FROM old ANTI JOIN new USING (id)")
def rows_delete(spark, base):
    old, new = _old_new(spark, base)
    return dml.delete_rows(old, new, ["id"]).select("id", "r1")


@_query(
    f"""{_OLD}, t AS (SELECT o.id, CASE WHEN n.id IS NULL THEN o.r1 ELSE n.r1 END AS r1, coalesce(reviewed, 'no') AS reviewed FROM old o LEFT JOIN new n USING (id) LEFT
  JOIN (SELECT id, max(reviewed) AS reviewed FROM annotate GROUP BY id) a USING (id))
SELECT id, r1, reviewed, NULL AS refused FROM t UNION ALL SELECT id, r1, NULL, 'unknown key' FROM new ANTI JOIN old USING (id)"""
)
def samples_update(spark, base):
    """Sample metadata changed by known ids, with what was refused, in a schema to which a column with a default was added."""
    old, new = _old_new(spark, base)
    done, refused = dml.checked_update(old, new, ["id"])
    reviewed = table(spark, base, "annotate").groupBy("id").agg(F.max("reviewed").alias("reviewed"))
    done = dml.migrate(done.join(reviewed, "id", "left"), {"reviewed": ("string", "no"), "refused": "string"})
    return done.select("id", "r1", "reviewed", "refused").unionByName(refused.select("id", "r1", F.col("reason").alias("refused")), allowMissingColumns=True)


@_query(
    f"""{_OLD} SELECT id, r1, pre_opts, NULL AS refused FROM old UNION ALL SELECT id, r1, 'default', NULL FROM new ANTI JOIN old USING (id) UNION ALL SELECT id, r1, NULL, 'known key' FROM new SEMI JOIN old USING (id)"""
)
def samples_add(spark, base):
    """Samples added by new ids, with a default option set, and what was refused."""
    old, new = _old_new(spark, base)
    done, refused = dml.checked_insert(old, new, ["id"], {"pre_opts": "default"})
    return done.select("id", "r1", "pre_opts").unionByName(refused.select("id", "r1", F.col("reason").alias("refused")), allowMissingColumns=True)


@_query(f"{_OLD} SELECT o.id FROM old o JOIN new n USING (id) JOIN samples s USING (id) WHERE o.r1 IS DISTINCT FROM s.r1 OR o.r2 IS DISTINCT FROM s.r2")
def changed_reads(spark, base):
    """Samples of those sheets whose reads are other ones than those that were preprocessed, compared by id."""
    old, new = _old_new(spark, base)
    s = _taxa(spark, base).join(new.select("id"), "id", "left_semi").select("id", F.struct("r1", "r2").alias("now"))
    both = old.select("id", F.struct("r1", "r2").alias("then")).join(s, "id")
    return both.where(~F.col("now").eqNullSafe(F.col("then"))).select("id")


# Warnings by each sample's own parameter set ----------------------------------------------------------

_TYPED = {"max_len": "double", "min_len": "double", "overlap_start": "int", "overlap_stop": "boolean"}
_OWN = ", ".join(f"try_cast({c} AS {t.upper()}) AS own_{c}" for c, t in _TYPED.items())
_SAYS = {"max_len": "max_len", "min_len": "min_len", "overlap_start": "overlap_start", "overlap_stop": "overlap_stop", "starts": "start_codons", "stops": "stop_codons"}
_WARNED_OWN = (
    _WARNED.replace("src AS (", "track_src AS (").replace("FROM src", "FROM track_src")
    .replace("a, st, sp, r.*,", "a, st, sp, rgene, allowed, " + ", ".join(f"coalesce(own_{o}, r.{c}) AS {c}" for c, o in _SAYS.items()) + ",")
    .replace("LEFT JOIN rules r ON rgene = gene", "LEFT JOIN rules r ON rgene = gene LEFT JOIN own ON own_id = d.id AND own_gene = d.gene")
)


@_query(
    f"""{merged_sql("removed_at IS NULL")}, {_latest_sql("last_set", "annotate", "curate_opts")}
, own AS (SELECT l.id AS own_id, gene AS own_gene, {_OWN}, start_codons AS own_start_codons, stop_codons AS own_stop_codons FROM last_set l JOIN merged m ON m.curate_opts = l.curate_opts)
, {_WARNED_OWN} SELECT id, path, scaffold, type, gene, pos1, pos2, direction, start_codon, stop_codon, length, warnings FROM warned"""
)
def rules_own_set(spark, base):
    """The warnings of ``rules_warnings``, with the rules of each sample's own parameter set before the built-in ones."""
    own = sample_rules(table(spark, base, "annotate"), table(spark, base, "curate_opts")).where("gene is not null")
    own = own.select("id", "gene", *[F.col(c).try_cast(t).alias(c) for c, t in _TYPED.items()], "start_codons", "stop_codons")
    d = _warned(spark, base, own)
    return d.select("id", "path", "scaffold", "type", "gene", "pos1", "pos2", "direction", "start_codon", "stop_codon", "length", F.array_join("warnings", "; ").alias("warnings"))
