"""The queries of the general problems, over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from organelia.operators.intervals import covered_and_gaps
from organelia.operators.nested import VALUE_TABLES, rule_nodes, rule_tables, rule_values
from organelia.operators.packed import packed_values
from organelia.operators.references import Reference, orphans
from organelia.operators.rejects import classify_records, rejected_records, valid_records
from organelia.session import cut, table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    s = covered_and_gaps(table(spark, base, "annotations"))
    return s.where("kind = 'gap'").select("id", "path", "scaffold", "direction", F.col("seg_start").alias("gap_start"), F.col("seg_end").alias("gap_end"))


def p1_covered(spark: SparkSession, base: str) -> DataFrame:
    s = covered_and_gaps(table(spark, base, "annotations"))
    return s.where("kind = 'covered'").select("id", "path", "scaffold", "direction", F.col("seg_start").alias("period_start"), F.col("seg_end").alias("period_end"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    t = lambda n: table(spark, base, n)
    return orphans(
        [
            Reference("preprocess", t("preprocess"), "id", "pre_opts", t("pre_opts"), "pre_opts"),
            Reference("assemble", t("assemble"), "id", "assemble_opts", t("assemble_opts"), "assemble_opts"),
            Reference("annotate", t("annotate"), "id", "curate_opts", t("curate_opts"), "curate_opts"),
            Reference("annotations", t("annotations"), "id", "id", t("annotate"), "id"),
        ]
    )


def p2_report(spark: SparkSession, base: str) -> DataFrame:
    """Orphans per table and period: referring rows' ids and keys."""
    return p2_found(spark, base).groupBy("table_name", "period").agg(F.count("*").alias("n_orphans"), F.count_distinct("ref_key").alias("n_keys"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return rule_values(table(spark, base, "curate_opts"))


def p3_tables(spark: SparkSession, base: str) -> DataFrame:
    """Rows of each subtype table, the sets they are of, and the rows whose parent is in the table it must be in."""
    nodes = cut(rule_nodes(table(spark, base, "curate_opts").select("curate_opts", "params").distinct().withColumn("doc", F.struct("curate_opts",
        "params")).select(F.to_json("doc").alias("doc"), "params"), "doc"))
    tables = rule_tables(nodes)
    parents = {"sets": None, "unreadable": None, "rules": "sets"} | {t: "rules" for t in VALUE_TABLES}
    parts = []
    for name, parent in parents.items():
        d = tables[name].select("set_key", "parent_id")
        if parent is not None:
            up = tables[parent].select("set_key", F.col("node_id").alias("parent_id"), F.lit(1).alias("up"))
            d = d.join(up, ["set_key", "parent_id"], "left")
        else:
            d = d.withColumn("up", F.when(F.col("parent_id") == 0, 1))
        parts.append(d.agg(F.count("*").alias("n_rows"), F.count_distinct("set_key").alias("n_documents"),
            F.count("up").alias("n_linked")).select(F.lit(name).alias("subtype"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    calls = packed_values(table(spark, base, "annotations"), "annotations", ["id", "path", "scaffold", "gene", "pos1"], ["warnings", "notes"])
    genes = packed_values(table(spark, base, "annotate"), "annotate", ["id"], ["missing", "extra"], ["missing", "extra"])
    return calls.unionByName(genes)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return rejected_records(classify_records(table(spark, base, "mapping_test"))).select("sheet", "line_no")


def p6_rejects(spark: SparkSession, base: str) -> DataFrame:
    return rejected_records(classify_records(table(spark, base, "mapping_test")))


def p6_valid(spark: SparkSession, base: str) -> DataFrame:
    return valid_records(classify_records(table(spark, base, "mapping_test")))


QUERIES = {f.__name__: f for f in (p1_found, p1_covered, p2_found, p2_report, p3_found, p3_tables, p4_found, p6_found, p6_rejects, p6_valid)}


_P1 = """
WITH calls AS (SELECT id, path, scaffold, direction, pos1, pos2 FROM annotations WHERE direction IS NOT NULL AND pos1 >= 1 AND pos2 >= 1
), spans AS (
  SELECT id, path, scaffold, direction, pos1 AS s, CASE WHEN pos1 <= pos2 THEN pos2 END AS e FROM calls
  UNION ALL SELECT id, path, scaffold, direction, 1, pos2 FROM calls WHERE pos1 > pos2
), seen AS (
  SELECT *, max(coalesce(e, 9e18::BIGINT)) OVER (PARTITION BY id, path, scaffold, direction ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM spans
)"""

_P2 = " UNION ALL ".join(
    f"""SELECT '{child}' AS table_name, strftime(c.loaded_at, '%Y-%m') AS period, c.id, lower(trim(c.{field}, ' ' || chr(9) || chr(10) || chr(13))) AS ref_key
  FROM {child} c WHERE c.{field} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM {parent} p WHERE lower(trim(p.{key}, ' ' || chr(9) || chr(10) || chr(13))) = lower(trim(c.{field}, ' ' || chr(9) || chr(10) || chr(13)))
    AND p.loaded_at <= c.loaded_at AND (p.removed_at IS NULL OR c.loaded_at < p.removed_at))"""
    for child, field, parent, key in (("preprocess", "pre_opts", "pre_opts", "pre_opts"), ("assemble", "assemble_opts", "assemble_opts", "assemble_opts"), ("annotate",
        "curate_opts", "curate_opts", "curate_opts"), ("annotations", "id", "annotate", "id"))
)


def _values_sql(blanks: bool) -> str:
    """Values of ``text``: separators of the even pieces become one mark, the pieces are joined and cut at it."""
    p = "p"
    for _ in range(2):
        p = f"regexp_replace({p}, '([0-9]),([0-9])', '\\1\ufdd1\\2', 'g')"
    p = f"regexp_replace(regexp_replace({p}, '(\\s)/', '\\1\ufdd0', 'g'), '/(\\s)', '\ufdd0\\1', 'g')"
    p = f"regexp_replace({p}, '[;|,\\t\\r\\n{' ' if blanks else ''}]', '\ufdd0', 'g')"
    p = f"replace({p}, '\ufdd1', ',')"
    pieces = """string_split(text, '"')"""
    joined = f"""array_to_string(list_transform({pieces}, lambda p, i: CASE WHEN i % 2 = 0 THEN p WHEN p = '' AND i > 1 AND i < len({pieces}) THEN '"' ELSE {p} END), '')"""
    return f"list_filter(list_transform(string_split({joined}, '\ufdd0'), lambda v: trim(v, ' ' || chr(9) || chr(10) || chr(13))), lambda v: v <> '')"


def _packed_sql(table_name: str, key: str, field: str, blanks: bool) -> str:
    return f"""SELECT DISTINCT '{table_name}' AS table_name, '{field}' AS field_name, row_key, i::INT AS pos, v[i] AS item FROM (
  SELECT row_key, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT {key} AS row_key, {_values_sql(blanks)} AS v FROM (SELECT *, {field} AS text FROM {table_name})
    WHERE text IS NOT NULL) WHERE len(v) >= 2)"""


_CALL_KEY = "concat(id, '|', path, '|', scaffold, '|', gene, '|', pos1)"
_CELL = """"[^"]*(?:""[^"]*)*"|[^",]*"""
_OUTER = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(65279)"


def _cells_sql(record: str) -> str:
    return f"""list_transform(regexp_extract_all(',' || {record}, '(?s),({_CELL})', 1), lambda c: CASE WHEN c[1] = '"' THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END)"""


_P6 = f"""
WITH heads AS (SELECT sheet, list_transform({_cells_sql("regexp_replace(ltrim(min(raw), chr(65279)), '[\r\n]+$', '')")}, lambda c: lower(trim(c, {_OUTER}))) AS names
  FROM mapping_test WHERE line_no = 1 GROUP BY sheet
), body AS (SELECT sheet, line_no, raw, regexp_replace(raw, '[\r\n]+$', '') AS record, names FROM mapping_test LEFT JOIN heads USING (sheet) WHERE line_no <> 1
), cut AS (SELECT *, regexp_full_match(record, '(?s)(?:{_CELL})(?:,(?:{_CELL}))*') AS quoted, {_cells_sql("record")} AS cells FROM body
), named AS (SELECT *, quoted AND len(cells) = len(names) AS counted, trim(cells[list_position(names, 'id')], {_OUTER}) AS i, trim(cells[list_position(names, 'taxon')],
  {_OUTER}) AS t, trim(cells[list_position(names, 'r1')], {_OUTER}) AS a, trim(cells[list_position(names, 'r2')], {_OUTER}) AS b FROM cut
), checked AS (
  SELECT *, CASE WHEN names IS NULL THEN 'no header' WHEN NOT quoted THEN 'quoting' WHEN NOT counted THEN 'field count' WHEN i = '' THEN 'id empty'
    WHEN length(i) > 18 THEN 'id too long' WHEN t = '' THEN 'taxon empty'
    WHEN NOT regexp_matches(a, '\\.(fastq|fq)(\\.gz)?$') THEN 'r1 not a read file' WHEN NOT regexp_matches(b, '\\.(fastq|fq)(\\.gz)?$') THEN 'r2 not a read file'
      WHEN a = b THEN 'r1 equals r2' END AS why FROM named
), firsts AS (SELECT sheet, i, min(line_no) AS first_line FROM checked WHERE why IS NULL GROUP BY ALL
), done AS (SELECT c.*, CASE WHEN why IS NULL AND line_no > first_line THEN 'id repeated' ELSE why END AS reason FROM checked c LEFT JOIN firsts USING (sheet, i))"""

def _opened(name: str, source: str, columns: str, value: str, where: str = "true", times: int = 3) -> str:
    """CTEs that open lists of one and text that holds JSON, up to ``times`` deep; the last is ``name``."""
    v = "CASE WHEN json_type(v) = 'ARRAY' AND json_array_length(v) = 1 THEN v->0 WHEN json_type(v) = 'VARCHAR' AND trim(v->>'$')[1] IN ('{', '[', '\"') AND json_valid(v->>'$') THEN (v->>'$')::JSON ELSE v END"
    steps = [f"{name}_0 AS (SELECT {columns}, {value} AS v FROM {source} WHERE {where})"]
    kept = ", ".join(c.split(" AS ")[-1] for c in columns.split(", "))
    for i in range(1, times + 1):
        steps.append(f"{name if i == times else f'{name}_{i}'} AS (SELECT {kept}, {v} AS v FROM {name}_{i - 1})")
    return ", ".join(steps)


_P3_TEXT = "CASE WHEN lower(trim(v->>'$')) IN ('true', 'false') THEN lower(trim(v->>'$')) ELSE trim(v->>'$') END"
_P3_VALUE = "json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND trim(v->>'$') NOT IN ('', 'NA')"
_P3 = f"""
WITH src AS (SELECT DISTINCT curate_opts, params FROM curate_opts
), texts AS (SELECT curate_opts, params, CASE WHEN json_valid(params) THEN params ELSE TRY(decode(from_base64(regexp_replace(params, '\\s', '', 'g')))) END AS t FROM src
), {_opened("doc", "texts", "curate_opts, params", "t::JSON", "t IS NOT NULL AND json_valid(t)")}
, {_opened("sec", "doc, (VALUES ('default_rules'), ('rules')) x(section)", "curate_opts, params, section", "v->section", "json_type(v) = 'OBJECT'")}
, {_opened("item", "(SELECT *, unnest(from_json(v, '[\"JSON\"]')) AS w FROM sec WHERE json_type(v) = 'ARRAY')", "curate_opts, params, section", "w")}
, objects AS (SELECT * FROM item WHERE json_type(v) = 'OBJECT' UNION ALL SELECT * FROM sec WHERE json_type(v) = 'OBJECT')
, {_opened("gene", "objects", "curate_opts, params, section, v AS rule", "v->'gene'")}
, {_opened("entry", f"(SELECT *, unnest(json_keys(rule)) AS name FROM gene WHERE NOT coalesce({_P3_VALUE}, false))", "curate_opts, params, section, name", "json_extract(rule, '$.\"' || name || '\"')")}
, rule AS (SELECT curate_opts, params, section, {_P3_TEXT} AS name, rule AS v FROM gene WHERE {_P3_VALUE} UNION ALL SELECT curate_opts, params, section, name, v
  FROM entry WHERE json_type(v) = 'OBJECT')
, {_opened("field", "rule, (VALUES ('type'), ('count'), ('max_len'), ('min_len'), ('overlap'), ('start_codons'), ('stop_codons')) x(field)", "curate_opts, params, section, name, field", "v->field")}
, {_opened("lap", "(SELECT curate_opts, params, section, name, v FROM field WHERE field = 'overlap' AND json_type(v) = 'OBJECT'), (VALUES ('start'), ('stop')) x(part)", "curate_opts, params, section, name, part", "v->part")}
, {_opened("codon", "(SELECT * FROM (SELECT *, unnest(from_json(v, '[\"JSON\"]')) AS w, generate_subscripts(from_json(v, '[\"JSON\"]'), 1) AS pos FROM field WHERE field LIKE '%codons' AND json_type(v) = 'ARRAY'))", "curate_opts, params, section, name, field, pos", "w")}
, found AS (
  SELECT curate_opts, params, section, name, field, 1 AS pos, {_P3_TEXT} AS item FROM field WHERE field <> 'overlap' AND {_P3_VALUE}
  UNION ALL SELECT curate_opts, params, section, name, 'overlap.' || part, 1, {_P3_TEXT} FROM lap WHERE {_P3_VALUE}
  UNION ALL SELECT curate_opts, params, section, name, field, pos::INT, {_P3_TEXT} FROM codon WHERE {_P3_VALUE})"""
_P3_NUMBER = "regexp_full_match(item, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"
_P3_KIND = f"CASE WHEN field = 'type' THEN 'types' WHEN field LIKE '%codons' THEN 'codons' WHEN field IN ('count', 'max_len', 'min_len') AND {_P3_NUMBER} THEN 'limits' WHEN field = 'overlap.start' AND {_P3_NUMBER} THEN 'overlap_starts' WHEN field = 'overlap.stop' AND item IN ('true', 'false') THEN 'overlap_stops' ELSE 'texts' END"

ORACLE = {
    "p3_found": f"{_P3} SELECT DISTINCT curate_opts, section, name, field, pos, item FROM found",
    "p3_tables": f"""{_P3}, kinds AS (SELECT curate_opts, params, {_P3_KIND} AS subtype FROM found
  UNION ALL SELECT curate_opts, params, 'rules' FROM rule UNION ALL SELECT curate_opts, params, 'sets' FROM doc WHERE json_type(v) = 'OBJECT'
  UNION ALL SELECT curate_opts, params, 'unreadable' FROM src WHERE NOT EXISTS (SELECT 1 FROM doc d WHERE d.curate_opts IS NOT DISTINCT FROM src.curate_opts
    AND d.params = src.params AND json_type(d.v) = 'OBJECT'))
SELECT s.subtype, count(k.subtype) AS n_rows, count(DISTINCT CASE WHEN k.subtype IS NOT NULL THEN (k.curate_opts, coalesce(k.params, '-null-')) END) AS n_documents,
  count(k.subtype) AS n_linked
FROM (VALUES ('sets'), ('unreadable'), ('rules'), ('limits'), ('types'), ('overlap_starts'), ('overlap_stops'), ('codons'), ('texts')) s(subtype) LEFT
  JOIN kinds k USING (subtype) GROUP BY s.subtype""",
    "p1_found": f"{_P1} SELECT id, path, scaffold, direction, before + 1 AS gap_start, s - 1 AS gap_end FROM seen WHERE s > before + 1",
    "p1_covered": f"""{_P1}, marked AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id, path, scaffold,
  direction ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM seen)
SELECT id, path, scaffold, direction, min(s) AS period_start, CASE WHEN count(e) = count(*) THEN max(e) END AS period_end FROM marked GROUP BY id, path, scaffold,
  direction, k""",
    "p2_found": f"SELECT DISTINCT * FROM ({_P2})",
    "p2_report": f"SELECT table_name, period, count(*) AS n_orphans, count(DISTINCT ref_key) AS n_keys FROM (SELECT DISTINCT * FROM ({_P2})) GROUP BY ALL",
    "p4_found": " UNION ALL ".join([_packed_sql("annotations", _CALL_KEY, "warnings", False), _packed_sql("annotations", _CALL_KEY, "notes", False),
        _packed_sql("annotate", "id", "missing", True), _packed_sql("annotate", "id", "extra", True)]),
    "p6_found": f"{_P6} SELECT sheet, line_no FROM done WHERE reason IS NOT NULL",
    "p6_rejects": f"{_P6} SELECT sheet, line_no, reason, raw FROM done WHERE reason IS NOT NULL",
    "p6_valid": f"{_P6} SELECT sheet, line_no, i AS id, t AS taxon, a AS r1, b AS r2 FROM done WHERE reason IS NULL",
}
