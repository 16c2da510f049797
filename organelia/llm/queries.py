"""The queries of the problems on documents and sequences, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from organelia.llm.lookalike import classes, consistent_text, equal_looking_pairs
from organelia.llm.mixture import Target, mix_sources, mixture_faults
from organelia.llm.neardup import assembly_key, near_duplicates, similar_pairs
from organelia.llm.packing import fill_report, pack_documents, packing_faults
from organelia.llm.tokens import TOKENIZER
from organelia.session import table

#: Rows of a parameter table that are read to the driver; a larger one is refused.
PARAMETER_ROWS = 1000


def _parameters(df: DataFrame) -> list:
    rows = df.limit(PARAMETER_ROWS + 1).collect()
    if len(rows) > PARAMETER_ROWS:
        raise ValueError(f"a parameter table may have {PARAMETER_ROWS} rows at most")
    return rows


def _assemblies(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, base, "assemblies"), assembly_key(), F.col("sequence"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return similar_pairs(*_assemblies(spark, base))


def p5_classes(spark: SparkSession, base: str) -> DataFrame:
    """Each assembly with its class of equal word sets and the class's number of links."""
    members, links = _assemblies(spark, base)
    names = members.groupBy("fp").agg(F.min("key").alias("class_id"), F.count("*").alias("n_members"))
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    return members.join(names, "fp").join(degree, "fp", "left").select("key", "class_id", "n_members", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _capacities(spark: SparkSession, base: str) -> dict[str, int]:
    return {r["pack_name"]: r["capacity"] for r in _parameters(table(spark, base, "pack_sizes"))}


def _tokenizer(spark: SparkSession) -> str:
    return spark.conf.get("spark.organelia.tokenizer", TOKENIZER)


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    return pack_documents(table(spark, base, "documents"), _capacities(spark, base), _tokenizer(spark))


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    return fill_report(p7_containers(spark, base), _capacities(spark, base))


def p7_faults(spark: SparkSession, base: str) -> DataFrame:
    """Counts of what is wrong with the containers: all 0."""
    return packing_faults(p7_containers(spark, base), table(spark, base, "documents"), _capacities(spark, base), _tokenizer(spark))


def _mix(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    targets = [Target(r["source"], r["target_share"], r["max_repeats"]) for r in _parameters(table(spark, base, "mix_targets"))]
    return mix_sources(table(spark, base, "documents"), targets, path=_tokenizer(spark))


def p8_chosen(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[0]


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[1]


def p8_faults(spark: SparkSession, base: str) -> DataFrame:
    """Counts of what is wrong with the mixture: all 0."""
    targets = [Target(r["source"], r["target_share"], r["max_repeats"]) for r in _parameters(table(spark, base, "mix_targets"))]
    return mixture_faults(*_mix(spark, base), table(spark, base, "documents"), targets, _tokenizer(spark))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return equal_looking_pairs(classes(table(spark, base, "documents")))


def p9_forms(spark: SparkSession, base: str) -> DataFrame:
    """Each document with its class and the class's one form of the text."""
    documents = table(spark, base, "documents")
    return consistent_text(documents, classes(documents)).select("doc_id", "class_id", F.md5("text").alias("form_md5"), F.length("text").alias("form_chars"))


QUERIES = {f.__name__: f for f in (p5_found, p5_classes, p7_containers, p7_fill, p7_faults, p8_chosen, p8_shares, p8_faults, p9_found, p9_forms)}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The look-alikes of the SQL are its own list: what the test texts contain and some of their kin.
_SQL_WIDE = "！＂＃＄％＆＇（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ［＼］＾＿｀ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｜｝～"
_SQL_PLAIN = """!"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"""
_SQL_OTHER = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝёЁїЇѐЀӑӐӓӒӧӦΑΒΕΖΗΙΚΜΝΟΡΤΥΧονµόΌΆΈΊΎ", "ABESIJKMHOPCTYXaesijopcyxhdqwëËïÏèÈăĂäÄöÖABEZHIKMNOPTYXovμóÓÁÉÍÝ")
_SQL_REMOVED = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_SQL_BLANKS = "\u00a0\u2002\u2003\u2007\u2009\u200a\u202f\u3000"
_SQL_JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def _look_alike_sql(column: str) -> str:
    """Each look-alike replaced by its own rule; what has no rule here would show as a difference."""
    source = _SQL_WIDE + _SQL_OTHER[0] + _SQL_BLANKS + "‐‑"
    target = _SQL_PLAIN + _SQL_OTHER[1] + " " * len(_SQL_BLANKS) + "--"
    form = f"translate(regexp_replace({column}, '[{_SQL_REMOVED}]', '', 'g'), {_text(source)}, {_text(target)})"
    for joined, letters in _SQL_JOINED.items():
        form = f"replace({form}, '{joined}', '{letters}')"
    return form


# The words of each sequence, joined on the word: every pair that shares one is counted.
_P5_SETS = """
WITH keyed AS (
  SELECT DISTINCT id || '.' || path || '.' || scaffold AS key, upper(sequence) AS s FROM assemblies
  WHERE id IS NOT NULL AND path IS NOT NULL AND scaffold IS NOT NULL AND sequence IS NOT NULL
), cut AS (SELECT key, substr(s, i::INT, 16) AS w FROM (SELECT key, s, unnest(range(1, greatest(length(s) - 14, 1))) AS i FROM keyed)
), words AS (
  SELECT DISTINCT key, hash(least(w, reverse(translate(w, 'ACGT', 'TGCA')))) AS w FROM cut WHERE regexp_full_match(w, '[ACGT]{16}')
), sizes AS (SELECT key, count(*) AS n, bit_xor(w) AS x, sum(w) AS y FROM words GROUP BY key
), common AS (SELECT w FROM words GROUP BY w HAVING count(*) > 1
), held AS (SELECT key, w FROM words SEMI JOIN common USING (w)
), shared AS (SELECT a.key AS key_a, b.key AS key_b, count(*) AS k FROM held a JOIN held b ON a.w = b.w AND a.key < b.key GROUP BY 1, 2
), pairs AS (
  SELECT key_a, key_b, k / (x.n + y.n - k) AS similarity FROM shared JOIN sizes x ON x.key = key_a JOIN sizes y ON y.key = key_b
  WHERE k >= 0.5 * (x.n + y.n - k)
)"""

_P9_CLASSES = f"""
WITH docs AS (SELECT doc_id, text, {_look_alike_sql("text")} AS looked FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), forms AS (SELECT doc_id, text, looked, nfc_normalize(looked) AS form FROM docs
), firsts AS (SELECT form, min(doc_id) AS class_id FROM forms GROUP BY form)"""

ORACLE = {
    "p5_found": f"{_P5_SETS} SELECT key_a, key_b FROM pairs",
    "p5_classes": f"""{_P5_SETS}, named AS (SELECT key, min(key) OVER (PARTITION BY n, x, y) AS class_id, count(*) OVER (PARTITION BY n, x, y) AS n_members FROM sizes
), ends AS (SELECT key_a AS key, key_b AS other FROM pairs UNION ALL SELECT key_b, key_a FROM pairs
), degree AS (SELECT e.key, count(DISTINCT o.class_id) AS n_links FROM ends e JOIN named o ON o.key = e.other JOIN named m ON m.key = e.key
  WHERE o.class_id <> m.class_id GROUP BY e.key)
SELECT key, class_id, n_members, coalesce(n_links, 0) AS n_links FROM named LEFT JOIN degree USING (key)""",
    # Every document once, nothing wrong, whatever the containers are.
    "p7_faults": "SELECT pack_name, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_documents, 0 AS n_overfull, 0 AS n_cut, 0 AS n_broken FROM pack_sizes",
    # Every source with a target, and nothing wrong, whatever was chosen.
    "p8_faults": "SELECT lower(trim(source)) AS source, 0 AS n_foreign, 0 AS n_repeated, 0 AS n_misjudged, false AS off_target FROM mix_targets WHERE target_share > 0 AND max_repeats > 0",
    "p9_found": f"""{_P9_CLASSES}
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_forms": f"""{_P9_CLASSES}
SELECT f.doc_id, c.class_id, md5(m.looked) AS form_md5, length(m.looked)::INT AS form_chars FROM forms f JOIN firsts c USING (form) JOIN forms m ON m.doc_id = c.class_id""",
}
