from datetime import UTC, datetime

from pyspark.sql import functions as F

from organelia.functions import stamps as S
from organelia.functions import text as X
from organelia.plans import models as M
from organelia.sources import files as R

AT = datetime(2024, 1, 31, 23, 59, 59, tzinfo=UTC)


def test_stamps(spark):
    assert S.run_stamp(AT) == 1706745599 and S.file_name("project", "csv", AT) == "project_2024-01-31_235959_UTC.csv"
    assert abs(S.run_stamp() - datetime.now(UTC).timestamp()) < 5
    d = spark.createDataFrame([("a", 5)], "id string, time_stamp long")
    assert tuple(S.stamped(d, 7, edited=True).first()) == ("a", 7, 1) and tuple(S.stamped(d, 7).first()) == ("a", 7)
    assert d.select(S.report_date(F.lit(AT.date()))).first()[0] == "January 31, 2024" and d.select(S.report_date()).first()[0]


def test_small_texts(spark):
    d = spark.createDataFrame([("it's", "trnF|rrnS|trnL|cob", "a1b22")], "t string, s string, p string")
    r = d.select(X.shell_quote(F.col("t")), X.bullets(F.col("s")), *X.named_groups(F.col("p"), r"([a-z])(\d+)b(\d+)", ["x", "y", "z"])).first()
    assert tuple(r) == ("'it'\\''s'", "•|rrnS|•|cob", "a", "1", "22")
    m = spark.createDataFrame([("g", "k", 1), ("g", "k", 2), ("g", None, 3), ("g", "l", None)], "g string, k string, v int").groupBy("g").agg(X.named_values(F.col("k"), F.col("v")).alias("m")).first()["m"]
    assert m == {"k": 2, "l": None}


def test_files_by_name(spark, tmp_path):
    for n in ("S1_assembly_0.fasta", "S1_assembly_12.fasta", "S1.fasta", "x.txt"):
        (tmp_path / n).write_text(">a\nAC\n>b\nACGT\n>a\nA\n")
    assert R.files_of(spark, str(tmp_path), "*.fasta", r".*_assembly_\d+\.fasta").count() == 2
    assert tuple(R.fasta_summary(R.fasta(spark, str(tmp_path / "S1.fasta"))).first()) == (3, 2, 1, 4, 7)
    (tmp_path / "hits.tsv").write_text("NC_1:nad1---1-9 Some taxon\t1e-30\tMKL\n")
    assert tuple(R.search_hits(spark, str(tmp_path / "hits.tsv"), True).first()) == ("NC_1", "Some taxon", 1e-30, "MKL")
    (tmp_path / "p.fas").write_text(">NC_1:nad4l---10-300 A taxon\nMK\n>NC_2:nad-4-+-1-3 B\nM\n")
    assert {tuple(r)[1:5] for r in R.protein_fasta(spark, str(tmp_path / "p.fas")).collect()} == {("nad4l", "-", 10, 300), ("nad-4", "+", 1, 3)}


def test_reset_and_paths(spark):
    annotate = spark.createDataFrame([("a", "x", "y", 2, 1, "yes", "s"), ("a", "x", "y", 2, 1, "yes", "t"), ("b", "x", None, 2, 0, "no", "s")], "id string, annotate_opts string, curate_opts string, annotate_switch long, annotate_lock long, reviewed string, structure string")
    got = {tuple(r) for r in M.reset_annotations(annotate, spark.createDataFrame([("a",), ("z",)], "id string")).collect()}
    assert got == {("a", "x", "y", 1, 0, "no", None), ("b", "x", None, 2, 0, "no", "s")}
    s = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("b", 1, 0), ("b", 2, 0), ("c", 1, 0), ("c", 2, 1)], "id string, path int, ignore int")
    assert [tuple(r) for r in M.several_paths(s).collect()] == [("b", 2)]
    r = M.read_paths(spark.createDataFrame([("r.fq", None)], "r1 string, r2 string"), "/raw").first()
    assert (r["r1_path"], r["r2_path"]) == ("/raw/r.fq", None)
    opts = spark.createDataFrame([("o", 1, None, 1), ("o", 2, None, 2), ("p", 1, 5, 3), (None, 1, None, 1)], "o string, loaded_at int, removed_at int, cpus int")
    assert [(r["o"], r["cpus"]) for r in M.live(opts, "o").collect()] == [("o", 2)]
