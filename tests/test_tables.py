import json
from datetime import datetime

from pyspark.sql import functions as F

from organelia.operators import dml
from organelia.sinks import files as K
from organelia.sources import files as R
from organelia.streaming.ingest import file_stream, ingest, last_values, sessions


def rows(df, *cols):
    return sorted([tuple(r) for r in (df.select(*cols) if cols else df).collect()], key=str)


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id int, v string, w string")
    new = spark.createDataFrame([(2, None), (4, "d")], "id int, v string")
    assert rows(dml.upsert_rows(old, new, ["id"])) == [(1, "a", "x"), (2, None, "y"), (3, "c", None), (4, "d", None)]
    assert rows(dml.update_rows(old, new, ["id"])) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]
    assert rows(dml.insert_rows(old, new, ["id"])) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None), (4, "d", None)]
    assert rows(dml.replace_rows(old, new, ["id"])) == [(1, "a", "x"), (2, None, None), (3, "c", None), (4, "d", None)]
    assert rows(dml.delete_rows(old, new, ["id"]), "id") == [(1,), (3,)]
    assert rows(dml.duplicate_keys(old.union(old.where("id = 1")), ["id"])) == [(1, 2)]
    gen = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None)], "id string, stamp int")
    now = spark.createDataFrame([("a", 2)], "id string, stamp int")
    assert rows(dml.purge_generations(gen, now, ["id"], "stamp")) == [("a", 2), ("b", 1), ("b", None)]
    assert dml.add_columns(old, {"v": "string", "z": "int"}).columns == ["id", "v", "w", "z"]


def test_checked_changes(spark):
    old = spark.createDataFrame([(1, "a", "no"), (2, "b", "yes")], "id int, v string, w string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (1, "p"), (1, "q")], "id int, v string")
    assert rows(dml.update_rows(old, new, ["id"])) == [(1, "q", "no"), (2, "x", "yes")]
    table, refused = dml.checked_update(old, new, ["id"])
    assert rows(table) == [(1, "a", "no"), (2, "x", "yes")] and rows(refused) == [(1, "p", "repeated key"), (1, "q", "repeated key"), (3, "y", "unknown key")]
    table, refused = dml.checked_insert(old, new.where("id <> 1").unionAll(spark.createDataFrame([(4, "z"), (4, "z")], "id int, v string")), ["id"], {"w": "no"})
    assert rows(table) == [(1, "a", "no"), (2, "b", "yes"), (3, "y", "no")] and rows(refused) == [(2, "x", "known key"), (4, "z", "repeated key"), (4, "z", "repeated key")]
    assert rows(dml.add_columns(old, {"n": ("int", 5), "v": "string", "z": "string"}))[0] == (1, "a", "no", 5, None)
    assert rows(dml.migrate(spark.createDataFrame([(1, None), (2, "yes")], "id int, reviewed string"), {"reviewed": ("string", "no"), "n": "int"})) == [(1, "no", None), (2, "yes", None)]


def test_keyed_table_writes_only_what_changes(spark, tmp_path):
    folder = str(tmp_path / "keyed")
    first = spark.range(1000).selectExpr("id", "cast(id as string) as v", "'x' as key_name")
    assert dml.change_keyed(spark, folder, first, ["id"], dml.replace_rows, 16) == 1
    change = spark.createDataFrame([(5, "new", "y"), (5000, "more", "y")], "id long, v string, key_name string")
    assert dml.change_keyed(spark, folder, change, ["id"], dml.replace_rows, 99) == 2
    assert len(list((tmp_path / "keyed" / "data" / "v000002").glob("key_hash=*"))) <= 2
    got = {r["id"]: r["v"] for r in dml.read_keyed(spark, folder).collect()}
    assert len(got) == 1001 and got[5] == "new" and got[6] == "6" and got[5000] == "more"
    assert dml.read_keyed(spark, folder, 1).count() == 1000
    assert dml.change_keyed(spark, folder, change.limit(0), ["id"], dml.replace_rows) == 2
    gone = dml.change_keyed(spark, folder, first.select("id", "v", "key_name"), ["id"], dml.delete_rows)
    assert rows(dml.read_keyed(spark, folder, gone), "id") == [(5000,)]
    dml.change_keyed(spark, folder, change, ["id"], dml.delete_rows)
    assert dml.read_keyed(spark, folder).count() == 0 and dml.read_keyed(spark, folder).columns == ["id", "v", "key_name"]


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert dml.latest_version(spark, folder) is None
    assert dml.write_version(spark.range(2), folder) == 1 and dml.write_version(spark.range(3), folder) == 2
    (tmp_path / "t" / "v000003").mkdir()
    assert dml.latest_version(spark, folder) == 2 and dml.read_version(spark, folder).count() == 3 and dml.read_version(spark, folder, 1).count() == 2


def test_fasta_and_headers(spark, tmp_path):
    f = tmp_path / "a.fasta"
    f.write_text(">my.id.1.2 circular\nACGT\nAC\n>b.1.1 linear\n\n>No assembly found\n")
    assert rows(R.assemblies_fasta(spark, str(f))) == [("b", 1, 1, "linear", ""), ("my.id", 1, 2, "circular", "ACGTAC")]
    p = tmp_path / "p.fas"
    p.write_text(">NC_1:nad4l-+-10-300 Some taxon\nMK\nL\n")
    assert rows(R.protein_fasta(spark, str(p))) == [("NC_1", "nad4l", "+", 10, 300, "Some taxon", "MKL")]
    g = tmp_path / "result.fas"
    g.write_text(">S1.1.1; 2790-3764; +; nad1\nAC\n>S1.1.1; 16400-30; +; OH_0\nAC\n")
    assert rows(R.gene_call_headers(spark, str(tmp_path), glob="result.fas", recursive=True), "contig", "pos1", "pos2", "gene_id", "gene") == [("S1.1.1", 16400, 30, "OH_0", "OH"), ("S1.1.1", 2790, 3764, "nad1", "nad1")]


def test_tabular_sources(spark, tmp_path):
    f = tmp_path / "counts.tsv"
    f.write_text("c\t1\tA\t10\t=:0\tA:9:x\tC:1:x\tG:0:x\tT:0:x\tN:0:x\nc\t2\tN\t0\t=:0\tA:0\tC:0\tG:0\tT:0\tN:0\n")
    assert rows(R.read_counts(spark, str(f))) == [("c", 1, "A", 10.0, 9.0, 0.1), ("c", 2, "N", 0.0, None, None)]
    s = tmp_path / "stats.csv"
    s.write_text("SeqId,Position,Call,Depth,Correct,ErrorRate,MeanDepth,GC\nS,1,A,12,12,0,#3.5,\nS,2,A,12,12,0.1,3.5,0.4\n")
    assert rows(R.coverage_stats(spark, str(s)), "position", "mean_depth", "error_rate", "gc", "mask") == [(1, 3.5, 0.0, None, True), (2, 3.5, 0.1, 0.4, False)]
    t = tmp_path / "trna.tsv"
    t.write_text("Sequence\t\ttRNA\nName\ttRNA #\tBegin\n--------\t------\t-----\nS1 \t1\t100\t30\tPhe\tGAA\t0\t0\t50.1\t\n")
    assert rows(R.trna_table(spark, str(t)), "seq", "begin", "end", "type", "anticodon", "score") == [("S1", 100, 30, "Phe", "GAA", 50.1)]
    b = tmp_path / "hits.tsv"
    b.write_text("NC_1:nad1-+-1-9 Some taxon\t1e-30\n")
    assert rows(R.search_hits(spark, str(b))) == [("NC_1", "Some taxon", 1e-30)]
    j = tmp_path / "fastp.json"
    j.write_text(json.dumps({"summary": {"before_filtering": {"total_reads": 10}, "after_filtering": {"total_reads": "x", "read1_mean_length": 99}}}))
    assert rows(R.trimming_report(spark, str(j))) == [(10, None, 99)]
    c = tmp_path / "x.config"
    c.write_text("params.publishDir = 'out'\n  genetic_code = 2\nother = 1\n")
    assert rows(R.config_values(spark, str(c), ["publishDir", "genetic_code"])) == [("genetic_code", "2"), ("publishDir", "out")]
    m = tmp_path / "map.csv"
    m.write_text('ID,Taxon\n007,"a, ""b"""\n')
    assert rows(R.mapping_sheet(spark, str(m))) == [("007", 'a, "b"')]
    y = tmp_path / "sum.tsv"
    y.write_text("name\tcircular\na\tyes\nb\tno\n")
    assert rows(R.assembly_summary(spark, str(y)), "name", "topology") == [("a", "circular"), ("b", "linear")]
    assert R.files_of(spark, str(tmp_path), "*.tsv").count() == 4


def test_genbank(spark, tmp_path):
    record = 'LOCUS       {0} 12 bp\nDEFINITION  a fish.\n  ORGANISM  Piscis\nFEATURES             Location/Qualifiers\n     source          1..12\n                     /organelle="mitochondrion"\n{1}ORIGIN\n        1 acgtac gtacgt\n//\n'
    gene = "     gene            1..3\n     CDS             1..3\n                     /product=\"NADH\n                     one\"\n"
    f = tmp_path / "x.gb"
    f.write_text(record.format("A1", gene) + record.format("A2", gene) + record.format("A3", "").replace("acgtac", "tttttt"))
    got = R.genbank_classes(R.genbank(spark, str(f))).collect()
    assert {(r["name"], r["class"], r["organelle"], r["sequence"]) for r in got} == {("A1", "single", "mitochondrion", "ACGTACGTACGT"), ("A3", "none", "mitochondrion", "TTTTTTGTACGT")}
    assert [r["products"] for r in got if r["name"] == "A1"] == [["NADH one"]]


CALL = "seq_name string, type string, gene string, product string, pos1 long, pos2 long, direction string, anticodon string, start_codon string, stop_codon string, start_codons array<string>, genetic_code int, contig_length long, topology string"


def test_feature_lines(spark, tmp_path):
    data = [
        ("s", "PCG", "nad1", "p1", 5, 30, "-", None, "CTG", "T", ["ATG"], 2, 100, "circular"),
        ("s", "tRNA", "trnF", "tRNA-Phe", 96, 5, "+", "GAA", None, None, None, 2, 100, "circular"),
        ("s", "ctrl", "ctrl", None, 40, 60, "+", None, None, None, None, 2, 100, "circular"),
    ]
    d = K.codon_notes(spark.createDataFrame(data, CALL))
    table = K.feature_table(d).orderBy("pos1", "n").collect()
    assert [r["line"] for r in table][:3] == ["30\t5>\tgene", "\t\t\tgene\tnad1", "30\t5>\tCDS"]
    assert "\t\t\tnote\tstart codon not determined; " + K.COMPLETED in [r["line"] for r in table]
    assert "\t\t\tnote\tanticodon:gaa" in [r["line"] for r in table] and "40\t60\tD-loop" in [r["line"] for r in table]
    lines = K.gff3(d).unionByName(K.gff3_heads(d.select("seq_name", "contig_length").distinct())).orderBy("pos1", "gene", "n").collect()
    text = [r["line"].split("\t") for r in lines]
    assert text[0] == ["##gff-version 3"] and text[1][2:5] == ["region", "1", "100"]
    assert [x[3:5] for x in text if x[2:3] == ["tRNA"]] == [["96", "105"]]
    K.write_lines(K.feature_table(d), str(tmp_path / "tbl"), by="seq_name", order=["pos1", "n"])
    assert spark.read.text(str(tmp_path / "tbl")).count() == len(table)
    K.write_csv(d.select("gene", "product"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    cut, moved = K.end_trimmed(spark.createDataFrame([("l", 11, 90)], "id string, pos1 long, pos2 long"), spark.createDataFrame([("l", "linear", "A" * 100), ("e", "linear", "AC")], "id string, topology string, sequence string"), ["id"])
    assert rows(cut.select("id", F.length("sequence"))) == [("e", 2), ("l", 80)] and rows(moved, "pos1", "pos2") == [(1, 80)]


def test_streams(spark, tmp_path):
    schema = "id string, v int, loaded_at timestamp_ntz"
    at = lambda h: datetime(2024, 1, 1, h)
    inbox, target, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    spark.createDataFrame([("a", 1, at(1)), ("a", 2, at(2)), ("b", 1, at(1))], schema).write.parquet(inbox)
    ingest(file_stream(spark, inbox, schema), target, ["id"], mark).awaitTermination()
    assert rows(dml.read_keyed(spark, target), "id", "v") == [("a", 2), ("b", 1)]
    spark.createDataFrame([("b", 5, at(3)), ("c", 1, at(3))], schema).write.mode("append").parquet(inbox)
    ingest(file_stream(spark, inbox, schema), target, ["id"], mark).awaitTermination()
    assert rows(dml.read_keyed(spark, target), "id", "v") == [("a", 2), ("b", 5), ("c", 1)]
    e = spark.createDataFrame([("u", at(1)), ("u", at(2)), ("u", at(9)), ("u", None)], "k string, ts timestamp")
    assert sorted(r["n_events"] for r in sessions(e, ["k"], "ts", "3 hours").collect()) == [1, 2]
    log = spark.createDataFrame([("k", "a", 1), ("k", "b", 2)], "k string, v string, n int")
    assert rows(last_values(log, ["k"], "v", ["n"])) == [("k", "b")]
