import random

from organelia.operators.rejects import classify_records, rejected_records, valid_records

GOOD = "a{0},Some taxon,a{0}_R1.fastq.gz,a{0}_R2.fq"


def sheet(spark, records, header="ID,Taxon,R1,R2", name="s"):
    data = [(name, 1, header, "x")] + [(name, i, r, "y") for i, r in enumerate(records, 2)]
    return spark.createDataFrame(data, "sheet string, line_no int, raw string, reason string")


def reasons(df):
    return {r["line_no"]: r["reason"] for r in classify_records(df).collect()}


def test_reasons(spark):
    records = [
        GOOD.format(1),
        '"a2","T ""x"", y",a2_R1.fq,"run 1, lane 2/a2_R2.fq"\r',
        "a3,T,a3_R1.fq",
        "a4,T,a4_R1.fq,a4_R2.fq,",
        '"a5,T,a5_R1.fq,a5_R2.fq',
        'a6,T "x",a6_R1.fq,a6_R2.fq',
        'a7, "T",a7_R1.fq,a7_R2.fq',
        " ,T,x_R1.fq,x_R2.fq",
        "a" * 19 + ",T,x_R1.fq,x_R2.fq",
        "a10,  ,x_R1.fq,x_R2.fq",
        "a11,T,x_R1.txt,x_R2.fq",
        "a12,T,x_R1.fq,-",
        "a13,T, x.fq,x.fq ",
        " a1 ,T,y_R1.fq,y_R2.fq",
        None,
        "a16,line\nbreak,x_R1.fq,x_R2.fq",
        '"a17","line\nbreak","x_R1.fq","x_R2.fq"\r\n',
        "",
    ]
    got = reasons(sheet(spark, records, "﻿ID,Taxon,R1,R2\r"))
    expected = [None, None, "field count", "field count", "quoting", "quoting", "quoting", "id empty", "id too long", "taxon empty", "r1 not a read file", "r2 not a read file", "r1 equals r2", "id repeated", "no record", None, None, "field count"]
    assert got == dict(enumerate(expected, 2))


def test_invalid_record_does_not_take_an_id(spark):
    got = reasons(sheet(spark, ["b,T,b_R1.fq,b_R1.fq", "b,T,b_R1.fq,b_R2.fq", "b,T,b_R1.fq,b_R2.fq"]))
    assert got == {2: "r1 equals r2", 3: None, 4: "id repeated"}


def test_column_order_width_and_values(spark):
    df = sheet(spark, ['x_R2.fq,"site ""B""",c,x_R1.fq,T\r'], '"R2","site"," id ","R1","TAXON"').union(sheet(spark, ["d,T,d_R1.fq,d_R2.fq"], name="other"))
    got = {tuple(r) for r in valid_records(classify_records(df)).collect()}
    assert got == {("s", 2, "c", "T", "x_R1.fq", "x_R2.fq"), ("other", 2, "d", "T", "d_R1.fq", "d_R2.fq")}


def test_no_header_null_keys_and_empty(spark):
    df = spark.createDataFrame([("n", 2, GOOD.format(1)), (None, 1, "ID,Taxon,R1,R2"), (None, 2, GOOD.format(1)), ("m", None, "x"), ("m", 1, "ID,Taxon"), ("m", 2, "x,y")], "sheet string, line_no int, raw string")
    out = rejected_records(classify_records(df)).collect()
    assert {r["reason"] for r in out} == {"no header"}
    assert classify_records(df.limit(0)).count() == 0


def test_long_text(spark):
    long = "x" * 200_000
    df = sheet(spark, [f'a,"{long}",a_R1.fq,a_R2.fq', f'b,"{long}"",b_R1.fq,b_R2.fq', "c," + '"",' * 50_000])
    assert reasons(df) == {2: None, 3: "quoting", 4: "field count"}


def test_every_record_is_read_before_it_is_classed(spark):
    """Against the definition, on random records: quoting by a character automaton, count by what lies between its borders."""
    rng = random.Random(4)

    def fields(record):
        out, i = [], 0
        while True:
            if record[i : i + 1] == '"':
                j = i + 1
                while True:
                    j = record.find('"', j)
                    if j < 0:
                        return None
                    if record[j + 1 : j + 2] == '"':
                        j += 2
                        continue
                    break
                out.append(record[i + 1 : j].replace('""', '"'))
                i = j + 1
                if i < len(record) and record[i] != ",":
                    return None
            else:
                j = record.find(",", i)
                j = len(record) if j < 0 else j
                if '"' in record[i:j]:
                    return None
                out.append(record[i:j])
                i = j
            if i >= len(record):
                return out
            i += 1

    records = ["".join(rng.choice(['"', '"', ",", ",", "a", " ", "\n", '""', "b_R1.fq"]) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    records += [",".join([GOOD.format(900 + i)] + [rng.choice(["", '"x"', '"a,b"', 'a"', '"a""b"'])]) for i in range(40)]
    df = sheet(spark, records, "ID,Taxon,R1,R2,note").union(sheet(spark, records, "ID,Taxon,R1,R2,note,b,c", "wide"))
    got = {(r["sheet"], r["line_no"]): (r["reason"], r["raw"]) for r in classify_records(df).collect()}
    for name, width in (("s", 5), ("wide", 7)):
        for i, record in enumerate(records, 2):
            stripped = record.rstrip("\r\n")
            cells = fields(stripped)
            reason, raw = got[name, i]
            assert raw == record
            if cells is None:
                assert reason == "quoting", record
            elif len(cells) != width or not stripped:
                assert reason == "field count", record
            else:
                assert reason not in ("quoting", "field count"), record


def test_one_very_wide_record(spark):
    df = sheet(spark, [GOOD.format(1), "," * 120_000, GOOD.format(2)])
    assert reasons(df) == {2: None, 3: "field count", 4: None}
