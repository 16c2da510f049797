import random

from pyspark.sql import functions as F

from organelia.operators.packed import packed_values, unpack


def parse(text, blanks):
    """The same by a character automaton."""
    out, cur, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cur += '"'
                i += 1
            elif c == '"':
                quoted = False
            else:
                cur += c
        elif c == '"':
            quoted = True
        else:
            before, after = text[i - 1] if i else "", text[i + 1 : i + 2]
            cut = c in ";|\t\r\n" or c == "," and not (before.isdigit() and after.isdigit()) or c == "/" and (before.isspace() or after.isspace()) or blanks and c.isspace()
            if cut:
                out.append(cur)
                cur = ""
            else:
                cur += c
        i += 1
    out.append(cur)
    return [v.strip(" \t\r\n") for v in out if v.strip(" \t\r\n")]


def test_equals_automaton(spark):
    rng = random.Random(1)
    words = ["a", "x y", "12,040", "start/stop", "5' end", "(+2)", "a-b", "c:3"]
    texts = ["\ufdd0;\ufdd1;\ufdd10\ufdd11", '"\ufdd0;" a\ufdd1;b', "", " ", '"', '""', '"a""b";c', '"";b', '"""q""" | z', "1,2,3", "a / b", "x" * 50_000 + ";y"]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(words)
            parts.append(rng.choice([w, f'"{w}"', f'"{w}; {w}"', f'"{w} ""q"" "']))
            parts.append(rng.choice([";", "; ", ",", ", ", " | ", "\t", "\n", " / ", ";;", " ;"]))
        texts.append("".join(parts[:-1]))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", unpack(F.col("text")).alias("a"), unpack(F.col("text"), True).alias("b")).collect():
        assert r["a"] == parse(r["text"], False), r["text"]
        assert r["b"] == parse(r["text"], True), r["text"]


def test_many_quotes_in_one_text(spark):
    text = '"a;b" c;' * 50_000
    got = spark.createDataFrame([(text,)], "text string").select(F.size(unpack(F.col("text"))).alias("n"), unpack(F.col("text"))[49_999].alias("v")).first()
    assert (got["n"], got["v"]) == (50_000, "a;b c")


def test_rows(spark):
    data = [("s", None, 1, "a; b", None, "p q"), ("s", None, 1, "a; b", None, "p q"), ("t", "g", 2, "one", "", ""), (None, "g", 3, None, "x|y", "z")]
    df = spark.createDataFrame(data, "id string, gene string, pos int, notes string, item string, missing string")
    got = sorted(tuple(r) for r in packed_values(df, "t", ["id", "gene"], ["notes", "item", "missing"], ["missing"]).collect())
    assert got == [("t", "item", "|g", 1, "x"), ("t", "item", "|g", 2, "y"), ("t", "missing", "s|", 1, "p"), ("t", "missing", "s|", 2, "q"), ("t", "notes", "s|", 1, "a"), ("t", "notes", "s|", 2, "b")]
    assert packed_values(df.limit(0), "t", ["id"], ["notes"]).count() == 0
