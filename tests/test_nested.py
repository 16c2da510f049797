import base64
import json
import random

from pyspark.sql import functions as F

from organelia.operators.nested import State, classify, rule_nodes, rule_tables, rule_values, shred, unwrap


def values(doc):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    return {r[4:] for r in shred("s", text) if r[8] is not None}


PLAIN = {"default_rules": {"PCG": {"count": 1, "overlap": {"start": 2, "stop": False}, "start_codons": ["ATG", "GTG"]}}, "rules": {"cox1": {"type": "PCG", "max_len": 1600}}}
EXPECTED = {
    ("default_rules", "PCG", "count", 1, "1"),
    ("default_rules", "PCG", "overlap.start", 1, "2"),
    ("default_rules", "PCG", "overlap.stop", 1, "false"),
    ("default_rules", "PCG", "start_codons", 1, "ATG"),
    ("default_rules", "PCG", "start_codons", 2, "GTG"),
    ("rules", "cox1", "type", 1, "PCG"),
    ("rules", "cox1", "max_len", 1, "1600"),
}


def test_shapes_that_mean_the_same():
    assert values(PLAIN) == EXPECTED
    boxed = {"default_rules": [{"PCG": [{"count": ["1"], "overlap": [{"start": [2], "stop": ["FALSE"]}], "start_codons": '["ATG","GTG"]'}]}], "rules": [{"gene": ["cox1"], "type": "PCG", "max_len": [[1600]]}]}
    assert values(boxed) == EXPECTED
    assert values([boxed]) == EXPECTED
    assert values(json.dumps(json.dumps(PLAIN))) == EXPECTED
    assert values(base64.b64encode(json.dumps(PLAIN).encode()).decode()) == EXPECTED
    listed = dict(PLAIN, rules=json.dumps([{"gene": "cox1", "type": "PCG", "max_len": 1600}, {"gene": None, "type": "PCG"}]))
    assert values(listed) == EXPECTED


def test_absent_values_give_no_row():
    doc = {"rules": {"a": {"count": None, "max_len": [], "min_len": "NA", "type": "", "overlap": {}, "stop_codons": [None, "TAA"]}, "b": 3}}
    assert values(doc) == {("rules", "a", "stop_codons", 2, "TAA")}


def test_unreadable():
    for text in (None, "", "  ", "{", "[1, 2]", "5", "!!", '"x"'):
        assert [r[3] for r in shred("s", text)] == ["unreadable"]
    deep = "[" * 100_000 + "]" * 100_000
    assert [r[3] for r in shred("s", deep)] == ["unreadable"]


def nested(depth, inner):
    return '{"a":[0,' * depth + inner + "]}" * depth


def test_deep_documents():
    rule = '{"cob":{"type":"PCG","max_len":9}}'
    for depth in (10, 300, 900):
        assert values(f'{{"other":{nested(depth, "1")},"rules":{rule}}}') == {("rules", "cob", "type", 1, "PCG"), ("rules", "cob", "max_len", 1, "9")}
        assert [r[3] for r in shred("s", f'{{"rules":{{"cob":{nested(depth, rule)}}}}}')] == ["set", "rule"]
    for depth in (1_500, 10_000, 200_000):
        # Either read or unreadable, by what the parser takes; never an error.
        assert {r[3] for r in shred("s", f'{{"other":{nested(depth, "1")},"rules":{rule}}}')} <= {"unreadable", "set", "rule", "type", "limit"}
    assert values('{"rules":' + "[" * 800 + rule + "]" * 800 + "}") == {("rules", "cob", "type", 1, "PCG"), ("rules", "cob", "max_len", 1, "9")}


def test_states():
    assert classify([["x"]]).states == State.VALUES | State.TEXT
    assert classify("350").states == State.VALUES | State.NUMBER and classify(True).states == State.VALUES | State.LOGICAL
    assert not classify({"a": None}).states & (State.RULES | State.OVERLAP | State.NAMED)
    assert classify({"start": "2"}).states & State.OVERLAP and not classify({"start": []}).states & State.OVERLAP
    assert classify([{"gene": "a"}, {"gene": "b"}]).states == State.RULES
    assert classify({"cob": {"type": "PCG"}}).states & State.RULES and not classify({"cob": 3}).states & State.RULES
    assert unwrap('"[\\"x\\"]"') == "x"


def test_variants_go_to_typed_tables(spark):
    doc = {"rules": {"a": {"type": "PCG", "count": "two", "max_len": "35", "min_len": 3.5, "overlap": {"start": "FALSE", "stop": "false"}}}}
    nodes = rule_nodes(spark.createDataFrame([("s", json.dumps(doc))], "curate_opts string, params string"))
    tables = rule_tables(nodes)
    rows = lambda t: sorted((r["field"], r["item"], r["value"]) for r in tables[t].collect())
    assert rows("limits") == [("max_len", "35", 35.0), ("min_len", "3.5", 3.5)]
    assert rows("texts") == [("count", "two", "two"), ("overlap.start", "false", "false")]
    assert rows("overlap_stops") == [("overlap.stop", "false", False)]


def test_tables_keep_links(spark):
    df = spark.createDataFrame([("s", json.dumps(PLAIN), "x"), ("s", json.dumps(PLAIN), "y"), (None, None, None), ("bad", "{", None)], "curate_opts string, params string, set_key string")
    got = {tuple(r) for r in rule_values(df).collect()}
    assert got == {("s", *v) for v in EXPECTED}
    tables = rule_tables(rule_nodes(df.select("curate_opts", "params").distinct()))
    assert {k: t.count() for k, t in tables.items()} == {"sets": 1, "unreadable": 2, "rules": 2, "limits": 2, "types": 1, "overlap_starts": 1, "overlap_stops": 1, "codons": 2, "texts": 0}
    parents = tables["rules"].select(F.col("node_id").alias("parent_id"), F.col("name").alias("rule"))
    linked = tables["codons"].join(parents, "parent_id").select("rule").distinct().collect()
    assert [r[0] for r in linked] == ["PCG"]
    assert rule_values(df.limit(0)).count() == 0


def test_random_shapes():
    rng = random.Random(12)

    def shape(node):
        if isinstance(node, dict):
            node = {k: shape(v) for k, v in node.items()}
        elif isinstance(node, list):
            node = [shape(v) for v in node]
        for _ in range(rng.randint(0, 2)):
            node = [node] if rng.random() < 0.6 or not isinstance(node, (dict, list)) else json.dumps(node)
        return node

    for _ in range(200):
        rules, expected = {}, set()
        for gene in rng.sample(["cox1", "trnF", "cob", "T", "12"], rng.randint(1, 4)):
            rule = {"type": rng.choice(["PCG", "tRNA"])}
            expected.add(("rules", gene, "type", 1, rule["type"]))
            if rng.random() < 0.5:
                rule["count"] = rng.choice([1, "2", 350])
                expected.add(("rules", gene, "count", 1, str(rule["count"])))
            if rng.random() < 0.5:
                rule["overlap"] = {"start": 5, "stop": rng.choice([True, "FALSE"])}
                expected |= {("rules", gene, "overlap.start", 1, "5"), ("rules", gene, "overlap.stop", 1, str(rule["overlap"]["stop"]).lower())}
            if rng.random() < 0.5:
                rule["stop_codons"] = rng.sample(["TAA", "TAG", "T", "AG"], rng.randint(1, 4))
                expected |= {("rules", gene, "stop_codons", i, c) for i, c in enumerate(rule["stop_codons"], 1)}
            if rng.random() < 0.3:
                rule["max_len"] = rng.choice([None, [], "NA", "", [None]])
            rules[gene] = rule
        if rng.random() < 0.5:
            rules = [{"gene": g, **r} for g, r in rules.items()]
        text = json.dumps(shape({"rules": rules, "other": [1, {"x": 2}]}))
        if rng.random() < 0.3:
            text = base64.b64encode(text.encode()).decode()
        assert values(text) == expected, text
