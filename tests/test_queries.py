"""Each query against its SQL on the smallest data, and the entry without the optional subpackage."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from organelia.plans import edits, engine, formats, models, problems, rules

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
QUERIES = problems.QUERIES | engine.QUERIES | rules.QUERIES | models.QUERIES | formats.QUERIES | edits.QUERIES
ORACLE = problems.ORACLE | engine.ORACLE | rules.ORACLE | models.ORACLE | formats.ORACLE | edits.ORACLE

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def connect(folder=DATA):
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def same(spark, queries, sql, name):
    df = queries[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = connect().execute(sql[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    same(spark, QUERIES, ORACLE, name)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['organelia.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert 'p1_found' in n and 'p5_found' not in n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_workers_need_no_installed_package(tmp_path):
    code = f"""import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from organelia.operators.nested import rule_values
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert rule_values(spark.createDataFrame([("s", '{{"rules":{{"a":{{"type":"PCG"}}}}}}')], "curate_opts string, params string")).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, capture_output=True)
