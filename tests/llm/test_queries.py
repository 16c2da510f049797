import os

import pytest

from organelia.llm import queries
from tests.test_queries import DATA, same

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    same(spark, queries.QUERIES, queries.ORACLE, name)


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
