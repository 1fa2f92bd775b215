import os

import oracle
import pytest

from quillstone.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, con, name):
    oracle.same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.FOLDER).count() > 0
