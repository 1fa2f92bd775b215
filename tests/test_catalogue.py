import os

import oracle
import pytest

from quillstone.plans.catalogue import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, con, name):
    oracle.same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, oracle.FOLDER)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry_runs_without_the_training_package(spark):
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
