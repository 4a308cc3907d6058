"""Every registered query against its oracle SQL, over the smallest data folder."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from compare import differences, duck

DATA = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    result = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE:
        assert not differences(result, duck(DATA).execute(ORACLE[name]).df())
