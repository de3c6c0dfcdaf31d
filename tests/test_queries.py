import pytest

import __spark_entry__ as entry
from conftest import DATA
from compare import compare, oracle


@pytest.fixture(scope="module")
def sql():
    return oracle(DATA)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_its_sql(spark, sql, name):
    verdict, detail = compare(spark, sql, DATA, name)
    assert verdict.split()[0] in ("ok", "rows"), detail


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
