import pytest

import __spark_entry__ as entry
from lumenset.plans import all_queries, all_sql
from oracle import compare


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_matches_sql(spark, sf_dir, name):
    rows, _, message = compare(spark, sf_dir, name)
    assert not message, message
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_sql()) == set(all_queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
