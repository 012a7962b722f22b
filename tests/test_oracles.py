"""Every query of the main library against its SQL, on the smallest tables."""

import pytest

from compare import oracle, rows
from ledgerframe.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = oracle(ORACLE[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    """Their results are tested against brute force beside their operators."""
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_both_sides():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
