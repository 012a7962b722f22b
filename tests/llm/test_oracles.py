"""The numbered queries against their SQL, and the contracts' columns, on the smallest tables."""

import pytest

from compare import oracle, rows
from ledgerframe.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"],
    "op2": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op9": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle(ORACLE[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_the_contract_s_columns(spark, name):
    got = QUERIES[name](spark, SF)
    assert got.columns == COLUMNS[name.split("_")[0]]
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
