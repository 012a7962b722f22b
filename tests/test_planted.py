"""Faults that queries plant, on tables where they meet: the SQL says what must come of them."""

import datetime

import duckdb
import pandas as pd

from compare import oracle, rows
from ledgerframe.plans.catalogue import ORACLE, QUERIES


def events(folder, made):
    """An events table of (event_id, user_id), in the order of time."""
    start = datetime.datetime(2024, 1, 20)
    told = pd.DataFrame([(i, start + datetime.timedelta(seconds=k), user, "view", 1.5, '{"k": 7}') for k, (i, user) in enumerate(made)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM told) TO '{folder}/events.parquet'")
    return str(folder)


def test_a_forged_decision_of_a_receipt_that_lacks_one_of_a_policy(spark, tmp_path):
    """Receipt 62 stands at the forged place of run 3, and 31 divides it."""
    sf = events(tmp_path, [(1, 3), (2, 3), (62, 3), (4, 3), (5, 4), (31, 4), (64, 4)])
    got = QUERIES["handoff_projection"](spark, sf).toPandas()
    assert rows(got) == rows(oracle(ORACLE["handoff_projection"], sf))
    assert got.set_index("chain_id").refused[3].startswith("handoff_decision_invalid:2:")
