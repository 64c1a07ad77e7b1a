"""Every query of the core against its SQL on the smallest tables."""

import os

import pytest
from comparing import assert_same, tables

from __spark_entry__ import MODULES

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert_same(spark, con, QUERIES[name], SQL[name], SF_DIR)
    else:
        assert QUERIES[name](spark, SF_DIR).count() >= 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p3_ledger", "p6_found", "borrow_interval_join", "ledger_running_cash", "event_timeline", "budget_running_commit"])
@pytest.mark.parametrize("rows", [3, 25])
def test_query_with_every_key_cut_into_shards(spark, con, name, rows, monkeypatch):
    monkeypatch.setattr("tidemark.timeshard.TARGET_ROWS", rows)
    assert_same(spark, con, QUERIES[name], SQL[name], SF_DIR)


def test_modules_name_no_query_twice():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)
