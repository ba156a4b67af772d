"""Every registered query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries of the subpackage and the pipeline have tests of their own beside it.
QUERIES = {k: f for k, f in queries().items() if f.__module__.startswith("tillmark.plans")}
ORACLES = {k: v for k, v in oracle_sql().items() if k in QUERIES}
#: Queries that have no rows on the smallest tables.
EMPTY = {"lookalike_base"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, FOLDER, name, QUERIES, ORACLES)
    assert problem == ("the SQL gives no rows" if name in EMPTY else None)


def test_flagship(spark):
    rows = entry(spark).collect()
    assert rows and sum(r["sales_share"] for r in rows) == pytest.approx(1)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
