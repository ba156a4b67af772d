"""Queries of the subpackage that SQL can express, against that SQL."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from tillmark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, QUERIES, ORACLES) is None
