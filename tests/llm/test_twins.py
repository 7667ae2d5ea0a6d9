"""Corpus queries that SQL can express, against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import pytest

from rinkline.llm.registered import QUERIES, SQL

sys.path.append(str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, name):
    if SQL[name] is None:
        pytest.skip("no twin")
    ok, message = oracle.compare(spark, oracle.connect(FOLDER), FOLDER, name, QUERIES[name], SQL[name])
    assert ok, message
