"""All queries of the catalog against their DuckDB statements on the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry
from loupewright.catalog import all_oracles, all_queries
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
KEYS = sorted(all_queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, key):
    frame = all_queries()[key](spark, FOLDER)
    found = frame.collect()
    if key in all_oracles():
        result = duck.execute(all_oracles()[key])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert rows_of(frame.columns, found) == rows_of(names, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_only_documents_have_no_statement():
    assert set(all_queries()) - set(all_oracles()) == {"rpt_order_document", "rpt_order_document_jobs"}
