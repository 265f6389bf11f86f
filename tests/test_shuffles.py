"""Reports on tables too large to broadcast: tables dealt by a key are not dealt again, and results are the same."""

from __future__ import annotations

from datetime import date, datetime

import duckdb
import pytest

from check import rows_of
from loupewright.catalog import all_oracles, all_queries
from loupewright.catalog.proxies import Workshop
from loupewright.plans.quality import promised_targets
from loupewright.sources.tables import SCHEMAS

#: Shuffles by key that the plan of a query may have, with no join broadcast.
MOST = {
    "rpt_qa_bills_by_job": 50,
    "rpt_qa_bills": 85,
    "rpt_repair_bills_by_job": 52,
    "rpt_material_by_item": 18,
    "rpt_bill_receipt": 16,
    "rpt_factory_to_qa_day": 140,
}


def _lines():
    for n in range(400):
        order, at = n // 4 * 3, datetime(1998, 1 + n % 12, 1 + n % 28)
        yield (order, n % 23, n % 7, n % 5 + 1, float(n % 9), 1.0, 0.0, 0.0, "RAN"[n % 3], "FO"[n % 2], at)
        if n % 10 == 0:  # the same key again
            yield (order, n % 23, n % 7, n % 5 + 1, 2.0, 1.0, 0.0, 0.0, "N", "O", at)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shuffles"))
    data = {
        "region": [(n, f"region {n}") for n in range(5)],
        "nation": [(n, f"nation {n}", n % 5) for n in range(25)],
        "customer": [(n, f"c{n}", n % 25, 1.0, ("AUTOMOBILE", "BUILDING", "MACHINERY", "OTHER")[n % 4]) for n in range(13)],
        "supplier": [(n, f"s{n}", n % 25, 1.0) for n in range(7)],
        "part": [(n, f"p{n}", f"Brand#{n % 3}", "LARGE", n, 1.0) for n in range(23)],
        "orders": [(n, n % 13, "OFP"[n % 3 if n % 4 else 0], 1.0, datetime(1998, 1 + n % 12, 5), f"{n % 5 + 1}-X") for n in range(300)],
        "lineitem": list(_lines()),
        "events": [(n, datetime(2024, 1, 1 + n % 20), n, "view", 1.0, "{}") for n in range(20)],
    }
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(data[name], schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("key", sorted(MOST))
def test_shuffles_and_rows(spark, folder, no_broadcast, key):
    frame = all_queries()[key](spark, folder)
    assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= MOST[key]
    if key in all_oracles():
        connection = duckdb.connect()
        for name in SCHEMAS:
            connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
        result = connection.execute(all_oracles()[key])
        assert rows_of(frame.columns, frame.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


#: Joins that restrict a table to the orders of the report before it is summed.
RESTRICTED = {
    "rpt_qa_master": 12,
    "rpt_order_document_jobs": 9,
    "rpt_order_document": 13,
}


@pytest.mark.parametrize("key", sorted(RESTRICTED))
def test_facts_are_restricted_first(spark, folder, no_broadcast, key):
    plan = all_queries()[key](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") >= RESTRICTED[key]


def test_targets_of_some_orders(spark):
    due = spark.sql("select * from values ('A', 1, date'2022-01-01', 5), ('A', 2, date'2022-01-02', 6), ('B', 1, date'2022-01-01', 7) as t(OrderNumber, HistoryNo, DueDate, Qty)")
    bills = spark.sql("select * from values (1, 'A', timestamp_ntz'2022-01-01 05:00:00'), (2, 'B', timestamp_ntz'2022-01-01 05:00:00') as t(qaBill_ID, OrderNumber, billDate)")
    detail = spark.sql("select * from values (1, 3), (1, 1), (2, 9) as t(qaBill_ID, Qty)")
    wanted = spark.sql("select 'A' as OrderNumber union all select 'A' union all select null")
    found = promised_targets(due, bills, detail, wanted)
    assert [tuple(r) for r in found.collect()] == [("A", date(2022, 1, 2), 6, 4, 6)]


def test_bills_of_most_keys_move_each_table_once(spark, folder, no_broadcast):
    frame = all_queries()["rpt_qa_bills_by_job"](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<l_orderkey") == 8  # bills, their keys, lines, order items, and two tables each of passed and repaired pieces
    assert plan.count("Exchange hashpartitioning") <= 26
    assert "LeftSemi" not in plan


@pytest.mark.parametrize("name,column", [("qa_bill_master", "OrderNumber"), ("qa_bill_detail", "OrderNumber")])
def test_tables_dealt_otherwise_have_the_same_rows(spark, folder, name, column):
    workshop = Workshop(spark, folder)
    usual, other = getattr(workshop, name), workshop.dealt(name, column)
    assert rows_of(usual.columns, usual.collect()) == rows_of(other.columns, other.collect())
    # The grouping and a join on that column share the shuffle, and the key itself is not moved.
    plan = other.groupBy(column).count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(concat(" in plan
