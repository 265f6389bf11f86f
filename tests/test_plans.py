"""Plans: filters and columns reach the scan, and nothing is forced into one task or a broadcast."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loupewright.operators import filters, joins
from loupewright.operators.aggregates import pivot_zero
from loupewright.sources import factory
from tests.util import rows, table


def plan_of(df) -> str:
    """The formatted plan, which lists all pushed filters."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "orders")
    data = [
        (f"{'CH-' if i % 3 else 'CH-M-'}{i:05d}", "2" if i % 2 else "3", date(2020 + i % 4, 1, 1), datetime(2020 + i % 4, 1, 1, 5), i)
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "OrderNumber string, Status string, DueDate date, At timestamp_ntz, Qty bigint")
    factory.write_table(df, path, "DueDate", files=4)
    return factory.read_table(spark, path, df.schema)


def test_live_order_filter_reaches_the_scan(stored):
    plan = plan_of(filters.live_orders(stored, due_year_floor=2022).select("Qty"))
    for pushed in ("EqualTo(Status,2)", "StringStartsWith(OrderNumber,CH-)", "GreaterThanOrEqual(DueDate,2022-01-01)"):
        assert pushed in plan
    assert "Not(StringStartsWith(OrderNumber,CH-M-))" in plan
    assert "ReadSchema: struct<OrderNumber:string,Status:string,DueDate:date,Qty:bigint>" in plan


def test_year_and_date_ranges_reach_the_scan(stored):
    plan = plan_of(stored.where(filters.year_cmp(F.col("DueDate"), "=", 2021)))
    assert "LessThan(DueDate,2022-01-01)" in plan
    for mode in ("raw", "day", "end_of_day"):
        plan = plan_of(stored.where(filters.date_between(F.col("At"), date(2021, 1, 1), date(2021, 6, 1), mode)))
        assert "GreaterThanOrEqual(At,2021-01-01T00:00)" in plan


def test_pivot_needs_one_shuffle(stored):
    plan = pivot_zero(stored, ["OrderNumber"], "Status", {"2": "a", "3": "b"}, "Qty")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_lookup_aggregates_before_the_join(stored):
    outer = stored.select("OrderNumber").distinct()
    plan = joins.lookup_agg(outer, stored, ["OrderNumber"], {"q": F.sum("Qty"), "n": F.count("Qty"), "m": F.max("Qty")})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") == 2 and "partial_sum" in text


def test_normalise(spark):
    raw = table(spark, "k string, s string, d date", ("ch-1 ", "a ", date(2000, 1, 1)), ("CH-2", " b", date(2022, 1, 1)), (None, "", None))
    got = factory.normalise(raw, keys=["k"], texts=["s"], dates=["d"])
    assert rows(got) == [(None, "", None), ("CH-1", "a", None), ("CH-2", " b", date(2022, 1, 1))]
    dates = factory.parse_dates(table(spark, "d string", ("",), ("2022-01-01",), ("x",)), ["d"])
    assert [r[0] for r in dates.collect()] == [None, date(2022, 1, 1), None]
