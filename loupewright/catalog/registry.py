"""Registration of queries with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from loupewright.catalog.proxies import Workshop, duckdb_sql

AS_OF = date(1998, 6, 15)
METER_NOW = datetime(2024, 1, 20, 12, 0, 0)
D = "date '1998-06-15'"
NOW = "timestamp '2024-01-20 12:00:00'"

# Columns that Spark's date and size functions return as int where DuckDB has bigint.
INT_COLUMNS = {
    "column_to_array": "n_days",
    "sort_in_array": "n",
    "calendar_weekend": "dow",
    "fn_string": "d",
    "fn_date_parts": "d dow doy m y",
    "fn_date_arith": "days_left",
    "rpt_wip_master": "total_days",
    "rpt_qa_calendar": "dow",
    "rpt_month_header": "month_no",
    "rpt_material_lateness": "late_days",
    "rpt_material_lateness_jobs": "late_days",
    "rpt_material_by_item": "late_days",
    "rpt_bill_receipt": "n_products",
    "nest_children": "n",
    "row_span": "a n r span",
    "group_min_max_count": "m y",
    "rpt_order_status": "days_left",
    "rpt_order_status_year": "days_left",
    "rpt_qa_master": "customer_due_diff sales_due_diff",
    "rpt_qa_master_unfiltered": "customer_due_diff sales_due_diff",
    "rpt_qa_master_by_job": "customer_due_diff sales_due_diff",
    "rpt_qa_bills": "late_customer_due late_due",
    "rpt_qa_bills_by_job": "late_customer_due late_due",
    "rpt_factory_to_qa_day": "n_pass n_repair n_send row_span",
    "rpt_repair_documents": "days_left days_worked",
    "rpt_repair_documents_all": "days_left days_worked",
    "rpt_mould_loans": "late_days total_days",
    "rpt_mould_loans_completed": "late_days total_days",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Register a function from :class:`Workshop` to a DataFrame under ``name``."""

    def register(build: Callable[[Workshop], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Workshop(spark, folder))
        if oracle is not None:
            narrow = ", ".join(f"cast({c} as int) as {c}" for c in INT_COLUMNS.get(name, "").split())
            # The factory tables come as common tables of the statement, so its own go one level down.
            own = oracle.lstrip().startswith("with ")
            text = duckdb_sql(f"select * from ({oracle}) own" if own else oracle, extra)
            ORACLES[name] = f"select * replace ({narrow}) from ({text}) typed" if narrow else text
        return build

    return register


def case_sql(expression: str, labels: Mapping, default: str | None = "") -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    arms = " ".join(f"when {quote(k)} then '{v}'" for k, v in labels.items())
    tail = "null" if default is None else f"'{default}'"
    return f"case {expression} {arms} else {tail} end"
