"""Work-in-progress board: due days, inspection calendar, targets, processes, material lateness."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupewright.functions import labels as L
from loupewright.functions.dates import days_until
from loupewright.functions.text import clock_minutes, display_name, picture_url
from loupewright.operators.aggregates import is_finish, revision_stats
from loupewright.operators.filters import contains_text, live_orders
from loupewright.operators.generators import order_days
from loupewright.operators.joins import (
    count_between, cumulative_days, densify, latest, left_default, restrict, role_join,
)
from loupewright.operators.nesting import nest, nest_many


def board_orders(
    order_master: DataFrame, due_from: date, due_to: date, due_year_above: int | None = None, number_part: str = ""
) -> DataFrame:
    """Live orders due in a range, without test orders; the base of all board reports."""
    floor = None if due_year_above is None else due_year_above + 1
    orders = live_orders(order_master, due_year_floor=floor)
    orders = orders.where(F.col("DueDate").between(due_from, due_to))
    return orders.where(contains_text(F.col("OrderNumber"), number_part)) if number_part else orders


def wip_master(
    orders: DataFrame,
    order_detail: DataFrame,
    holidays: DataFrame,
    remarks: DataFrame,
    finishes: DataFrame,
    as_of: date,
    keep_days: int = 7,
) -> DataFrame:
    """Board lines: days and working days to due, quantity, remarks and the finish flag.

    A finished order stays for ``keep_days``. Working days keep the sign of the days left and are 0
    for an order due today.
    """
    wanted = order_detail.join(orders.select("OrderNumber"), "OrderNumber", "left_semi")
    ordered = wanted.groupBy("OrderNumber").agg(F.sum("Qty").alias("total_qty"))
    rows = orders.join(ordered, "OrderNumber")
    rows = count_between(rows, cumulative_days(holidays, "HolidayDate"), F.lit(as_of), F.col("DueDate"), "_holidays")
    rows = left_default(rows, remarks, ["OrderNumber"], {"PlanDes": "", "QaDes": ""})
    rows = left_default(rows, finishes, ["OrderNumber"], {"isFinish": 0})
    rows = rows.where(F.col("FinishDate").isNull() | (F.col("FinishDate") >= F.lit(as_of - timedelta(days=keep_days))))
    total = days_until(as_of, F.col("DueDate"))
    return rows.select(
        F.col("OrderNumber").alias("order_number"),
        F.col("ProductionTeam").alias("team"),
        F.col("DueDate").alias("due_date"),
        total.alias("total_days"),
        F.when(total > 0, total - F.col("_holidays")).when(total < 0, total + F.col("_holidays")).otherwise(0)
        .cast("bigint").alias("working_days"),
        "total_qty",
        F.col("PlanDes").alias("plan_remark"),
        F.col("QaDes").alias("qa_remark"),
        F.col("FactoryDue").alias("customer_due"),
        F.col("isFinish").alias("is_finish"),
    )


def calendar_days(orders: DataFrame, qa_bill_master: DataFrame, due_fac_to_qa: DataFrame) -> DataFrame:
    """Days of each order from its first to its last bill or target date."""
    wanted = orders.select("OrderNumber")
    bills = qa_bill_master.join(wanted, "OrderNumber", "left_semi").select("OrderNumber", F.to_date("billDate").alias("day"))
    targets = due_fac_to_qa.join(wanted, "OrderNumber", "left_semi").select("OrderNumber", F.col("DueDate").alias("day"))
    return order_days([bills, targets], "OrderNumber", "day")


def qa_calendar(
    orders: DataFrame,
    order_detail: DataFrame,
    qa_bill_master: DataFrame,
    qa_bill_detail: DataFrame,
    due_fac_to_qa: DataFrame,
) -> DataFrame:
    """Order by day: pieces sent, first and last promise for the day, and the balance still to send.

    All measures are first summed to (order, day), so the balance runs over calendar days only.
    """
    wanted = orders.select("OrderNumber")
    days = calendar_days(orders, qa_bill_master, due_fac_to_qa)
    bills = qa_bill_master.join(wanted, "OrderNumber", "left_semi")
    sent = (
        bills.select("qaBill_ID", "OrderNumber", F.to_date("billDate").alias("day"))
        .join(qa_bill_detail.select("qaBill_ID", "Qty"), "qaBill_ID")
        .groupBy("OrderNumber", "day")
        .agg(F.sum("Qty").alias("to_qa"))
    )
    promises = due_fac_to_qa.join(wanted, "OrderNumber", "left_semi")
    first = (
        promises.where(F.col("HistoryNo") == 1)
        .groupBy("OrderNumber", F.col("DueDate").alias("day"))
        .agg(F.sum("Qty").alias("first_target"))
    )
    last = (
        latest(promises, ["OrderNumber"], "HistoryNo")
        .where(F.col("HistoryNo") != 1)
        .groupBy("OrderNumber", F.col("DueDate").alias("day"))
        .agg(F.sum("Qty").alias("last_target"))
    )
    on = ["OrderNumber", "day"]
    filled = left_default(days, sent, on, {"to_qa": 0})
    filled = left_default(filled, first, on, {"first_target": 0})
    filled = left_default(filled, last, on, {"last_target": 0})
    totals = restrict(order_detail, wanted, ["OrderNumber"]).groupBy("OrderNumber").agg(F.sum("Qty").alias("_ordered"))
    upto = Window.partitionBy("OrderNumber").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return filled.join(totals, "OrderNumber", "left").select(
        F.col("OrderNumber").alias("order_number"),
        "day",
        "dow",
        "to_qa",
        "first_target",
        "last_target",
        (F.col("_ordered") - F.sum("to_qa").over(upto)).alias("balance"),
        F.sum("to_qa").over(Window.partitionBy("OrderNumber")).alias("total_to_qa"),
    )


def target_history(due_fac_to_qa: DataFrame) -> DataFrame:
    """Postponements per order with the dates of the first and the latest promise."""
    stats = revision_stats(due_fac_to_qa, "OrderNumber", "HistoryNo", "Qty", "HistoryDate")
    return stats.withColumnRenamed("OrderNumber", "order_number")


def target_authors(due_fac_to_qa: DataFrame, employee: DataFrame) -> DataFrame:
    """Who changed the promise of an order, per revision after the first."""
    changes = (
        due_fac_to_qa.where((F.col("HistoryNo") != 1) & (F.col("Qty") > 0))
        .groupBy("OrderNumber", "HistoryNo", "EmpCode")
        .agg(F.max("HistoryDate").alias("_at"))
    )
    outputs = {
        "author": display_name(F.col("EmpFName"), F.col("NickName")),
        "author_picture": picture_url(F.col("EmpPict")),
    }
    return role_join(changes, employee, "EmpCode", {"author": ("EmpCode", outputs)}).select(
        F.col("OrderNumber").alias("order_number"),
        F.col("HistoryNo").alias("revision"),
        F.to_date("_at").alias("changed_on"),
        clock_minutes(F.col("_at")).alias("changed_at"),
        "author",
        "author_picture",
    )


def month_header(days: DataFrame) -> DataFrame:
    """Days per calendar month in each order's calendar; the year is not looked at."""
    counted = days.groupBy("OrderNumber", F.month("day").alias("month_no")).agg(F.count(F.lit(1)).alias("days"))
    return counted.select(
        F.col("OrderNumber").alias("order_number"), "month_no", L.label(F.col("month_no"), L.MONTHS, None).alias("month"), "days"
    )


def _pieces() -> Column:
    return (F.col("In_Q") + F.col("Send_Q") + F.col("Out_Q")).alias("in_process")


def _named(rows: DataFrame, pd_process: DataFrame) -> DataFrame:
    return rows.join(pd_process.select("PDProcessCode", "PDProcessName"), "PDProcessCode")


def process_dense_orders(
    orders: DataFrame, job_order: DataFrame, job_status: DataFrame, pd_process: DataFrame,
    hidden: Sequence[str] = L.ORDER_PROCESSES_HIDDEN,
) -> DataFrame:
    """Every order with every shown process, 0 where it has no pieces."""
    facts = restrict(job_order, orders, ["OrderNumber"]).select("JobNumber", "OrderNumber").join(
        job_status.select("JobNumber", "PDProcessCode", _pieces()), "JobNumber"
    )
    shown = pd_process.where(~F.col("PDProcessCode").isin(*hidden))
    dense = densify(orders.select("OrderNumber"), shown, "PDProcessCode", facts, ["OrderNumber"], ["in_process"])
    return _named(dense, pd_process).select(
        F.col("OrderNumber").alias("order_number"),
        F.col("PDProcessCode").alias("process_code"),
        F.col("PDProcessName").alias("process_name"),
        "in_process",
    )


def process_dense_jobs(
    job_order: DataFrame, job_status: DataFrame, pd_process: DataFrame, hidden: Sequence[str] = L.JOB_PROCESSES_HIDDEN
) -> DataFrame:
    """Every job with every shown process, 0 where it has no pieces."""
    shown = pd_process.where(~F.col("PDProcessCode").isin(*hidden))
    facts = restrict(job_status, job_order, ["JobNumber"]).select("JobNumber", "PDProcessCode", _pieces())
    dense = densify(job_order.select("OrderNumber", "JobNumber"), shown, "PDProcessCode", facts, ["JobNumber"], ["in_process"])
    return _named(dense, pd_process).select(
        F.col("OrderNumber").alias("order_number"),
        F.col("JobNumber").alias("job_number"),
        F.col("PDProcessCode").alias("process_code"),
        F.col("PDProcessName").alias("process_name"),
        "in_process",
    )


def _late_days(as_of: date) -> Column:
    """Days from the last bill of finished material, or from now, to the due date."""
    reached = F.when(F.col("is_finish") == 1, F.col("final_bill")).otherwise(F.lit(as_of))
    return F.datediff(F.col("fact_due"), reached)


def material_lateness_orders(purchase_status: DataFrame, bill_master: DataFrame, as_of: date) -> DataFrame:
    """Material of each order: required, delivered, finished, and days late or ahead."""
    bills = bill_master.groupBy("OrderNumber").agg(F.max("BillDate").alias("final_bill"))
    needs = purchase_status.groupBy("OrderNumber").agg(
        F.max("FactDueDate").alias("fact_due"),
        F.sum("QtyReq").alias("qty_req"),
        F.sum("QtyToFact").alias("qty_to_fact"),
    )
    return (
        needs.join(bills, "OrderNumber", "left")
        .withColumn("is_finish", is_finish(F.col("qty_req"), F.col("qty_to_fact")))
        .withColumn("late_days", _late_days(as_of))
        .withColumnRenamed("OrderNumber", "order_number")
    )


def material_lateness_jobs(
    mpp_status: DataFrame,
    mpp_status_product: DataFrame,
    job_order: DataFrame,
    purchase_status: DataFrame,
    inv_master: DataFrame,
    bill_master: DataFrame,
    bill_detail: DataFrame,
    as_of: date,
    groups: Sequence[str] = L.STONE_GROUPS,
) -> DataFrame:
    """Material of each job. Purchase lines are reduced to (order, material) first, so that several
    lines of one material do not multiply the requirement."""
    stones = inv_master.where(F.col("InvGroupCode").isin(list(groups))).select("InvCode")
    due = purchase_status.groupBy("OrderNumber", "InvCode").agg(F.max("FactDueDate").alias("_due"))
    item = ["OrderNumber", "OrderItemNo"]
    needs = (
        mpp_status_product.join(stones, "InvCode", "left_semi")
        .join(due, ["OrderNumber", "InvCode"])
        .join(mpp_status.select(*item, "Qty"), item)
        .groupBy(*item)
        .agg(
            F.sum(F.col("Qty") * F.col("QtyReq")).alias("total_req"),
            F.sum("QtyFacReceive").alias("_received"),
            F.max("_due").alias("fact_due"),
        )
    )
    bills = (
        bill_master.join(bill_detail, "Bill_ID")
        .groupBy("OrderNumber", "JobNumber")
        .agg(F.max("ReceiveDate").alias("final_bill"))
    )
    return (
        job_order.select("JobNumber", *item)
        .join(needs, item)
        .join(bills, ["OrderNumber", "JobNumber"], "left")
        .withColumn("is_finish", is_finish(F.col("total_req"), F.col("_received")))
        .withColumn("late_days", _late_days(as_of))
        .select(
            F.col("OrderNumber").alias("order_number"),
            F.col("JobNumber").alias("job_number"),
            "fact_due", "final_bill", "late_days", "is_finish", "total_req",
        )
    )


def _with_material_state(document: DataFrame, materials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the material figures as one struct; numbers are 0 where there is no material."""
    fields = [c for c in materials.columns if c not in keys]
    renamed = materials.select(*keys, *[F.col(c).alias(f"_m_{c}") for c in fields])
    filled = [
        (F.col(f"_m_{c}") if materials.schema[c].dataType.typeName() == "date" else F.coalesce(F.col(f"_m_{c}"), F.lit(0))).alias(c)
        for c in fields
    ]
    joined = document.join(renamed, list(keys), "left").withColumn("material_state", F.struct(*filled))
    return joined.drop(*[f"_m_{c}" for c in fields])


def order_document(
    master: DataFrame, calendar: DataFrame, targets: DataFrame, months: DataFrame, processes: DataFrame, materials: DataFrame
) -> DataFrame:
    """One nested document per board order.

    All inputs are keyed by ``order_number`` and hold at most one row per day, month or process, so
    the arrays are bounded.
    """
    key = ["order_number"]
    children = [
        (calendar.drop("total_to_qa"), ["day", "dow", "to_qa", "first_target", "last_target", "balance"], "calendar"),
        (months, ["month_no", "month", "days"], "months"),
        (processes, ["process_code", "process_name", "in_process"], "processes"),
    ]
    document = nest_many(master, children, key)
    document = _with_material_state(document.join(targets, key, "left"), materials, key)
    sent = F.aggregate("calendar", F.lit(0).cast("bigint"), lambda total, e: total + e["to_qa"])
    return document.withColumn("total_to_qa", sent)


def job_document(
    job_order: DataFrame, product_master: DataFrame, processes: DataFrame, materials: DataFrame, remarks: DataFrame
) -> DataFrame:
    """One nested document per job: product, remark, processes and material state."""
    jobs = job_order.join(product_master.select("ProductID", "ProductCode", "NewPict"), "ProductID").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("JobNumber").alias("job_number"),
        F.col("OrderItemNo").alias("item_no"),
        F.col("ProductCode").alias("product_code"),
        F.col("JobQty").alias("job_qty"),
        picture_url(F.col("NewPict")).alias("picture"),
    )
    jobs = left_default(jobs, remarks, ["order_number", "item_no"], {"qa_spec": ""})
    keys = ["order_number", "job_number"]
    document = nest(jobs, processes, keys, ["process_code", "process_name", "in_process"], "processes")
    return _with_material_state(document, materials, keys)
