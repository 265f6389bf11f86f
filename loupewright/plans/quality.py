"""Inspection: order progress, inspection bills, repair bills, reasons, factory-to-inspection reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupewright.functions import labels as L
from loupewright.functions.dates import days_until, shift_hours
from loupewright.functions.text import display_name, picture_url
from loupewright.operators.bundle import report_bundle
from loupewright.operators.filters import contains_text, date_between, in_padded, live_orders, open_or_between
from loupewright.operators.joins import cum_upto, latest, left_default, restrict, role_join
from loupewright.operators.nesting import nest, nest_many, row_span
from loupewright.operators.ranked import number_rows
from loupewright.operators.sorting import status_rank, top_n

# Document states, and the shift of stored clock times in hours.
FINISHED, SENT_BACK = "3", "2"
OPEN_REPAIR = ("", SENT_BACK)
CLOCK_SHIFT = -7
#: Rows that meet at their bill: lines, further rows of a line, lines without a product, and pieces of an item.
LINE, AGAIN, UNLISTED, PASSED, TAKEN, WAITING = range(1, 7)
#: Sales team folded into another one in the summary of passed pieces.
FOLDED_TEAM = {"3": "1"}


def _person() -> Column:
    return display_name(F.col("EmpFName"), F.col("NickName"))


def live_with_customer(
    order_master: DataFrame, customer: DataFrame, as_of: date, teams: Sequence | None = None,
    sales_teams: Sequence | None = None, number_part: str = "", due_from: date | None = None, due_to: date | None = None,
) -> DataFrame:
    """Live orders due this year or later, with the sales team of their customer.

    ``due_from`` and ``due_to`` restrict the sales due date.
    """
    orders = live_orders(order_master, due_year_floor=as_of.year)
    if due_from is not None:
        orders = orders.where(F.col("DueDate") >= F.lit(due_from))
    if due_to is not None:
        orders = orders.where(F.col("DueDate") <= F.lit(due_to))
    if number_part:
        orders = orders.where(contains_text(F.col("OrderNumber"), number_part))
    if teams is not None:
        orders = orders.where(in_padded(F.col("ProductionTeam"), teams))
    orders = orders.join(customer, "CusCode")
    return orders if sales_teams is None else orders.where(in_padded(F.col("CusStatus"), sales_teams))


def promised_targets(
    due_fac_to_qa: DataFrame, qa_bill_master: DataFrame, qa_bill_detail: DataFrame, orders: DataFrame | None = None
) -> DataFrame:
    """Rows of the latest promise, with the pieces billed and promised up to and including each date.

    With ``orders`` only those of them: promises and bills are restricted before anything is summed.
    """
    if orders is not None:
        due_fac_to_qa, qa_bill_master = (restrict(d, orders, ["OrderNumber"]) for d in (due_fac_to_qa, qa_bill_master))
    current = latest(due_fac_to_qa, ["OrderNumber"], "HistoryNo").select("OrderNumber", F.col("DueDate").alias("due_date"), "Qty")
    billed = qa_bill_master.select("qaBill_ID", "OrderNumber", F.to_date("billDate").alias("_day")).join(
        qa_bill_detail.select("qaBill_ID", "Qty"), "qaBill_ID"
    )
    wanted = current.where(F.col("Qty") > 0)
    facts = {"current_qty": (current, "due_date", "Qty"), "qty_bill": (billed, "_day", "Qty")}
    return cum_upto(wanted, "OrderNumber", "due_date", facts).select(
        F.col("OrderNumber").alias("order_number"), "due_date", F.col("Qty").alias("qty"), "qty_bill", "current_qty"
    )


def qa_master(
    orders: DataFrame,
    order_detail: DataFrame,
    qa_bill_master: DataFrame,
    qa_bill_detail: DataFrame,
    qa_finish_master: DataFrame,
    qa_finish_detail: DataFrame,
    qa_repair_master: DataFrame,
    qa_repair_detail: DataFrame,
    as_of: date,
    limit: int | None = None,
) -> DataFrame:
    """Inspection progress of each order. With ``limit`` only the first by due date."""
    wanted = orders.select("OrderNumber")
    of_orders = lambda facts: facts.join(wanted, "OrderNumber", "left_semi")
    order_detail, qa_bill_detail, qa_bill_master = (of_orders(x) for x in (order_detail, qa_bill_detail, qa_bill_master))
    qa_finish_master, qa_repair_master = of_orders(qa_finish_master), of_orders(qa_repair_master)
    sums = [
        order_detail.groupBy("OrderNumber").agg(F.sum("Qty").alias("total_order")),
        qa_bill_detail.groupBy("OrderNumber").agg(F.sum("Qty").alias("total_bill")),
        qa_finish_master.join(qa_finish_detail, "qaFinish_ID").groupBy("OrderNumber").agg(F.sum("Qty").alias("total_finish")),
        qa_repair_master.where(F.col("qaRepairStatus") != FINISHED)
        .join(qa_repair_detail, "qaRepair_ID").groupBy("OrderNumber").agg(F.sum("Qty").alias("in_repair")),
        qa_bill_master.where(F.col("qaBillStatus") != FINISHED).groupBy("OrderNumber").agg(F.count(F.lit(1)).alias("open_bills")),
    ]
    rows = orders.join(sums[0], "OrderNumber")
    for part in sums[1:]:
        rows = left_default(rows, part, ["OrderNumber"], {part.columns[1]: 0})
    rows = rows.select(
        F.col("OrderNumber").alias("order_number"),
        F.col("FactoryDue").alias("customer_due"),
        days_until(as_of, F.col("FactoryDue")).alias("customer_due_diff"),
        F.col("DueDate").alias("sales_due"),
        days_until(as_of, F.col("DueDate")).alias("sales_due_diff"),
        F.col("ProductionTeam").alias("team"),
        "total_order", "total_bill", "total_finish", "in_repair", "open_bills",
        F.when(F.col("total_order") > F.col("total_bill"), L.QA_IN_PRODUCTION).otherwise(L.QA_ALL_SENT).alias("status"),
    )
    return top_n(rows, [F.col("sales_due_diff"), F.col("order_number")], limit)


def with_targets(master: DataFrame, targets: DataFrame) -> DataFrame:
    """Orders with their targets nested in date order."""
    return nest(master, targets, ["order_number"], ["due_date", "qty", "qty_bill", "current_qty"], "targets")


def orders_of_job(job_order: DataFrame, qa_bill_detail: DataFrame, job_number: str, is_job: bool) -> DataFrame:
    """Order of a job number, or of an inspection job number."""
    if is_job:
        return job_order.where(F.col("JobNumber") == job_number).select("OrderNumber").distinct()
    return qa_bill_detail.where(F.col("qaJobNumber") == job_number).select("OrderNumber").distinct()


def qa_item_detail(
    order_detail: DataFrame,
    product_master: DataFrame,
    job_order: DataFrame,
    qa_bill_detail: DataFrame,
    qa_finish_master: DataFrame,
    qa_finish_detail: DataFrame,
    qa_repair_master: DataFrame,
    qa_repair_detail: DataFrame,
) -> DataFrame:
    """Items of each order: billed, passed, under repair and ever repaired, with a display number."""
    on = ["OrderNumber", "OrderItemNo"]
    lines = qa_bill_detail.select("qaBill_ID", "bill_Item", *on)
    billed = qa_bill_detail.groupBy(*on).agg(F.sum("Qty").alias("total_qa"))
    passed = (
        qa_finish_master.select("qaFinish_ID", "qaBill_ID")
        .join(qa_finish_detail.select("qaFinish_ID", "bill_Item", "Qty"), "qaFinish_ID")
        .join(lines, ["qaBill_ID", "bill_Item"])
        .groupBy(*on)
        .agg(F.sum("Qty").alias("total_finish"))
    )
    repaired = (
        qa_repair_master.select("qaRepair_ID", "qaBill_ID")
        .join(qa_repair_detail.select("qaRepair_ID", "bill_Item", "Qty", "RepairFinish"), "qaRepair_ID")
        .join(lines, ["qaBill_ID", "bill_Item"])
        .groupBy(*on)
        .agg(
            F.coalesce(F.sum(F.when(F.col("RepairFinish") < F.col("Qty"), F.col("Qty"))), F.lit(0)).alias("total_repair"),
            F.sum("Qty").alias("sum_repair"),
        )
    )
    items = order_detail.withColumnRenamed("ItemNo", "OrderItemNo").drop("ProductCode")
    items = items.join(product_master.select("ProductID", "ProductCode", "NewPict"), "ProductID", "left")
    items = items.join(job_order.select("JobNumber", *on), on)
    items = left_default(items, billed, on, {"total_qa": 0})
    items = left_default(items, passed, on, {"total_finish": 0})
    items = left_default(items, repaired, on, {"total_repair": 0, "sum_repair": 0})
    # The items of an order are few, so a window that reuses the order of the joins will do.
    in_order = Window.partitionBy("OrderNumber").orderBy("ForSort", "OrderItemNo", "JobNumber")
    numbered = items.withColumn("display_no", F.row_number().over(in_order).cast("bigint"))
    return numbered.select(
        F.col("OrderNumber").alias("order_number"),
        "display_no",
        F.col("OrderItemNo").alias("item_no"),
        F.col("JobNumber").alias("job_number"),
        F.col("ProductID").alias("product_id"),
        F.col("ProductCode").alias("product_code"),
        F.col("Qty").alias("total_qty"),
        picture_url(F.col("NewPict")).alias("picture"),
        "total_qa", "total_finish", "total_repair", "sum_repair",
        F.lit(0).alias("selected"),
        F.lit(0).alias("send_qty"),
    )


def bill_keys(
    orders: DataFrame,
    qa_bill_master: DataFrame,
    bill_from: date,
    bill_to: date,
    statuses: Sequence[str],
    limit: int | None = None,
) -> DataFrame:
    """Inspection bills of the given orders and dates; only the first 100 by status without a filter."""
    bills = qa_bill_master.where(
        date_between(F.col("billDate"), bill_from, bill_to) & in_padded(F.col("qaBillStatus"), statuses)
    )
    bills = bills.join(orders.select("OrderNumber"), "OrderNumber", "left_semi")
    return top_n(bills.select("qaBill_ID", "qaBillStatus"), [F.col("qaBillStatus"), F.col("qaBill_ID")], limit).select("qaBill_ID")


def qa_bills(
    keys: DataFrame,
    order_master: DataFrame,
    customer: DataFrame,
    order_detail: DataFrame,
    product_master: DataFrame,
    employee: DataFrame,
    qa_bill_master: DataFrame,
    qa_bill_detail: DataFrame,
    qa_finish_master: DataFrame,
    qa_finish_detail: DataFrame,
    qa_repair_master: DataFrame,
    qa_repair_detail: DataFrame,
    as_of: date,
    unfinished_only: bool = True,
    focus_job: str | None = None,
    most: bool = False,
) -> DataFrame:
    """Inspection bills of a key set with totals and their items nested.

    The key set restricts each of the fact tables before anything is summed. With ``most`` (the keys hold
    most bills) no row goes to its bill only for that: bills and lines go to their order first, and other
    bills are left out where bills, lines, passed and repaired pieces meet. The result is the same.
    """
    bill, item = ["qaBill_ID"], ["qaBill_ID", "bill_Item"]
    if not most:
        qa_bill_master, qa_bill_detail, qa_finish_master, qa_repair_master = (
            restrict(d, keys, bill) for d in (qa_bill_master, qa_bill_detail, qa_finish_master, qa_repair_master)
        )
    ordered = order_master.select("OrderNumber", "CusCode", "ProductionTeam", "DueDate", "FactoryDue").join(customer, "CusCode", "left")
    rows = qa_bill_master.join(ordered, "OrderNumber")
    if most:
        rows = restrict(rows, keys, bill, here=True)
    roles = {"s": ("SenderNew", {"sender_name": _person()}), "r": ("ReceiverNew", {"receiver_name": _person()})}
    rows = role_join(rows, employee, "EmpCode", roles).withColumnRenamed("qaBill_ID", "bill_id")
    # Lines go to their order and to their product; one that meets several rows there is listed again, but counts once.
    known = order_detail.select("OrderNumber", F.col("ItemNo").alias("OrderItemNo"))
    same = Window.partitionBy("OrderNumber", "OrderItemNo").orderBy("OrderItemNo")
    products = product_master.select("ProductID", "ProductCode", "NewPict")
    products = number_rows(products, ["ProductID"], ["ProductCode", "NewPict"], "_product")
    lines = qa_bill_detail.select(*item, "OrderNumber", "OrderItemNo", "ProductID", "Qty", "QCPerson", "qaJobNumber")
    lines = lines.join(known.withColumn("_known", F.row_number().over(same)), ["OrderNumber", "OrderItemNo"], "left")
    lines = lines.join(products, "ProductID", "left")
    first = (F.coalesce("_known", F.lit(1)) == 1) & (F.coalesce("_product", F.lit(1)) == 1)
    listed = F.col("_product").isNotNull()
    lines = lines.select(
        *item, "OrderItemNo", "Qty", "QCPerson", "qaJobNumber", "NewPict",
        F.when(F.col("_known").isNotNull(), F.col("ProductCode")).alias("ProductCode"),
        F.when(first & listed, LINE).when(first, UNLISTED).when(listed, AGAIN).alias("_kind"),
    )
    passed = qa_finish_master.select("qaFinish_ID", "qaBill_ID").join(
        qa_finish_detail.select("qaFinish_ID", "bill_Item", "Qty"), "qaFinish_ID"
    )
    repairs = qa_repair_master.select("qaRepair_ID", "qaBill_ID", "qaRepairStatus").join(
        qa_repair_detail.select("qaRepair_ID", "bill_Item", "Qty", "RepairFinish"), "qaRepair_ID"
    )
    taken = F.col("qaRepairStatus") != ""
    repairs = repairs.select(
        *item, "Qty", F.col("RepairFinish").alias("_done"), F.when(taken, TAKEN).when(~taken, WAITING).alias("_kind")
    )
    # All of a bill is dealt once; sums per item, totals and nesting stay there.
    met = lines.unionByName(passed.select(*item, "Qty", F.lit(PASSED).alias("_kind")), True).unionByName(repairs, True)
    met = met.repartition("qaBill_ID")
    of = lambda kinds, c="Qty": F.sum(F.when(F.col("_kind").isin(*kinds), F.col(c)))
    sums = {
        "qty_in_repair": of([TAKEN]), "qty_repair_finish": of([TAKEN], "_done"), "qty_repair_wait": of([WAITING]),
        "qty_pass": of([PASSED]),
    }
    totals = {
        "total_qty": of([LINE, UNLISTED]), "total_finish": of([PASSED]), "total_repair": of([TAKEN]),
        "total_repair_finish": of([TAKEN], "_done"),
    }
    per_item = lambda c: F.coalesce(F.when(F.col("bill_Item").isNotNull(), c.over(Window.partitionBy(*item))), F.lit(0))
    met = met.withColumns({name: per_item(c) for name, c in sums.items()})
    # Summed before the names are joined, which may repeat a line; in the same order, so nothing is sorted again.
    of_bill = Window.partitionBy("qaBill_ID").orderBy("bill_Item").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = met.withColumns({name: c.over(of_bill) for name, c in totals.items()})
    met = role_join(met, employee, "EmpCode", {"q": ("QCPerson", {"qc_person": _person()})})
    met = met.withColumnsRenamed(
        {"qaBill_ID": "bill_id", "bill_Item": "bill_item", "ProductCode": "product_code", "OrderItemNo": "item_no", "qaJobNumber": "qa_job_number"}
    ).withColumns(
        {
            "picture": picture_url(F.col("NewPict")),
            "qty": F.col("Qty"),
            "focus": F.when(F.col("qa_job_number") == F.lit(focus_job), 1).otherwise(0),
        }
    )
    fields = ["bill_item", "product_code", "item_no", "qa_job_number", "qc_person", "picture", "qty", *sums, "focus"]
    rows = nest(rows, met, ["bill_id"], fields, "items", F.col("_kind").isin(LINE, AGAIN), {name: F.max(name) for name in totals})
    rows = rows.withColumns({name: F.coalesce(name, F.lit(0)) for name in totals})
    if unfinished_only:
        rows = rows.where(F.col("total_qty") > F.col("total_finish"))
    return rows.select(
        "bill_id",
        F.col("qaDocNumber").alias("doc_number"),
        shift_hours(F.col("billDate"), CLOCK_SHIFT).alias("bill_date"),
        F.col("OrderNumber").alias("order_number"),
        F.col("CusStatus").alias("sales_team"),
        shift_hours(F.col("receiveDate"), CLOCK_SHIFT).alias("receive_date"),
        *totals, "sender_name", "receiver_name",
        F.col("ProductionTeam").alias("team"),
        days_until(as_of, F.col("DueDate")).alias("late_due"),
        F.col("qaBillStatus").alias("status"),
        F.col("FactoryDue").alias("customer_due"),
        days_until(as_of, F.col("FactoryDue")).alias("late_customer_due"),
        "items",
    )


def repair_keys(
    orders: DataFrame,
    qa_repair_master: DataFrame,
    qa_repair_detail: DataFrame,
    repair_from: date,
    repair_to: date,
    limit: int | None = None,
) -> DataFrame:
    """Unfinished repair bills in a date range or still open, by urgency of status and date."""
    stamp = F.col("repairDate")
    chosen = qa_repair_master.where(
        open_or_between(date_between(stamp, repair_from, repair_to, "raw"), F.col("qaRepairStatus"), OPEN_REPAIR)
    ).join(orders.select("OrderNumber"), "OrderNumber", "left_semi")
    lines = qa_repair_detail.join(chosen.select("qaRepair_ID"), "qaRepair_ID", "left_semi")
    sums = lines.groupBy("qaRepair_ID").agg(F.sum("RepairFinish").alias("_done"), F.sum("Qty").alias("_qty"))
    unfinished = chosen.join(sums, "qaRepair_ID").where(F.col("_done") < F.col("_qty"))
    order = [status_rank(F.col("qaRepairStatus"), OPEN_REPAIR), stamp, F.col("qaRepair_ID")]
    return top_n(unfinished, order, limit).select("qaRepair_ID")


def repair_reason_rows(reasons: DataFrame, types: DataFrame, type_details: DataFrame) -> DataFrame:
    """Repair reasons with the names of type and reason; a reason without a name keeps NULL."""
    return reasons.join(types, "type_ID").join(type_details, ["type_ID", "reason_No"], "left")


def repair_bills(
    keys: DataFrame,
    order_master: DataFrame,
    customer: DataFrame,
    order_detail: DataFrame,
    product_master: DataFrame,
    employee: DataFrame,
    qa_bill_master: DataFrame,
    qa_bill_detail: DataFrame,
    qa_repair_master: DataFrame,
    qa_repair_detail: DataFrame,
    reasons: DataFrame,
    types: DataFrame,
    type_details: DataFrame,
) -> DataFrame:
    """Repair bills of a key set: totals, status, and items with their reasons nested two levels deep."""
    key = ["qaRepair_ID"]
    masters, lines, why = (restrict(d, keys, key) for d in (qa_repair_master, qa_repair_detail, reasons))
    sums = lines.groupBy(*key).agg(
        F.sum("Qty").alias("total_qty"), F.sum("RepairFinish").alias("total_finish"), F.sum("ToQa").alias("to_qa")
    )
    rows = masters.join(sums, key, "left").join(qa_bill_master.select("qaBill_ID", "qaDocNumber"), "qaBill_ID", "left")
    ordered = order_master.select("OrderNumber", "ProductionTeam", "CusCode").join(customer, "CusCode", "left")
    rows = rows.join(ordered, "OrderNumber", "left")
    roles = {"s": ("SenderNew", {"sender_name": _person()}), "r": ("ReceiverNew", {"receiver_name": _person()})}
    rows = role_join(rows, employee, "EmpCode", roles).select(
        F.col("qaRepair_ID").alias("repair_id"),
        F.col("repairDocNumber").alias("doc_number"),
        F.col("qaDocNumber").alias("bill_doc_number"),
        F.col("ProductionTeam").alias("team"),
        F.col("OrderNumber").alias("order_number"),
        shift_hours(F.col("receiveDate"), CLOCK_SHIFT).alias("receive_date"),
        "sender_name",
        "receiver_name",
        F.col("qaRepairStatus").alias("status"),
        status_rank(F.col("qaRepairStatus"), OPEN_REPAIR).alias("urgency"),
        shift_hours(F.col("repairDate"), CLOCK_SHIFT).alias("repair_date"),
        L.label(F.col("qaRepairStatus"), L.REPAIR_STATUS, L.NO_DATA).alias("status_label"),
        "total_qty", "total_finish", "to_qa",
        F.col("CusStatus").alias("sales_team"),
    )
    bills = qa_bill_detail.select("qaBill_ID", "bill_Item", "OrderNumber", "OrderItemNo", "QCPerson")
    items = (
        masters.select("qaRepair_ID", "qaBill_ID")
        .join(lines, key)
        .join(bills, ["qaBill_ID", "bill_Item"])
        .join(order_detail.select("OrderNumber", F.col("ItemNo").alias("OrderItemNo"), "ProductID"), ["OrderNumber", "OrderItemNo"])
        .join(product_master.select("ProductID", "ProductCode", "NewPict"), "ProductID", "left")
    )
    items = role_join(items, employee, "EmpCode", {"q": ("QCPerson", {"qc_person": _person()})}).select(
        F.col("qaRepair_ID").alias("repair_id"),
        F.col("repair_Item").alias("repair_item"),
        F.col("qaJobNumber").alias("qa_job_number"),
        F.col("ProductCode").alias("product_code"),
        F.col("Qty").alias("qty"),
        F.col("ToQa").alias("to_qa"),
        F.col("RepairFinish").alias("repair_finish"),
        F.lit(0).alias("sent_repair"),
        "qc_person",
        picture_url(F.col("NewPict")).alias("picture"),
    )
    named = repair_reason_rows(why, types, type_details).select(
        F.col("qaRepair_ID").alias("repair_id"), F.col("repair_Item").alias("repair_item"),
        F.col("repairType").alias("repair_type"), F.col("reasonType").alias("reason"), F.col("Qty").alias("qty"),
    )
    items = nest(items, named, ["repair_id", "repair_item"], ["repair_type", "reason", "qty"], "reasons")
    fields = ["repair_item", *[c for c in items.columns if c not in ("repair_id", "repair_item")]]
    return nest(rows, items, ["repair_id"], fields, "items")


def repair_reasons_by_item(
    qa_repair_master: DataFrame,
    qa_repair_detail: DataFrame,
    qa_bill_detail: DataFrame,
    reasons: DataFrame,
    types: DataFrame,
    type_details: DataFrame,
) -> DataFrame:
    """Repaired quantity per order item, repair type and reason.

    The reason rows are summed to (item, type, reason) codes before the names are joined.
    """
    lines = (
        qa_repair_master.select("qaRepair_ID", "qaBill_ID", "OrderNumber")
        .join(qa_repair_detail.select("qaRepair_ID", "repair_Item", "bill_Item"), "qaRepair_ID")
        .join(qa_bill_detail.select("qaBill_ID", "bill_Item", "OrderItemNo"), ["qaBill_ID", "bill_Item"])
        .select("qaRepair_ID", "repair_Item", "OrderNumber", "OrderItemNo")
    )
    summed = (
        reasons.join(lines, ["qaRepair_ID", "repair_Item"])
        .groupBy("OrderNumber", "OrderItemNo", "type_ID", "reason_No")
        .agg(F.sum("Qty").alias("qty"))
    )
    named = summed.join(types, "type_ID").join(type_details, ["type_ID", "reason_No"])
    return named.groupBy(
        F.col("OrderNumber").alias("order_number"),
        F.col("OrderItemNo").alias("item_no"),
        F.col("repairType").alias("repair_type"),
        F.col("reasonType").alias("reason"),
    ).agg(F.sum("qty").alias("qty"))


def reasons_of_items(reasons: DataFrame, type_details: DataFrame) -> DataFrame:
    """Reason rows of each repaired item; reasons missing from the catalogue are left out."""
    return reasons.join(type_details, ["type_ID", "reason_No"]).select(
        F.col("qaRepair_ID").alias("repair_id"),
        F.col("repair_Item").alias("repair_item"),
        F.col("type_ID").alias("type_id"),
        F.col("reason_No").alias("reason_no"),
        F.col("reasonType").alias("reason"),
        F.col("Qty").alias("qty"),
    )


def reason_catalogue(types: DataFrame, type_details: DataFrame) -> DataFrame:
    """Repair types with their reasons nested."""
    return nest(types, type_details, ["type_ID"], ["reason_No", "reasonType"], "reasons")


def factory_to_qa(
    orders: DataFrame,
    order_detail: DataFrame,
    qa_bill_master: DataFrame,
    qa_bill_detail: DataFrame,
    qa_finish_master: DataFrame,
    qa_finish_detail: DataFrame,
    bill_from: date,
    bill_to: date,
) -> DataFrame:
    """Four related results for a date range, told apart by ``part``: daily, orders, line_chart, passed.

    ``daily`` has one row per order and bill day; ``orders`` and ``line_chart`` are sums of it, made in
    the same pass. An order's quantity counts once per day on which it sent a bill; orders without items
    are in ``daily`` only.
    """
    keyed = orders.select("OrderNumber", F.col("ProductionTeam").alias("team"), F.col("CusStatus").alias("sales_team"))
    # Joining the wanted orders first restricts the facts and brings the columns to group by.
    daily = (
        qa_bill_master.where(date_between(F.col("billDate"), bill_from, bill_to))
        .select("qaBill_ID", "OrderNumber", F.to_date("billDate").alias("day"))
        .join(keyed, "OrderNumber")
        .join(qa_bill_detail.select("qaBill_ID", "Qty"), "qaBill_ID")
        .groupBy("OrderNumber", "day", "team", "sales_team")
        .agg(F.sum("Qty").alias("qty"))
    )
    ordered = order_detail.join(orders.select("OrderNumber"), "OrderNumber", "left_semi").groupBy("OrderNumber").agg(F.sum("Qty").alias("total"))
    sent = report_bundle(
        daily.join(ordered, "OrderNumber", "left"),
        {"daily": ["OrderNumber", "team", "sales_team", "day"], "orders": ["OrderNumber", "team"], "line_chart": ["team", "day"]},
        {"qty": F.sum("qty"), "_known": F.count("total"), "_once": F.max("total"), "_daily": F.sum("total")},
    )
    is_part = lambda name: F.col("part") == name
    sent = sent.where(is_part("daily") | (F.col("_known") > 0)).select(
        "part", "OrderNumber", "team", "sales_team", "day",
        F.when(~is_part("line_chart"), F.col("qty")).alias("qty"),
        F.when(is_part("orders"), F.col("_once")).when(is_part("line_chart"), F.col("_daily")).alias("total_qty"),
    )
    folded = F.col("sales_team")
    for source, target in FOLDED_TEAM.items():
        folded = F.when(F.col("sales_team") == source, F.lit(target)).otherwise(folded)
    nothing = lambda column: F.lit(None).cast(sent.schema[column].dataType).alias(column)
    passed = (
        qa_finish_master.where(date_between(F.col("finishDate"), bill_from, bill_to))
        .select("qaFinish_ID", "OrderNumber", F.to_date("finishDate").alias("day"))
        .join(keyed, "OrderNumber")
        .join(qa_finish_detail.select("qaFinish_ID", "Qty"), "qaFinish_ID")
        .groupBy("day", folded.alias("sales_team"))
        .agg(F.sum("Qty").alias("qty"))
        .select(F.lit("passed").alias("part"), nothing("OrderNumber"), nothing("team"), "sales_team", "day", "qty", nothing("total_qty"))
    )
    return sent.union(passed)


def factory_to_qa_day(
    order_detail: DataFrame,
    product_master: DataFrame,
    employee: DataFrame,
    qa_bill_master: DataFrame,
    qa_bill_detail: DataFrame,
    qa_finish_master: DataFrame,
    qa_finish_detail: DataFrame,
    qa_repair_master: DataFrame,
    qa_repair_detail: DataFrame,
    reasons: DataFrame,
    types: DataFrame,
    type_details: DataFrame,
    first: date,
    last: date,
) -> DataFrame:
    """Items of the orders active in a period (one day in the usual call) with what was sent, passed
    and repaired, nested, and the number of report rows each item needs."""
    on = ["OrderNumber", "OrderItemNo"]
    lines = qa_bill_detail.select("qaBill_ID", "bill_Item", "OrderItemNo")
    sent = (
        qa_bill_master.where(date_between(F.col("billDate"), first, last)).select("qaBill_ID", "OrderNumber")
        .join(qa_bill_detail.select("qaBill_ID", "OrderItemNo", "QCPerson", "Qty"), "qaBill_ID")
        .groupBy(*on, "QCPerson").agg(F.sum("Qty").alias("qty"))
    )
    passed = (
        qa_finish_master.where(date_between(F.col("finishDate"), first, last)).select("qaFinish_ID", "qaBill_ID", "OrderNumber")
        .join(qa_finish_detail, "qaFinish_ID").join(lines, ["qaBill_ID", "bill_Item"])
        .groupBy(*on, "QAPerson").agg(F.sum("Qty").alias("qty"))
    )
    repaired = (
        qa_repair_master.where(date_between(F.col("repairDate"), first, last)).select("qaRepair_ID", "qaBill_ID", "OrderNumber")
        .join(qa_repair_detail.select("qaRepair_ID", "repair_Item", "bill_Item"), "qaRepair_ID")
        .join(lines, ["qaBill_ID", "bill_Item"])
        .join(reasons, ["qaRepair_ID", "repair_Item"])
        .groupBy(*on, "type_ID", "reason_No").agg(F.sum("Qty").alias("qty"))
        .join(types, "type_ID").join(type_details, ["type_ID", "reason_No"])
        .select(*on, F.col("repairType").alias("repair_type"), F.col("reasonType").alias("reason"), "qty")
    )
    sent = role_join(sent, employee, "EmpCode", {"p": ("QCPerson", {"person": _person()})})
    passed = role_join(passed, employee, "EmpCode", {"p": ("QAPerson", {"person": _person()})})
    active = sent.select("OrderNumber").union(passed.select("OrderNumber")).union(repaired.select("OrderNumber")).distinct()
    items = order_detail.withColumnRenamed("ItemNo", "OrderItemNo").join(active, "OrderNumber", "left_semi")
    items = items.join(product_master.select("ProductID", "ProductCode", "NewPict"), "ProductID")
    items = number_rows(items, ["OrderNumber"], ["ForSort", "OrderItemNo"], "display_no")
    children = [
        (sent, ["person", "qty"], "fac_send"),
        (passed, ["person", "qty"], "qa_pass"),
        (repaired, ["repair_type", "reason", "qty"], "qa_repair"),
    ]
    return nest_many(items, children, on).select(
        F.col("OrderNumber").alias("order_number"),
        "display_no",
        F.col("OrderItemNo").alias("item_no"),
        F.col("ProductCode").alias("product_code"),
        F.col("Qty").alias("qty"),
        "fac_send", "qa_pass", "qa_repair",
        row_span(F.col("fac_send"), F.col("qa_pass"), F.col("qa_repair")).alias("row_span"),
    )


def bills_of_items(qa_bill_master: DataFrame, qa_bill_detail: DataFrame, employee: DataFrame) -> DataFrame:
    """Inspection bills that hold an order item."""
    heads = qa_bill_master.select("qaBill_ID", "qaDocNumber", "billDate", "SenderNew")
    rows = heads.join(qa_bill_detail, "qaBill_ID")
    roles = {"s": ("SenderNew", {"sender_name": _person()}), "q": ("QCPerson", {"qc_person": _person()})}
    return role_join(rows, employee, "EmpCode", roles).select(
        F.col("OrderNumber").alias("order_number"),
        F.col("OrderItemNo").alias("item_no"),
        F.col("qaDocNumber").alias("doc_number"),
        shift_hours(F.col("billDate"), CLOCK_SHIFT).alias("bill_date"),
        F.col("qaJobNumber").alias("qa_job_number"),
        "qc_person",
        "sender_name",
        F.col("Qty").alias("qty"),
    )
