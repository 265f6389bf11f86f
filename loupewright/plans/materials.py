"""Purchased material: need, status, bills, batches."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupewright.functions import labels as L
from loupewright.functions.dates import days_until, unset_before
from loupewright.functions.text import clock_text, display_name, picture_url
from loupewright.operators.filters import ALL_BILL_TEAMS, in_padded, live_orders
from loupewright.operators.joins import left_default, role_join
from loupewright.operators.nesting import nest, nest_many

# Stands for an unknown date; dates before the year count as not set.
UNKNOWN_DATE = date(2000, 1, 1)
UNSET_YEAR = 2015
SET_AFTER = date(2020, 1, 1)
DEFERRAL = "03"


def material_status_order(
    purchase_status: DataFrame, supplier: DataFrame, as_of: date, unset_year: int = UNSET_YEAR
) -> DataFrame:
    """Purchase lines with the due weekday and a five-way status; a line due today has none."""
    need, got, due = F.col("QtyReq"), F.col("QtyToFact"), F.col("SupDueDate")
    unset = unset_before(due, unset_year)
    return purchase_status.join(supplier, "SupplierCode").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("MP_ItemNo").alias("line_no"),
        F.col("InvCode").alias("inv_code"),
        need.alias("qty_req"),
        F.col("QtyPurchase").alias("qty_purchase"),
        F.col("QtyPcReceive").alias("qty_received"),
        got.alias("qty_to_fact"),
        (need - got).alias("qty_balance"),
        due.alias("supplier_due"),
        F.col("SupplierName").alias("supplier"),
        L.weekday_label(due).alias("due_weekday"),
        F.when(got >= need, L.STONE_COMPLETE)
        .when((F.col("QtyPurchase") == 0) & unset, L.STONE_ORDERED)
        .when((F.col("QtyPurchase") > 0) & unset, L.STONE_NO_DATE)
        .when((got < need) & (due < F.lit(as_of)), L.STONE_LATE)
        .when((got < need) & (due > F.lit(as_of)), L.STONE_NORMAL)
        .alias("status"),
    )


def material_need(purchase_status: DataFrame) -> DataFrame:
    """Required quantity per order and material."""
    needs = purchase_status.groupBy("OrderNumber", "InvCode").agg(F.sum("QtyReq").alias("qty_req"))
    return needs.withColumnsRenamed({"OrderNumber": "order_number", "InvCode": "inv_code"})


def material_plan_list(
    material_plan: DataFrame, order_master: DataFrame, inv_master: DataFrame, supplier: DataFrame, order_year: int
) -> DataFrame:
    """Planned material of the live orders of a year with the chosen supplier."""
    orders = live_orders(order_master, exclude_test=False, order_year=order_year)
    rows = material_plan.join(orders.select("OrderNumber", "ProductionTeam"), "OrderNumber")
    rows = rows.join(inv_master.select("InvCode", "InvDescE"), "InvCode", "left")
    names = supplier.select(F.col("SupplierCode").alias("SupplierSelect"), "SupplierName")
    return rows.join(names, "SupplierSelect", "left").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("InvCode").alias("inv_code"),
        F.col("InvDescE").alias("inv_desc"),
        F.col("QtyReq").alias("qty_req"),
        F.col("SupplierName").alias("supplier"),
        F.col("ProductionTeam").alias("team"),
    )


def _purchases(purchase_status: DataFrame) -> DataFrame:
    """Purchase totals per (order, material); with a supplier name column, also the first name."""
    totals = [
        F.max("FactDueDate").alias("_fact_max"),
        F.min("FactDueDate").alias("_fact_min"),
        F.max("SupDueDate").alias("sup_due"),
        F.sum("QtyPurchase").alias("qty_purchase"),
    ]
    if "SupplierName" in purchase_status.columns:
        place = F.when(F.col("SupplierName").isNotNull(), F.struct("MP_ItemNo", "SupplierName"))
        totals.append(F.min_by("SupplierName", place).alias("_supplier"))
    return purchase_status.groupBy("OrderNumber", "InvCode").agg(*totals)


def _item_materials(
    mpp_status_product: DataFrame,
    inv_master: DataFrame,
    order_detail: DataFrame,
    purchases: DataFrame,
    as_of: date,
    groups: Sequence[str],
    unknown: date,
    unset: date,
    set_after: date,
) -> DataFrame:
    """Item materials with need, purchase totals and the five-way status."""
    stones = inv_master.where(F.col("InvGroupCode").isin(list(groups))).select("InvCode")
    items = order_detail.groupBy("OrderNumber", F.col("ItemNo").alias("OrderItemNo")).agg(F.sum("Qty").alias("_ordered"))
    rows = mpp_status_product.join(stones, "InvCode", "left_semi").join(items, ["OrderNumber", "OrderItemNo"], "left")
    rows = left_default(rows, purchases, ["OrderNumber", "InvCode"], {"sup_due": unknown, "qty_purchase": 0})
    got, need, bought, due = F.col("QtyFacReceive"), F.col("qty_stone"), F.col("qty_purchase"), F.col("sup_due")
    short = (bought > 0) & (due > F.lit(set_after)) & (got < need)
    return (
        rows.withColumn("qty_stone", F.coalesce(F.col("_ordered") * F.col("QtyReq"), F.lit(0)))
        .withColumn("fact_due_max", F.coalesce(F.col("_fact_max"), F.lit(unknown)))
        .withColumn("late_days", days_until(as_of, F.col("fact_due_max")))
        .withColumn(
            "status",
            F.when(got >= need, L.STONE_COMPLETE)
            .when((bought <= 0) & (due < F.lit(unset)), L.STONE_NOT_ORDERED)
            .when((bought > 0) & (due < F.lit(unset)), L.STONE_ORDERED)
            .when(short & (F.col("late_days") >= 0), L.STONE_NORMAL)
            .when(short & (F.col("late_days") < 0), L.STONE_LATE)
            .otherwise(""),
        )
    )


def material_by_item(
    mpp_status_product: DataFrame,
    inv_master: DataFrame,
    order_detail: DataFrame,
    purchase_status: DataFrame,
    purchase_history: DataFrame,
    supplier: DataFrame,
    bill_master: DataFrame,
    bill_detail: DataFrame,
    bill_material: DataFrame,
    job_order: DataFrame,
    as_of: date,
    groups: Sequence[str] = L.STONE_GROUPS,
    unknown: date = UNKNOWN_DATE,
    unset: date = date(UNSET_YEAR, 1, 1),
    set_after: date = SET_AFTER,
) -> DataFrame:
    """Billed materials of each item: need, received, first and last due date, deferral, lateness, status."""
    material = ["OrderNumber", "InvCode"]
    deferred = (
        purchase_history.where(F.col("HistoryTypeCode") == DEFERRAL)
        .groupBy(*material)
        .agg(F.min("FacFromDate").alias("_deferred_from"), F.lit(1).alias("is_deferred"))
    )
    # The two per-material tables meet first, on the partitioning they share.
    purchases = _purchases(purchase_status.join(supplier, "SupplierCode", "left")).join(deferred, material, "full")
    rows = _item_materials(
        mpp_status_product, inv_master, order_detail, purchases, as_of, groups, unknown, unset, set_after
    )
    item = ["OrderNumber", "OrderItemNo", "InvCode"]
    billed = (
        bill_master.select("Bill_ID", "OrderNumber", "BillDate")
        .join(bill_detail.select("Bill_ID", "ItemNo", "JobNumber"), "Bill_ID")
        .join(bill_material.select("Bill_ID", "ItemNo", "InvCode"), ["Bill_ID", "ItemNo"])
        .join(job_order.select("OrderNumber", "JobNumber", "OrderItemNo"), ["OrderNumber", "JobNumber"])
        .groupBy(*item)
        .agg(F.max("BillDate").alias("max_bill"))
    )
    rows = rows.join(billed, item)
    first_due = F.coalesce(F.col("_deferred_from"), F.col("_fact_min"))
    return rows.select(
        F.col("OrderNumber").alias("order_number"),
        F.col("OrderItemNo").alias("item_no"),
        F.col("InvCode").alias("inv_code"),
        "qty_stone",
        F.col("QtyReceive").alias("qty_receive"),
        F.col("QtyFacReceive").alias("qty_fac_receive"),
        first_due.alias("fact_due_min"),
        "fact_due_max",
        "sup_due",
        "qty_purchase",
        "late_days",
        F.coalesce(F.col("_supplier"), F.lit("0")).alias("supplier"),
        F.col("IsWaxSet").alias("is_wax_set"),
        L.weekday_label(first_due).alias("due_min_weekday"),
        L.weekday_label(F.col("fact_due_max")).alias("due_max_weekday"),
        "status",
        F.coalesce(F.col("is_deferred"), F.lit(0)).alias("is_deferred"),
        "max_bill",
    )


def items_by_material_status(
    mpp_status_product: DataFrame,
    inv_master: DataFrame,
    order_detail: DataFrame,
    purchase_status: DataFrame,
    as_of: date,
    statuses: Sequence[str],
    groups: Sequence[str] = L.STONE_GROUPS,
    unknown: date = UNKNOWN_DATE,
    unset: date = date(UNSET_YEAR, 1, 1),
    set_after: date = SET_AFTER,
) -> DataFrame:
    """Order items with a material in one of the statuses."""
    rows = _item_materials(
        mpp_status_product, inv_master, order_detail, _purchases(purchase_status), as_of, groups, unknown, unset, set_after
    )
    kept = rows.where(in_padded(F.col("status"), statuses))
    return kept.select(F.col("OrderNumber").alias("order_number"), F.col("OrderItemNo").alias("item_no")).distinct()


def items_by_material(
    mpp_status_product: DataFrame,
    inv_master: DataFrame,
    purchase_status: DataFrame,
    groups: Sequence[str],
    wax_set: str | None = None,
    due: tuple[date, date] | None = None,
) -> DataFrame:
    """Order items with a material of a group, set type, and factory due date range."""
    rows = mpp_status_product
    if wax_set is not None:
        rows = rows.where(F.col("IsWaxSet") == wax_set)
    stones = inv_master.where(F.col("InvGroupCode").isin(list(groups))).select("InvCode")
    rows = rows.join(stones, "InvCode", "left_semi")
    if due is not None:
        dated = purchase_status.where(F.col("FactDueDate").between(*due)).select("OrderNumber", "InvCode")
        rows = rows.join(dated, ["OrderNumber", "InvCode"], "left_semi")
    return rows.select(F.col("OrderNumber").alias("order_number"), F.col("OrderItemNo").alias("item_no")).distinct()


def _queue_title(number: Column) -> Column:
    return F.when(number == L.QUEUE_UNSET, L.QUEUE_NONE).otherwise(F.concat(F.lit(L.QUEUE_PREFIX), number.cast("string")))


def queue(mpp_status: DataFrame, product_master: DataFrame, mold_status: DataFrame) -> DataFrame:
    """Items with their mould status and queue label."""
    moulds = mold_status.select(F.col("StatusCode").alias("MoldStatus"), F.col("StatusName").alias("mold_status"))
    rows = mpp_status.join(product_master.select("ProductID", "ProductCode", "NewPict"), "ProductID")
    return left_default(rows, moulds, ["MoldStatus"], {"mold_status": ""}).select(
        F.col("OrderNumber").alias("order_number"),
        F.col("OrderItemNo").alias("item_no"),
        F.col("ProductID").alias("product_id"),
        F.col("ProductCode").alias("product_code"),
        F.col("Qty").alias("qty"),
        F.col("Piority").alias("queue_no"),
        _queue_title(F.col("Piority")).alias("queue"),
        "mold_status",
        picture_url(F.col("NewPict")).alias("picture"),
    )


def queue_numbers(mpp_status: DataFrame) -> DataFrame:
    """Queue numbers an order uses."""
    numbers = mpp_status.select("OrderNumber", "Piority").distinct()
    return numbers.select(
        F.col("OrderNumber").alias("order_number"),
        F.col("Piority").alias("queue_no"),
        _queue_title(F.col("Piority")).alias("queue"),
    )


def purchase_detail(purchase_status: DataFrame, supplier: DataFrame, pc_master: DataFrame) -> DataFrame:
    """Purchase lines with supplier and purchase document."""
    rows = left_default(purchase_status, supplier, ["SupplierCode"], {"SupplierName": ""})
    return rows.join(pc_master, "PcID", "left").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("MP_ItemNo").alias("line_no"),
        F.col("InvCode").alias("inv_code"),
        F.col("SupplierName").alias("supplier"),
        F.col("SupDueDate").alias("supplier_due"),
        F.col("QtyPurchase").alias("qty_purchase"),
        F.col("QtyPcReceive").alias("qty_received"),
        F.col("PcDocNumber").alias("document"),
        F.col("DocDate").alias("document_date"),
    )


def deferral_history(purchase_history: DataFrame, employee: DataFrame, reasons: DataFrame) -> DataFrame:
    """Deferrals of purchase lines with author and both reasons."""
    rows = purchase_history.where(F.col("HistoryTypeCode") == DEFERRAL)
    people = employee.select("EmpCode", display_name(F.col("EmpFName"), F.col("NickName")).alias("author"))
    rows = role_join(
        rows.join(people, "EmpCode"),
        reasons,
        "ItemNo",
        {
            "sup": ("SupReasonItemNo", {"supplier_reason": F.col("Description")}),
            "fact": ("FacReasonItemNo", {"factory_reason": F.col("Description")}),
        },
    )
    return rows.select(
        F.col("OrderNumber").alias("order_number"),
        F.col("InvCode").alias("inv_code"),
        F.col("MP_ItemNo").alias("line_no"),
        F.col("HistoryDate").alias("changed_on"),
        clock_text(F.col("HistoryTime")).alias("changed_at"),
        "author",
        F.col("SupFromDate").alias("supplier_from"),
        F.col("SupToDate").alias("supplier_to"),
        F.coalesce("supplier_reason", F.lit("")).alias("supplier_reason"),
        F.coalesce("factory_reason", F.lit("")).alias("factory_reason"),
        F.col("FacFromDate").alias("factory_from"),
        F.col("FacToDate").alias("factory_to"),
    )


def mould_transitions(mold_history: DataFrame, mold_status: DataFrame, employee: DataFrame) -> DataFrame:
    """Mould status changes with both status names; changes with an unknown status or author are left out."""
    status = {"status_from": ("StatusFrom", {"status_from": F.col("StatusName")}),
              "status_to": ("StatusTo", {"status_to": F.col("StatusName")})}
    rows = role_join(mold_history, mold_status, "StatusCode", status)
    rows = role_join(rows, employee, "EmpCode", {"author": ("Updater", {"author": F.col("EmpFullName")})})
    kept = rows.where(F.col("status_from").isNotNull() & F.col("status_to").isNotNull() & F.col("author").isNotNull())
    return kept.select(
        F.col("OrderNo").alias("order_number"),
        F.col("ItemNo").alias("item_no"),
        "status_from",
        "status_to",
        "author",
        F.col("UpdateDate").alias("changed_on"),
        F.col("Reference").alias("reference"),
    )


def bill_receipt(
    bill_master: DataFrame,
    bill_detail: DataFrame,
    bill_material: DataFrame,
    job_order: DataFrame,
    product_master: DataFrame,
    employee: DataFrame,
    team: str = "0",
) -> DataFrame:
    """Bills with people, and two nested arrays: items with their materials, and quantity per material."""
    bills = bill_master.where(in_padded(F.col("FactoryTeam"), [team], {"0": ALL_BILL_TEAMS}))
    senders = employee.select(F.col("EmpCode").alias("Sender"), F.col("EmpFullName").alias("sender_name"))
    bills = bills.join(senders, "Sender")
    bills = role_join(
        bills, employee, "EmpCode",
        {"receiver": ("Receiver", {"receiver_name": F.col("EmpFullName"), "receiver_picture": picture_url(F.col("EmpPict"))})},
    )
    jobs = job_order.select("JobNumber", "OrderItemNo", "ProductID")
    products = product_master.select("ProductID", "ProductCode")
    items = bill_detail.join(jobs, "JobNumber").join(products, "ProductID", "left")
    materials = bill_material.withColumnsRenamed({"InvCode": "inv_code", "SendQty": "send_qty", "MatStatus": "status"})
    items = nest(items, materials, ["Bill_ID", "ItemNo"], ["inv_code", "send_qty", "status"], "materials")
    items = items.select(
        "Bill_ID",
        F.col("ItemNo").alias("item_no"),
        F.col("OrderItemNo").alias("order_item_no"),
        F.col("JobNumber").alias("job_number"),
        F.col("ProductCode").alias("product_code"),
        "materials",
    )
    sums = (
        bill_material.where(F.col("SendQty") > 0)
        .groupBy("Bill_ID", F.col("InvCode").alias("inv_code"))
        .agg(F.sum("SendQty").alias("sum_qty"))
    )
    header = bills.select(
        "Bill_ID",
        F.col("BillNumber").alias("bill_number"),
        F.col("BillDate").alias("bill_date"),
        clock_text(F.col("BillTime")).alias("bill_time"),
        F.col("OrderNumber").alias("order_number"),
        F.col("FactoryTeam").alias("team"),
        F.col("ReceiveDate").alias("receive_date"),
        clock_text(F.col("ReceiveTime")).alias("receive_time"),
        F.col("BillStatus").alias("status"),
        "sender_name",
        F.coalesce("receiver_name", F.lit("")).alias("receiver_name"),
        F.coalesce("receiver_picture", F.lit("")).alias("receiver_picture"),
    )
    fields = ["item_no", "order_item_no", "job_number", "product_code", "materials"]
    children = [(items, fields, "products"), (sums, ["inv_code", "sum_qty"], "sum_inv")]
    return nest_many(header, children, ["Bill_ID"]).withColumnRenamed("Bill_ID", "bill_id")


def recent_bills(bill_master: DataFrame, employee: DataFrame, as_of: date, team: str = "0", days: int = 7) -> DataFrame:
    """Bills not received yet, or received within the last days."""
    teams = in_padded(F.col("FactoryTeam"), [team], {"0": ALL_BILL_TEAMS})
    fresh = F.col("ReceiveDate").isNull() | (F.col("ReceiveDate") > F.lit(as_of - timedelta(days=days)))
    senders = employee.select(F.col("EmpCode").alias("Sender"), F.col("EmpFullName").alias("sender_name"))
    rows = bill_master.where((F.col("BillStatus") != "") & teams & fresh).join(senders, "Sender")
    return rows.select(
        F.col("Bill_ID").alias("bill_id"),
        F.col("BillNumber").alias("bill_number"),
        F.col("BillDate").alias("bill_date"),
        clock_text(F.col("BillTime")).alias("bill_time"),
        "sender_name",
        F.col("FactoryTeam").alias("team"),
        F.col("BillStatus").alias("status"),
        F.lit(0).alias("checkbox"),
        F.col("OrderNumber").alias("order_number"),
    )


def batch_parts(batch_purchase: DataFrame, batch_detail: DataFrame, inv_master: DataFrame, batch_number: str | None = None) -> DataFrame:
    """Purchased part batches, all or one number."""
    detail = batch_detail if batch_number is None else batch_detail.where(F.col("BatchNumber") == batch_number)
    pictures = inv_master.select("InvCode", picture_url(F.col("InvPict")).alias("picture"))
    return detail.join(batch_purchase, ["OrderNumber", "InvCode", "LotNumber"]).join(pictures, "InvCode", "left").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("InvCode").alias("inv_code"),
        F.col("LotNumber").alias("lot_no"),
        F.col("BatchNumber").alias("batch_number"),
        F.col("BatchQty").alias("batch_qty"),
        F.col("PackDate").alias("pack_date"),
        F.col("BatchStatus").alias("batch_status"),
        F.col("PurchasePerson").alias("purchase_person"),
        "picture",
    )
