"""Order status, order contents, processes, casting repair and pricing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupewright.functions import labels as L
from loupewright.functions.dates import days_until
from loupewright.functions.numbers import guarded_ratio, int_percent, zero_if_null
from loupewright.functions.text import picture_url, trimmed_length
from loupewright.operators.aggregates import pivot_zero, sum_where
from loupewright.operators.filters import ALL_TEAMS, in_padded, live_orders
from loupewright.operators.joins import densify, left_default, lookup_agg, restrict

#: One output column per production process.
PROCESS_COLUMNS = {code: f"p{int(code)}" for code in L.PROCESS_CODES}

# Casting output types counted as normal and as sample work.
NORMAL_CASTING = ("1", "2", "3", "5")
SAMPLE_CASTING = ("4", "6", "7")


def _job_wip(job_order: DataFrame, job_status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces in each process, one column per process; jobs without a process row count as 0."""
    pieces = job_status.select(
        "JobNumber", "PDProcessCode", (F.col("In_Q") + F.col("Out_Q") + F.col("Receive_Q") + F.col("Send_Q")).alias("wip")
    )
    return pivot_zero(job_order.join(pieces, "JobNumber", "left"), keys, "PDProcessCode", PROCESS_COLUMNS, "wip")


def order_status(
    order_master: DataFrame,
    customer: DataFrame,
    job_order: DataFrame,
    job_status: DataFrame,
    qa_bill_detail: DataFrame,
    as_of: date,
    due_from: date,
    due_to: date,
    order_year: int | None = None,
    managers: Mapping[str, str] = L.MANAGERS,
) -> DataFrame:
    """Live orders due in a range, with days left, inspection progress, work in process and status."""
    orders = live_orders(order_master, exclude_test=False, order_year=order_year)
    orders = orders.where(F.col("DueDate").between(due_from, due_to)).join(customer, "CusCode")
    # Only the wanted orders' jobs and bills are pivoted and summed.
    job_order, qa_bill_detail = (restrict(x, orders, ["OrderNumber"]) for x in (job_order, qa_bill_detail))
    wip = _job_wip(job_order, job_status, ["OrderNumber"])
    ordered = job_order.groupBy("OrderNumber").agg(F.sum("JobQty").alias("total_qty"))
    billed = qa_bill_detail.groupBy("OrderNumber").agg(F.sum("Qty").alias("total_qa"))
    joined = left_default(
        orders.join(wip, "OrderNumber").join(ordered, "OrderNumber", "left"),
        billed,
        ["OrderNumber"],
        {"total_qa": 0, "total_qty": 0},
    )
    late, pct = F.col("days_left"), F.col("qa_percent")
    return joined.select(
        F.col("OrderNumber").alias("order_number"),
        F.col("DueDate").alias("due_date"),
        F.col("CusCode").alias("customer"),
        F.col("ProductionTeam").alias("team"),
        days_until(as_of, F.col("DueDate")).alias("days_left"),
        "total_qa",
        "total_qty",
        L.label(F.col("CusStatus"), managers, L.NO_DATA).alias("manager"),
        L.label(F.col("ProductionTeam"), L.TEAMS, L.NO_TEAM).alias("team_name"),
        L.weekday_label(F.col("DueDate"), L.NO_DATA).alias("due_weekday"),
        *PROCESS_COLUMNS.values(),
        int_percent(F.col("total_qa"), F.col("total_qty")).alias("qa_percent"),
    ).withColumn(
        "status",
        F.when((late >= 5) & (pct >= 50), L.ORDER_EARLY)
        .when((late < 5) & (pct <= 50), L.ORDER_PUSH)
        .when(late < 0, L.ORDER_OVERDUE)
        .otherwise(L.ORDER_NORMAL),
    )


def order_list(
    order_master: DataFrame, customer: DataFrame, order_year: int, managers: Mapping[str, str] = L.MANAGERS
) -> DataFrame:
    """Live orders of a year with manager and team names."""
    orders = live_orders(order_master, exclude_test=False, order_year=order_year)
    return orders.join(customer, "CusCode").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("OrderDate").alias("order_date"),
        F.col("DueDate").alias("due_date"),
        L.label(F.col("CusStatus"), managers, L.NO_DATA).alias("manager"),
        L.label(F.col("ProductionTeam"), L.TEAMS, L.NO_TEAM).alias("team_name"),
    )


def order_items(order_detail: DataFrame, product_master: DataFrame) -> DataFrame:
    """Items of each order with their product."""
    return order_detail.join(product_master, "ProductID").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("ItemNo").alias("item_no"),
        F.col("ProductID").alias("product_id"),
        F.col("ProductCode").alias("product_code"),
        F.col("ProductDesc").alias("product_desc"),
        F.col("Qty").alias("qty"),
        picture_url(F.col("NewPict")).alias("picture"),
    )


def order_stones(
    order_detail: DataFrame, product_detail: DataFrame, inv_master: DataFrame, groups: Sequence[str] = L.STONE_GROUPS
) -> DataFrame:
    """Stones each order item needs: order quantity times the quantity in the bill of material."""
    stones = inv_master.where(F.col("InvGroupCode").isin(list(groups))).select("InvCode")
    bom = product_detail.join(stones, "InvCode").select("ProductID", "InvCode", F.col("Qty").alias("_per_piece"))
    return order_detail.join(bom, "ProductID").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("ItemNo").alias("item_no"),
        F.col("ProductID").alias("product_id"),
        F.col("InvCode").alias("inv_code"),
        (F.col("Qty") * F.col("_per_piece")).alias("total_stone"),
        F.when(trimmed_length(F.col("InvCode").cast("string")) < 9, 1).otherwise(0).alias("is_random"),
    )


def order_own_parts(order_product_detail: DataFrame, groups: Sequence[str] = L.PART_GROUPS) -> DataFrame:
    """Parts of each order that the factory casts itself; purchase figures are placeholders."""
    return order_product_detail.where(F.col("InvGroupCode").isin(list(groups))).select(
        F.col("OrderNumber").alias("order_number"),
        F.col("InvCode").alias("inv_code"),
        F.col("Qty").alias("qty_req"),
        *[F.lit(0).alias(c) for c in ("qty_purchase", "qty_received", "qty_to_fact", "qty_balance")],
        F.lit(L.OWN_CASTING_DUE).alias("supplier_due"),
        F.lit(L.OWN_CASTING).alias("supplier"),
    )


def item_parts(mpp_status_product: DataFrame, inv_master: DataFrame, groups: Sequence[str] = L.PART_GROUPS) -> DataFrame:
    """Parts of each order item with the unit they are counted in."""
    parts = inv_master.where(F.col("InvGroupCode").isin(list(groups)))
    return mpp_status_product.join(parts, "InvCode").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("OrderItemNo").alias("item_no"),
        F.col("InvCode").alias("inv_code"),
        F.col("QtyReq").alias("total_qty"),
        L.unit_of_price(F.col("PriceType"), F.col("QtyUnit"), F.col("WgUnitName")).alias("unit"),
    )


def item_process(
    job_order: DataFrame, job_status: DataFrame, qa_bill_detail: DataFrame, product_master: DataFrame
) -> DataFrame:
    """Each job with its pieces per process and its inspection percentage."""
    jobs = _job_wip(job_order, job_status, ["JobNumber", "OrderNumber", "OrderItemNo", "ProductID", "JobQty"])
    billed = lookup_agg(
        jobs, qa_bill_detail.select("OrderNumber", "OrderItemNo", "Qty"), ["OrderNumber", "OrderItemNo"],
        {"total_qa": F.sum("Qty")}, {"total_qa": 0},
    )
    return billed.join(product_master.select("ProductID", "ProductCode", "NewPict"), "ProductID", "left").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("JobNumber").alias("job_number"),
        F.col("OrderItemNo").alias("item_no"),
        F.col("ProductID").alias("product_id"),
        F.col("ProductCode").alias("product_code"),
        picture_url(F.col("NewPict")).alias("picture"),
        F.col("JobQty").alias("job_qty"),
        "total_qa",
        F.when(F.col("JobQty") != 0, int_percent(F.col("total_qa"), F.col("JobQty"))).alias("qa_percent"),
        *PROCESS_COLUMNS.values(),
    )


def _in_process() -> Column:
    return F.col("In_Q") + F.col("Send_Q") + F.col("Out_Q")


def process_totals(pd_process: DataFrame, job_order: DataFrame, job_status: DataFrame) -> DataFrame:
    """Each process of each order that has jobs, with the pieces in it; processes without pieces show 0."""
    jobs = job_order.join(job_status, "JobNumber")
    every = job_order.select("OrderNumber").distinct()
    filled = densify(
        every, pd_process, "PDProcessCode", jobs.withColumn("total", _in_process()), ["OrderNumber"], ["total"]
    )
    return filled.join(pd_process, "PDProcessCode").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("PDProcessCode").alias("process_code"),
        F.col("PDProcessName").alias("process_name"),
        F.col("PDProcessSortBy").alias("sort_by"),
        "total",
    )


def items_in_process(job_order: DataFrame, job_status: DataFrame, product_master: DataFrame) -> DataFrame:
    """Jobs that have pieces in a process."""
    busy = job_status.where(_in_process() > 0)
    return job_order.join(busy, "JobNumber").join(product_master.select("ProductID", "ProductCode"), "ProductID").select(
        F.col("OrderNumber").alias("order_number"),
        F.col("OrderItemNo").alias("item_no"),
        F.col("JobNumber").alias("job_number"),
        F.col("PDProcessCode").alias("process_code"),
        F.col("ProductID").alias("product_id"),
        F.col("ProductCode").alias("product_code"),
        F.col("JobQty").alias("job_qty"),
        F.col("In_Q").alias("in_q"),
        F.col("Send_Q").alias("send_q"),
        F.col("Out_Q").alias("out_q"),
    )


def worker_weight(
    worker_bill: DataFrame,
    material: DataFrame,
    detail: DataFrame,
    returned: DataFrame,
    job_order: DataFrame,
    employee: DataFrame,
    bill_from: date,
    bill_to: date,
    receivers: Sequence | None = None,
) -> DataFrame:
    """Metal loss per worker bill item: (sent + material - returned) as a percentage of returned."""
    bills = worker_bill.where(F.col("BillDate").between(bill_from, bill_to))
    if receivers is not None:
        bills = bills.where(in_padded(F.col("Receiver"), receivers))
    back = returned.groupBy("Bill_ID", "ItemNo").agg(F.sum("RvTotalWeight").alias("return_weight"))
    names = employee.select(F.col("EmpCode").alias("Receiver"), F.col("EmpFullName").alias("receiver_name"))
    rows = (
        bills.join(material, "Bill_ID", "left")
        .join(detail, "Bill_ID")
        .join(back, ["Bill_ID", "ItemNo"], "left")
        .join(job_order.select("JobNumber", "OrderNumber", "ProductID"), "JobNumber", "left")
        .join(names, "Receiver", "left")
    )
    sent, extra, back_weight = F.col("SendWeight"), F.col("material_weight"), F.col("return_weight")
    return rows.select(
        F.col("Bill_ID").alias("bill_id"),
        F.col("BillNumber").alias("bill_number"),
        F.col("BillDate").alias("bill_date"),
        "receiver_name",
        F.coalesce(F.col("InvCode").cast("string"), F.lit("-")).alias("inv_code"),
        zero_if_null(F.col("MatTotalWeight")).alias("material_weight"),
        F.col("ItemNo").alias("item_no"),
        F.col("JobNumber").alias("job_number"),
        F.col("OrderNumber").alias("order_number"),
        F.col("ProductID").alias("product_id"),
        F.col("SendQty").alias("send_qty"),
        sent.alias("send_weight"),
        F.round(F.when(sent == 0, F.lit(0.0)).otherwise(guarded_ratio(F.col("SendQty"), sent)), 6).alias("qty_per_weight"),
        "return_weight",
    ).withColumn(
        "loss_percent",
        F.round(guarded_ratio(F.col("send_weight") + extra - back_weight, back_weight) * 100, 6),
    )


def qa_daily_series(
    qa_bill_master: DataFrame,
    qa_bill_detail: DataFrame,
    order_master: DataFrame,
    as_of: date,
    teams: Sequence[str],
    days: int = 10,
) -> DataFrame:
    """Pieces sent to inspection per day over the last days; team "0" stands for all teams.

    Bills of the last day count only up to its midnight, as with any range on a timestamp.
    """
    start = F.lit(as_of - timedelta(days=days - 1)).cast("timestamp_ntz")
    bills = qa_bill_master.where((F.col("billDate") >= start) & (F.col("billDate") <= F.lit(as_of).cast("timestamp_ntz")))
    wanted = order_master.where(in_padded(F.col("ProductionTeam"), teams, {"0": ALL_TEAMS})).select("OrderNumber")
    pieces = qa_bill_detail.select("qaBill_ID", "Qty")
    return (
        bills.join(wanted, "OrderNumber", "left_semi")
        .join(pieces, "qaBill_ID")
        .groupBy(F.to_date("billDate").alias("bill_day"))
        .agg(F.sum("Qty").alias("total_qty"))
    )


def casting_repair_item(
    job_order: DataFrame, order_master: DataFrame, product_master: DataFrame, casting_output: DataFrame, cast_repair: DataFrame
) -> DataFrame:
    """Casting, sample and repair quantities per job."""
    keys = ["OrderNumber", "JobNumber"]
    repair = cast_repair.groupBy(*keys).agg(F.sum("SendQty").alias("repair_sent"), F.sum("ReturnQty").alias("repair_returned"))
    cast = casting_output.groupBy(*keys).agg(
        sum_where(F.col("OutputType").isin(*NORMAL_CASTING), F.col("Qty")).alias("cast_normal"),
        sum_where(F.col("OutputType").isin(*SAMPLE_CASTING), F.col("Qty")).alias("cast_sample"),
    )
    jobs = job_order.join(order_master.select("OrderNumber"), "OrderNumber", "left_semi")
    jobs = jobs.join(product_master.select("ProductID", "ProductCode"), "ProductID")
    filled = left_default(jobs.join(repair, keys, "left"), cast, keys, dict.fromkeys(_CASTING, 0))
    return filled.select(
        F.col("OrderNumber").alias("order_number"),
        F.col("JobNumber").alias("job_number"),
        F.col("OrderItemNo").alias("item_no"),
        F.col("ProductID").alias("product_id"),
        F.col("ProductCode").alias("product_code"),
        F.col("JobQty").alias("job_qty"),
        *_CASTING,
    )


_CASTING = ("repair_sent", "repair_returned", "cast_normal", "cast_sample")


def casting_repair_order(
    job_order: DataFrame,
    order_master: DataFrame,
    casting_output: DataFrame,
    cast_repair: DataFrame,
    order_from: date,
    order_to: date,
    status: str = "2",
) -> DataFrame:
    """Casting and repair totals per live order, with a three-way status.

    Only work on a known job counts, so the job key filters the facts before they are summed.
    """
    orders = order_master.where((F.col("Status") == status) & F.col("OrderDate").between(order_from, order_to))
    job_order = restrict(job_order, orders, ["OrderNumber"])
    known = job_order.select("OrderNumber", "JobNumber")
    on = ["OrderNumber", "JobNumber"]
    repair = cast_repair.join(known, on, "left_semi").groupBy("OrderNumber").agg(
        F.sum("SendQty").alias("repair_sent"), F.sum("ReturnQty").alias("repair_returned")
    )
    cast = casting_output.join(known, on, "left_semi").groupBy("OrderNumber").agg(
        sum_where(F.col("OutputType").isin(*NORMAL_CASTING), F.col("Qty")).alias("cast_normal"),
        sum_where(F.col("OutputType").isin(*SAMPLE_CASTING), F.col("Qty")).alias("cast_sample"),
    )
    jobs = job_order.groupBy("OrderNumber").agg(F.sum("JobQty").alias("job_qty"))
    rows = orders.join(jobs, "OrderNumber").join(repair, "OrderNumber", "left")
    rows = left_default(rows, cast, ["OrderNumber"], dict.fromkeys(_CASTING, 0))
    sent, back = F.col("repair_sent"), F.col("repair_returned")
    return rows.select(
        F.col("OrderNumber").alias("order_number"),
        F.col("OrderDate").alias("order_date"),
        F.col("ProductionTeam").alias("team"),
        "job_qty",
        *_CASTING,
        F.when((sent == 0) & (back == 0), L.CAST_NONE)
        .when((sent > 0) & (back < sent), L.CAST_PARTIAL)
        .when((sent > 0) & (back >= sent), L.CAST_COMPLETE)
        .otherwise("")
        .alias("status"),
        L.weekday_label(F.col("OrderDate"), L.NO_DATA).alias("order_weekday"),
    )


COST_COLUMNS = (
    "CastingCost", "PolishingCost", "PlattingCost", "SandCost", "RhodiumCost", "OtherCost", "PackingCost", "QcCost",
    "AdminCost",
)


def product_price(
    product_master: DataFrame,
    product_detail: DataFrame,
    inv_master: DataFrame,
    inv_cost: DataFrame,
    stone_setting_cost: DataFrame,
    silver_price: float,
    silver_markup: float = 1.0,
    material_markup: float = 1.0,
    labour_markup: float = 1.0,
    total_markup: float = 1.0,
    price_tier: str = "1",
    stone_groups: Sequence[str] = L.STONE_GROUPS,
) -> DataFrame:
    """Price of every product: silver by weight, material by tier and pricing unit, labour with setting."""
    price = F.col("StdPrice") if price_tier == "1" else F.col("StdPrice2")
    rows = product_detail.join(inv_master, "InvCode").join(inv_cost, "InvCode", "left")
    material = (
        F.when(F.col("PriceType") == "Q", F.col("Qty") * price)
        .when(F.col("PriceType") == "W", F.col("Qty") * F.col("WgUnit") * price)
    )
    setting_keys = ["StoneShapeCode", "StoneSizeCode", "SettingTypeCode"]
    setting = stone_setting_cost.groupBy(*setting_keys).agg(F.sum("Cost").alias("Cost"))
    rows = rows.join(setting, setting_keys, "left")
    sums = rows.groupBy("ProductID").agg(
        F.sum(material).alias("material_price"),
        F.sum(F.when(F.col("InvGroupCode").isin(list(stone_groups)), F.col("Qty") * F.col("Cost"))).alias("setting_cost"),
    )
    priced = left_default(product_master, sums, ["ProductID"], {"material_price": 0.0, "setting_cost": 0.0})
    labour = F.col("setting_cost")
    for cost in COST_COLUMNS:
        labour = labour + F.col(cost)
    return priced.select(
        F.col("ProductID").alias("product_id"),
        F.col("ProductCode").alias("product_code"),
        F.col("ProductDesc").alias("product_desc"),
        picture_url(F.col("NewPict")).alias("picture"),
        F.col("NetWeightCal").alias("net_weight"),
        (F.col("NetWeightCal") * silver_price * silver_markup).alias("total_silver"),
        (F.col("material_price") * material_markup).alias("total_material"),
        (labour * labour_markup).alias("total_labour"),
    ).withColumn(
        "total_price", (F.col("total_silver") + F.col("total_material") + F.col("total_labour")) * total_markup
    )
