"""Reports on small hand-made tables with literal expected rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loupewright.functions import labels as L
from loupewright.plans import materials, orders, quality, upkeep, wip
from tests.util import rows, table

AS_OF = date(2022, 6, 15)


def order_tables(spark):
    master = table(
        spark,
        "OrderNumber string, OrderDate date, DueDate date, FactoryDue date, CusCode string, ProductionTeam string, Status string",
        ("CH-1", date(2022, 1, 3), date(2022, 6, 25), date(2022, 6, 18), "c1", "1", "2"),
        ("CH-2", date(2022, 1, 3), date(2022, 6, 16), date(2022, 6, 9), "c2", "9", "2"),
        ("CH-3", date(2022, 1, 3), date(2022, 6, 10), date(2022, 6, 3), "c1", "2", "2"),
        ("CH-4", date(2022, 1, 3), date(2022, 6, 25), date(2022, 6, 18), "c1", "2", "2"),
        ("CH-5", date(2022, 1, 3), date(2022, 6, 25), date(2022, 6, 18), "nobody", "2", "2"),
        ("CH-6", date(2022, 1, 3), date(2022, 6, 25), date(2022, 6, 18), "c1", "2", "3"),
    )
    customer = table(spark, "CusCode string, CusStatus string", ("c1", "1"), ("c2", "8"))
    jobs = [(f"J{n}", f"CH-{n}", 1, "p", 10) for n in range(1, 7)]
    job_order = table(spark, "JobNumber string, OrderNumber string, OrderItemNo int, ProductID string, JobQty bigint", *jobs)
    status = table(
        spark, "JobNumber string, PDProcessCode string, In_Q bigint, Out_Q bigint, Receive_Q bigint, Send_Q bigint",
        ("J1", "20", 1, 2, 3, 4), ("J1", "21", 0, 0, 0, 1), ("J1", "99", 5, 5, 5, 5),
    )
    billed = table(
        spark, "OrderNumber string, OrderItemNo int, Qty bigint",
        ("CH-1", 1, 5), ("CH-2", 1, 5), ("CH-3", 1, 6), ("CH-4", 1, 1),
    )
    return master, customer, job_order, status, billed


def test_order_status_ladder(spark):
    got = orders.order_status(*order_tables(spark), AS_OF, date(2022, 6, 1), date(2022, 6, 30))
    assert rows(got, "order_number", "days_left", "qa_percent", "status") == [
        ("CH-1", 10, 50, L.ORDER_EARLY),
        ("CH-2", 1, 50, L.ORDER_PUSH),
        ("CH-3", -5, 60, L.ORDER_OVERDUE),
        ("CH-4", 10, 10, L.ORDER_NORMAL),
    ]
    first = got.where("order_number = 'CH-1'").first()
    assert (first.p20, first.p21, first.p22, first.p1) == (10, 1, 0, 0)
    assert (first.team_name, first.due_weekday) == ("FAC1", L.WEEKDAYS[7])
    second = got.where("order_number = 'CH-2'").first()
    assert (second.team_name, second.manager) == (L.NO_TEAM, L.NO_DATA)


def test_wip_master_days(spark):
    master = order_tables(spark)[0]
    detail = table(spark, "OrderNumber string, Qty bigint", *[(f"CH-{n}", 4) for n in range(1, 7)], ("CH-1", 6))
    holidays = table(spark, "HolidayDate date", *[(d,) for d in (date(2022, 6, 12), date(2022, 6, 19), date(2022, 6, 15))])
    remarks = table(spark, "OrderNumber string, PlanDes string, QaDes string", ("CH-1", "rush", None))
    finish = table(
        spark, "OrderNumber string, isFinish int, FinishDate date",
        ("CH-3", 1, date(2022, 6, 8)), ("CH-4", 1, date(2022, 6, 7)),
    )
    board = wip.board_orders(master, date(2022, 6, 1), date(2022, 6, 30), due_year_above=2021)
    got = wip.wip_master(board, detail, holidays, remarks, finish, AS_OF)
    assert rows(got, "order_number", "total_days", "working_days", "total_qty", "plan_remark", "qa_remark", "is_finish") == [
        ("CH-1", 10, 8, 10, "rush", "", 0),
        ("CH-2", 1, 0, 4, "", "", 0),
        ("CH-3", -5, -3, 4, "", "", 1),
        ("CH-5", 10, 8, 4, "", "", 0),
    ]


def test_order_due_today_has_no_working_days(spark):
    master = table(
        spark, "OrderNumber string, DueDate date, FactoryDue date, ProductionTeam string, Status string", ("CH-9", AS_OF, AS_OF, "1", "2")
    )
    detail = table(spark, "OrderNumber string, Qty bigint", ("CH-9", 1))
    empty = table(spark, "OrderNumber string, PlanDes string, QaDes string")
    finish = table(spark, "OrderNumber string, isFinish int, FinishDate date")
    holidays = table(spark, "HolidayDate date", (AS_OF,))
    got = wip.wip_master(master, detail, holidays, empty, finish, AS_OF).first()
    assert (got.total_days, got.working_days) == (0, 0)


def test_qa_calendar_balance_and_targets(spark):
    day = lambda n: date(2022, 6, n)
    board = table(spark, "OrderNumber string", ("A",))
    detail = table(spark, "OrderNumber string, Qty bigint", ("A", 10))
    heads = table(spark, "qaBill_ID int, OrderNumber string, billDate timestamp_ntz", (1, "A", datetime(2022, 6, 2, 23)), (2, "A", datetime(2022, 6, 4)))
    lines = table(spark, "qaBill_ID int, Qty bigint", (1, 3), (1, 1), (2, 8))
    due = table(
        spark, "OrderNumber string, HistoryNo int, DueDate date, Qty bigint",
        ("A", 1, day(1), 10), ("A", 2, day(3), 4), ("A", 3, day(3), 6),
    )
    got = wip.qa_calendar(board, detail, heads, lines, due)
    assert rows(got, "day", "to_qa", "first_target", "last_target", "balance", "total_to_qa") == [
        (day(1), 0, 10, 0, 10, 12), (day(2), 4, 0, 0, 6, 12), (day(3), 0, 0, 6, 6, 12), (day(4), 8, 0, 0, -2, 12),
    ]
    only_first = due.where("HistoryNo = 1")
    again = wip.qa_calendar(board, detail, heads, lines, only_first)
    assert {r.last_target for r in again.collect()} == {0}


def test_material_lateness_is_frozen_when_finished(spark):
    status = table(
        spark, "OrderNumber string, QtyReq bigint, QtyToFact bigint, FactDueDate date",
        ("A", 5, 5, date(2022, 6, 10)), ("B", 5, 4, date(2022, 6, 10)), ("C", 5, 5, date(2022, 6, 10)),
    )
    bills = table(spark, "OrderNumber string, BillDate date", ("A", date(2022, 6, 1)), ("B", date(2022, 6, 1)))
    got = wip.material_lateness_orders(status, bills, AS_OF)
    assert rows(got, "order_number", "is_finish", "late_days") == [("A", 1, 9), ("B", 0, -5), ("C", 1, None)]


def test_job_lateness_counts_a_material_once(spark):
    item = table(spark, "OrderNumber string, OrderItemNo int, Qty bigint", ("A", 1, 2))
    product = table(spark, "OrderNumber string, OrderItemNo int, InvCode string, QtyReq bigint, QtyFacReceive bigint", ("A", 1, "s", 3, 6))
    job = table(spark, "JobNumber string, OrderNumber string, OrderItemNo int", ("J", "A", 1))
    lines = table(spark, "OrderNumber string, InvCode string, FactDueDate date", ("A", "s", date(2022, 6, 1)), ("A", "s", date(2022, 6, 9)))
    inv = table(spark, "InvCode string, InvGroupCode string", ("s", "02"))
    heads = table(spark, "Bill_ID int, OrderNumber string, ReceiveDate date", (1, "A", date(2022, 6, 8)))
    detail = table(spark, "Bill_ID int, JobNumber string", (1, "J"))
    got = wip.material_lateness_jobs(item, product, job, lines, inv, heads, detail, AS_OF).first()
    assert (got.total_req, got.is_finish, got.fact_due, got.late_days) == (6, 1, date(2022, 6, 9), 1)


def test_material_status_ladder(spark):
    status = table(
        spark,
        "OrderNumber string, MP_ItemNo int, InvCode string, SupplierCode int, QtyReq bigint, QtyPurchase bigint, QtyPcReceive bigint, QtyToFact bigint, SupDueDate date",
        ("A", 1, "x", 1, 5, 5, 0, 5, None),
        ("A", 2, "x", 1, 5, 0, 0, 1, date(2000, 1, 1)),
        ("A", 3, "x", 1, 5, 5, 0, 1, None),
        ("A", 4, "x", 1, 5, 5, 0, 1, date(2022, 6, 14)),
        ("A", 5, "x", 1, 5, 5, 0, 1, date(2022, 6, 16)),
        ("A", 6, "x", 1, 5, 5, 0, 1, AS_OF),
        ("A", 7, "x", 2, 5, 5, 0, 1, AS_OF),
    )
    supplier = table(spark, "SupplierCode int, SupplierName string", (1, "S"))
    got = materials.material_status_order(status, supplier, AS_OF)
    assert rows(got, "line_no", "status") == [
        (1, L.STONE_COMPLETE), (2, L.STONE_ORDERED), (3, L.STONE_NO_DATE), (4, L.STONE_LATE), (5, L.STONE_NORMAL), (6, None),
    ]


def test_items_by_material_status_ladder(spark):
    product = table(
        spark, "OrderNumber string, OrderItemNo int, InvCode string, QtyReq bigint, QtyFacReceive bigint",
        *[("A", n, f"m{n}", 2, 10 if n == 1 else 0) for n in range(1, 7)],
    )
    inv = table(spark, "InvCode string, InvGroupCode string", *[(f"m{n}", "02") for n in range(1, 7)])
    detail = table(spark, "OrderNumber string, ItemNo int, Qty bigint", *[("A", n, 5) for n in range(1, 7)])
    status = table(
        spark, "OrderNumber string, InvCode string, FactDueDate date, SupDueDate date, QtyPurchase bigint",
        ("A", "m3", date(2022, 7, 1), date(2010, 1, 1), 5),
        ("A", "m4", date(2022, 7, 1), date(2022, 7, 1), 5),
        ("A", "m5", date(2022, 6, 1), date(2022, 6, 1), 5),
        ("A", "m6", date(2022, 6, 1), date(2017, 6, 1), 5),
    )
    want = {1: L.STONE_COMPLETE, 2: L.STONE_NOT_ORDERED, 3: L.STONE_ORDERED, 4: L.STONE_NORMAL, 5: L.STONE_LATE, 6: ""}
    for item, name in want.items():
        got = materials.items_by_material_status(product, inv, detail, status, AS_OF, [name, None])
        assert rows(got, "item_no") == [(item,)], name


def test_product_price(spark):
    cost = {c: float(i) for i, c in enumerate(orders.COST_COLUMNS)}
    schema = "ProductID string, ProductCode string, ProductDesc string, NewPict string, NetWeightCal double, " + ", ".join(f"{c} double" for c in cost)
    product = table(spark, schema, ("p", "P", "ring", "D:\\a.jpg", 2.0, *cost.values()), ("q", "Q", "bare", None, 1.0, *cost.values()))
    detail = table(
        spark, "ProductID string, InvCode string, Qty double, SettingTypeCode string",
        ("p", "q1", 3.0, "s"), ("p", "w1", 2.0, "t"), ("p", "n1", 9.0, "s"),
    )
    inv = table(
        spark, "InvCode string, InvGroupCode string, PriceType string, WgUnit double, StoneShapeCode string, StoneSizeCode string",
        ("q1", "02", "Q", 9.0, "r", "1"), ("w1", "07", "W", 0.5, "r", "1"), ("n1", "02", "", 1.0, "r", "1"),
    )
    prices = table(spark, "InvCode string, StdPrice double, StdPrice2 double", ("q1", 10.0, 20.0), ("w1", 4.0, 8.0))
    setting = table(spark, "StoneShapeCode string, StoneSizeCode string, SettingTypeCode string, Cost double", ("r", "1", "s", 1.5))
    price = lambda **k: {r.product_id: r for r in orders.product_price(product, detail, inv, prices, setting, 30.0, **k).collect()}
    base = price()
    assert (base["p"].total_silver, base["p"].total_material) == (60.0, 3 * 10.0 + 2 * 0.5 * 4.0)
    assert base["p"].total_labour == sum(cost.values()) + (3 + 9) * 1.5
    assert (base["q"].total_material, base["q"].total_labour) == (0.0, sum(cost.values()))
    marked = price(price_tier="2", silver_markup=2.0, total_markup=1.5)["p"]
    assert marked.total_material == 68.0
    assert marked.total_price == (120.0 + 68.0 + base["p"].total_labour) * 1.5


def test_worker_weight_guards_zero(spark):
    bill = table(spark, "Bill_ID int, BillNumber string, BillDate date, Receiver int", (1, "W1", AS_OF, 7))
    material = table(spark, "Bill_ID int, InvCode string, MatTotalWeight bigint")
    detail = table(spark, "Bill_ID int, ItemNo int, JobNumber string, SendQty bigint, SendWeight bigint", (1, 1, "J", 4, 0), (1, 2, "J", 4, 10))
    back = table(spark, "Bill_ID int, ItemNo int, RvTotalWeight bigint", (1, 1, 0), (1, 2, 4), (1, 2, 4))
    jobs = table(spark, "JobNumber string, OrderNumber string, ProductID string", ("J", "A", "p"))
    people = table(spark, "EmpCode int, EmpFullName string", (7, "Seven"))
    got = orders.worker_weight(bill, material, detail, back, jobs, people, AS_OF, AS_OF)
    assert rows(got, "item_no", "inv_code", "qty_per_weight", "return_weight", "loss_percent") == [(1, "-", 0.0, 0, None), (2, "-", 0.4, 8, 25.0)]


def test_casting_status(spark):
    jobs = table(spark, "JobNumber string, OrderNumber string, JobQty bigint", ("Ja", "A", 1), ("Jb", "B", 1), ("Jc", "C", 1))
    master = table(spark, "OrderNumber string, OrderDate date, ProductionTeam string, Status string", *[(o, AS_OF, "1", "2") for o in "ABC"])
    cast = table(spark, "OrderNumber string, JobNumber string, OutputType string, Qty bigint", ("A", "Ja", "1", 5), ("A", "Ja", "4", 2), ("A", "Jz", "1", 99))
    repair = table(spark, "OrderNumber string, JobNumber string, SendQty bigint, ReturnQty bigint", ("B", "Jb", 5, 4), ("C", "Jc", 5, 5))
    got = orders.casting_repair_order(jobs, master, cast, repair, AS_OF, AS_OF)
    assert rows(got, "order_number", "cast_normal", "cast_sample", "status") == [
        ("A", 5, 2, L.CAST_NONE), ("B", 0, 0, L.CAST_PARTIAL), ("C", 0, 0, L.CAST_COMPLETE),
    ]


def test_factory_to_qa_counts_an_order_once_per_day(spark):
    keyed = table(spark, "OrderNumber string, ProductionTeam string, CusStatus string", ("A", "1", "3"))
    detail = table(spark, "OrderNumber string, Qty bigint", ("A", 10), ("A", 5))
    heads = table(
        spark, "qaBill_ID int, OrderNumber string, billDate timestamp_ntz",
        (1, "A", datetime(2022, 6, 1, 8)), (2, "A", datetime(2022, 6, 1, 20)), (3, "A", datetime(2022, 6, 2)), (4, "A", datetime(2022, 7, 2)),
    )
    lines = table(spark, "qaBill_ID int, Qty bigint", (1, 1), (2, 2), (3, 4), (4, 8))
    done = table(spark, "qaFinish_ID int, OrderNumber string, finishDate timestamp_ntz", (9, "A", datetime(2022, 6, 2)))
    done_lines = table(spark, "qaFinish_ID int, Qty bigint", (9, 6))
    got = quality.factory_to_qa(keyed, detail, heads, lines, done, done_lines, date(2022, 6, 1), date(2022, 6, 30))
    part = lambda name: got.where(F.col("part") == name)
    assert rows(part("daily"), "day", "qty") == [(date(2022, 6, 1), 3), (date(2022, 6, 2), 4)]
    assert rows(part("orders"), "qty", "total_qty") == [(7, 15)]
    assert rows(part("line_chart"), "day", "total_qty") == [(date(2022, 6, 1), 15), (date(2022, 6, 2), 15)]
    assert rows(part("passed"), "sales_team", "qty") == [("1", 6)]


def test_targets_include_the_due_day(spark):
    due = table(
        spark, "OrderNumber string, HistoryNo int, DueDate date, Qty bigint",
        ("A", 1, date(2022, 6, 1), 9), ("A", 2, date(2022, 6, 2), 4), ("A", 2, date(2022, 6, 4), 6), ("A", 2, date(2022, 6, 3), 0),
    )
    heads = table(spark, "qaBill_ID int, OrderNumber string, billDate timestamp_ntz", (1, "A", datetime(2022, 6, 2, 23, 59)), (2, "A", datetime(2022, 6, 3)))
    lines = table(spark, "qaBill_ID int, Qty bigint", (1, 3), (2, 2))
    got = quality.promised_targets(due, heads, lines)
    assert rows(got, "due_date", "qty", "qty_bill", "current_qty") == [(date(2022, 6, 2), 4, 3, 4), (date(2022, 6, 4), 6, 5, 10)]


def test_repair_keys_order_and_rule(spark):
    keyed = table(spark, "OrderNumber string", ("A",))
    at = lambda n: datetime(2022, 6, n)
    heads = table(
        spark, "qaRepair_ID int, OrderNumber string, repairDate timestamp_ntz, qaRepairStatus string",
        (1, "A", at(5), "1"), (2, "A", at(1), "2"), (3, "A", at(9), ""), (4, "A", at(5), "3"), (5, "B", at(5), ""), (6, "A", at(1), "1"),
    )
    lines = table(spark, "qaRepair_ID int, Qty bigint, RepairFinish bigint", *[(n, 2, 2 if n == 4 else 1) for n in range(1, 7)])
    got = quality.repair_keys(keyed, heads, lines, date(2022, 6, 4), date(2022, 6, 6))
    assert [r[0] for r in got.collect()] == [3, 2, 1]


def test_reason_catalogue(spark):
    types = table(spark, "type_ID int, repairType string", (1, "polish"), (2, "stone"))
    details = table(spark, "type_ID int, reason_No int, reasonType string", (1, 2, "dull"), (1, 1, "scratch"))
    got = {r.type_ID: [e.reasonType for e in r.reasons] for r in quality.reason_catalogue(types, details).collect()}
    assert got == {1: ["scratch", "dull"], 2: []}


def test_mould_loans_open_stay(spark):
    loans = table(
        spark,
        "ID int, ModelNo string, Qty int, JobType int, DepartCode int, Status string, Owner int, Receiver int, ReturnPerson int, PreparePerson int, BillDate date, PrepareDate date, DueDate date, ReceiveDate date, ReturnDate date",
        (1, "M1", 1, 1, 1, "01", 1, 1, 1, 1, date(2022, 1, 1), None, date(2022, 6, 10), None, None),
        (2, "M1", 1, 1, 1, "04", 1, 1, 1, 1, date(2022, 5, 1), None, None, None, date(2022, 5, 20)),
        (3, "M1", 1, 1, 1, "04", 1, 1, 1, 1, date(2022, 5, 1), None, None, None, date(2022, 5, 16)),
    )
    people = table(spark, "EmpCode int, EmpFName string, EmpFullName string, NickName string", (1, "A", "A B", "a"))
    jobs, departments = table(spark, "JobType int, JobTypeName string", (1, "cast")), table(spark, "DepartCode int, DepartName string", (1, "lab"))
    got = upkeep.mould_loans(loans, people, jobs, departments, AS_OF)
    assert rows(got, "loan_id", "total_days", "late_days", "return_weekday") == [(1, 165, -5, ""), (2, 19, 0, L.WEEKDAYS[6])]


def test_purchase_items_and_stock(spark):
    detail = table(spark, "Purchase_Bill_ID int, ITEM_NO int, ITEM_ID int, Remark string", (1, 1, 1, "glue"), (1, 2, 2, ""), (1, 4, 2, ""))
    stock = table(spark, "ITEM_ID int, ITEM_NAME string, INV_TYPE_ID int, UNIT_ID int, PRICE int", (1, L.FREE_TEXT_ITEM, 0, 1, 1), (2, "pen", 3, 1, 1), (3, "ink", 4, 1, 1))
    assert rows(upkeep.purchase_first_items(detail, stock), "item_no", "item_name") == [(1, f"glue ({L.FREE_TEXT_ITEM})"), (2, "pen")]
    types = table(spark, "INV_TYPE_ID int, INV_TYPE_NAME string", (0, "any"), (3, "office"), (4, "lab"))
    units = table(spark, "UNIT_ID int, UNIT_NAME string", (1, "piece"))
    assert rows(upkeep.purchase_inventory(stock, types, units, [3]), "item_id") == [(1,), (2,)]


def test_documents_nest_everything(spark):
    master = table(spark, "order_number string, total_qty bigint", ("A", 10), ("B", 5))
    calendar = table(
        spark, "order_number string, day date, dow int, to_qa bigint, first_target bigint, last_target bigint, balance bigint, total_to_qa bigint",
        ("A", date(2022, 6, 2), 5, 3, 0, 0, 5, 5), ("A", date(2022, 6, 1), 4, 2, 0, 0, 8, 5),
    )
    targets = table(spark, "order_number string, postponements bigint, first_target date, last_target date", ("A", 1, date(2022, 6, 1), None))
    months = table(spark, "order_number string, month_no int, month string, days bigint", ("A", 6, "x", 2))
    processes = table(spark, "order_number string, process_code string, process_name string, in_process bigint", ("A", "02", "cast", 1))
    materials_of = table(spark, "order_number string, is_finish int, fact_due date", ("A", 1, date(2022, 6, 3)))
    got = {r.order_number: r for r in wip.order_document(master, calendar, targets, months, processes, materials_of).collect()}
    assert [e.balance for e in got["A"].calendar] == [8, 5]
    assert (got["A"].total_to_qa, got["A"].material_state.is_finish, got["A"].postponements) == (5, 1, 1)
    assert (got["B"].calendar, got["B"].processes, got["B"].total_to_qa, got["B"].material_state.is_finish) == ([], [], 0, 0)


def bill_tables(spark):
    """Two rows of one order item, of one product, of one person and of one bill line; items and keys that are NULL; bills without lines."""
    day = datetime(2022, 6, 10, 9)
    master = table(
        spark, "OrderNumber string, CusCode string, ProductionTeam string, DueDate date, FactoryDue date",
        ("CH-1", "c1", "1", date(2022, 6, 20), date(2022, 6, 18)), ("CH-2", "nobody", "2", date(2022, 6, 10), None),
    )
    customer = table(spark, "CusCode string, CusStatus string", ("c1", "1"))
    detail = table(spark, "OrderNumber string, ItemNo int", ("CH-1", 1), ("CH-1", 1), ("CH-1", 2), ("CH-2", None), (None, 1))
    product = table(spark, "ProductID string, ProductCode string, NewPict string", ("p", "P1", "D:\\a.jpg"), ("q", "Q1", None), ("q", "Q2", None), (None, "N", None))
    employee = table(spark, "EmpCode int, EmpFName string, NickName string", (7, "Ann", "A"), (8, "Bea", None), (9, "Cy", "C"), (9, "Cy", "D"))
    heads = table(
        spark,
        "qaBill_ID int, qaDocNumber string, billDate timestamp_ntz, OrderNumber string, qaBillStatus string, SenderNew int, ReceiverNew int, receiveDate timestamp_ntz",
        (1, "B1", day, "CH-1", "", 7, None, None), (2, "B2", day, "CH-2", "1", 8, 7, day), (3, "B3", day, "CH-1", "3", 7, 7, None),
        (4, "B4", day, "CH-9", "1", 7, 7, None), (None, "B5", day, "CH-1", "1", 7, 7, None),
    )
    lines = table(
        spark,
        "qaBill_ID int, bill_Item int, OrderNumber string, OrderItemNo int, ProductID string, Qty bigint, QCPerson int, qaJobNumber string",
        (1, 1, "CH-1", 1, "p", 5, 7, "J1"), (1, 2, "CH-1", 2, "q", 6, None, "J2"), (1, 2, "CH-1", 2, "q", 6, None, "J2"),
        (1, 3, "CH-1", 3, "gone", 9, 7, "J3"), (1, None, "CH-1", 9, "p", 2, 7, None), (2, 1, None, None, "p", 4, 9, "J1"),
        (2, 4, "CH-2", None, None, 1, 7, ""), (4, 1, "CH-1", 1, "p", 1, 7, "J4"), (None, 1, "CH-1", 1, "p", 1, 7, "J5"),
    )
    finish = table(spark, "qaFinish_ID int, qaBill_ID int", (10, 1), (11, 1), (12, 3), (13, None), (14, 9))
    finished = table(
        spark, "qaFinish_ID int, bill_Item int, Qty bigint",
        (10, 1, 2), (11, 1, 1), (11, 8, 4), (10, None, 7), (12, 1, 3), (13, 1, 1), (14, 1, 1), (10, 2, None),
    )
    repair = table(spark, "qaRepair_ID int, qaBill_ID int, qaRepairStatus string", (20, 1, ""), (21, 1, "2"), (22, 2, None), (23, 3, "1"))
    repaired = table(
        spark, "qaRepair_ID int, bill_Item int, Qty bigint, RepairFinish bigint",
        (20, 1, 1, 1), (21, 1, 2, 1), (21, 2, 3, None), (22, 1, 9, 9), (23, 5, 4, 2), (21, None, 5, 5),
    )
    return master, customer, detail, product, employee, heads, lines, finish, finished, repair, repaired


@pytest.mark.parametrize("most", [False, True])
def test_bills_with_repeated_unknown_and_missing_rows(spark, most):
    keys = table(spark, "qaBill_ID int", *[(n,) for n in (1, 1, 2, 3, 4, 5, None)])
    got = quality.qa_bills(keys, *bill_tables(spark), AS_OF, unfinished_only=False, focus_job="J1", most=most)
    assert rows(got, "bill_id", "sales_team", "total_qty", "total_finish", "total_repair", "total_repair_finish", "sender_name", "late_due") == [
        (1, "1", 28, 14, 10, 6, "Ann (A)", 5), (2, None, 5, 0, 0, 0, None, -5), (3, "1", 0, 3, 4, 2, "Ann (A)", 5),
    ]
    assert got.columns[:2] == ["bill_id", "doc_number"] and got.columns[-1] == "items"
    items = {r.bill_id: [(i.bill_item, i.product_code, i.qty, i.qty_in_repair, i.qty_repair_finish, i.qty_repair_wait, i.qty_pass, i.focus) for i in r["items"]] for r in got.collect()}
    once = [(1, "P1", 5, 2, 1, 1, 3, 1)]
    assert items == {
        1: [(None, None, 2, 0, 0, 0, 0, 0), *once * 2, *[(2, c, 6, 3, 0, 0, 0, 0) for c in ("Q1", "Q1", "Q2", "Q2")]],
        2: [(1, None, 4, 0, 0, 0, 0, 1)] * 2,
        3: [],
    }
    named = got.where("bill_id = 1").selectExpr("inline(items)")
    assert rows(named.where("bill_item = 1").select("item_no", "qa_job_number", "qc_person")) == [(1, "J1", "Ann (A)")] * 2
    some = quality.qa_bills(keys.where("qaBill_ID = 3"), *bill_tables(spark), AS_OF, unfinished_only=False, most=most)
    assert [r.bill_id for r in some.collect()] == [3]
    unfinished = quality.qa_bills(keys, *bill_tables(spark), AS_OF, most=most)
    assert sorted(r.bill_id for r in unfinished.collect()) == [1, 2]
