"""Maintenance, loan, purchase-request, staff and news reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from loupewright.catalog.registry import AS_OF, D, METER_NOW, NOW, case_sql, query
from loupewright.functions import labels as L
from loupewright.plans import upkeep as U

_URL = "'https://pictures.example/' || replace(replace(substring({c}, 4), chr(92), '/'), '#', '%23')"
_PERSON = "{e}.EmpFName || ' (' || {e}.NickName || ')'"
_DOW = "dayofweek({}) + 1"
_PLACES = """{how} join $job_type jt on d.JobTypeCode = jt.JobTypeCode
    {how} join $category g on d.JobTypeCode = g.JobTypeCode and d.CategoryCode = g.CategoryCode
    left join $floor f on d.FloorCode = f.FloorCode left join $room r on d.FloorCode = r.FloorCode and d.RoomCode = r.RoomCode"""
_PEOPLE = """left join $employee ec on d.ContactPerson = ec.EmpCode left join $employee ea on d.Approver = ea.EmpCode
    left join $employee en on d.Notifier = en.EmpCode"""


def _place_tables(t):
    return (t.job_type, t.category, t.floor, t.room)


def _documents(where: str) -> str:
    return f"""select d.BillID as bill_id, jt.JobTypeName as job_type, g.CategoryName as category, f.FloorName as floor,
      r.RoomName as room, case when d.DeviceNo = 'null' then '' else d.DeviceNo end as device_no,
      {_PERSON.format(e="ec")} as contact_name, {_URL.format(c="ec.EmpPict")} as contact_picture,
      ea.EmpFullName as approver_name, {_URL.format(c="ea.EmpPict")} as approver_picture,
      {_PERSON.format(e="en")} as notifier_name, {_URL.format(c="en.EmpPict")} as notifier_picture,
      d.BrokenDes || case when d.RepairBillNo = '' then '' else '{L.DEPARTMENT_BILL}' ||
        (select p.PDProcessName from $pd_process p where p.PDProcessCode = substring(d.RepairBillNo, 2, 2)) || ')' end as broken,
      d.RepairBillNo as repair_bill_no, d.Status as status, d.PartPrice as part_price, d.RepairPrice as repair_price,
      d.JobDate - interval 7 hour as job_date, d.DueDate as due_date, d.FinishDate as finish_date,
      date_diff('day', {D}, case when year(d.DueDate) >= 2564 then cast(d.DueDate - interval 543 year as date) else d.DueDate end) as days_left,
      date_diff('day', cast(d.JobDate as date), d.FinishDate) as days_worked
    from $repair_document d {_PLACES.format(how="")} {_PEOPLE} where {where}"""


def _document_report(t, *dates, **more):
    return U.repair_documents(t.repair_document, *_place_tables(t), t.employee, t.pd_process, AS_OF, *dates, **more)


@query(
    "rpt_repair_documents",
    _documents("""(cast(d.JobDate as date) between date '1998-01-01' and date '1998-06-30' or d.Status in ('0', '1', '2'))
      and d.JobTypeCode in ('01', '02', '03') and d.Status in ('0', '1', '2', '3')"""),
)
def repair_documents(t):
    return _document_report(
        t, date(1998, 1, 1), date(1998, 6, 30), job_types=["01", "02", "03"], statuses=["0", "1", "2", "3", None]
    )


@query("rpt_repair_documents_all", _documents("true"))
def repair_documents_all(t):
    return _document_report(t)


@query(
    "rpt_repair_documents_history",
    f"""select d.DeviceNo as device_no, d.BillID as bill_id, jt.JobTypeName as job_type, g.CategoryName as category,
      f.FloorName as floor, r.RoomName as room, ec.EmpFullName as contact_name, ea.EmpFullName as approver_name,
      en.EmpFullName as notifier_name, d.BrokenDes as broken, cast(d.JobDate as date) as job_date, d.DueDate as due_date,
      d.FinishDate as finish_date, {case_sql(_DOW.format("cast(d.JobDate as date)"), L.WEEKDAYS)} as job_weekday,
      {case_sql(_DOW.format("d.DueDate"), L.WEEKDAYS)} as due_weekday, {case_sql(_DOW.format("d.FinishDate"), L.WEEKDAYS)} as finish_weekday
    from $repair_document d {_PLACES.format(how="left")} {_PEOPLE} where d.Status = '3'""",
)
def device_history(t):
    return U.device_history(t.repair_document, *_place_tables(t), t.employee)


@query(
    "rpt_repair_counts",
    """select count(case when Status = '0' then 1 end) as requested, count(case when Status = '1' then 1 end) as confirmed,
      count(case when Status = '2' then 1 end) as waiting_part, count(case when Status = '3' then 1 end) as finished
    from $repair_document where year(JobDate) = 1998 and JobTypeCode in ('01', '02')""",
)
def repair_counts(t):
    return U.repair_counts(t.repair_document, 1998, ["01", "02"])


@query(
    "rpt_repair_months",
    f"""select cast(m as int) as month, {case_sql("m", L.MONTHS, None)} as month_name,
      (select count(*) from $repair_document d where year(d.JobDate) = 1998 and month(d.JobDate) = m and d.JobTypeCode = '01') as it_qty,
      (select count(*) from $repair_document d where year(d.JobDate) = 1998 and month(d.JobDate) = m and d.JobTypeCode = '02') as ma_qty
    from generate_series(1, 12) g(m)""",
)
def repair_months(t):
    return U.repair_months(t.repair_document, 1998, {"01": "it_qty", "02": "ma_qty"})


@query(
    "rpt_devices",
    f"""select d.ID as device_id, d.DeviceNo as device_no, jt.JobTypeName as job_type, g.CategoryName as category,
      f.FloorName as floor, r.RoomName as room, d.Status1 as status, d.Owner as owner
    from $device d {_PLACES.format(how="")}""",
)
def devices(t):
    return U.devices(t.device, *_place_tables(t))


@query(
    "rpt_devices_repairs",
    """select v.ID as device_id, d.BillID as bill_id, d.DeviceNo as device_no, d.JobDate as job_date,
      e.EmpFullName as contact_name, d.DueDate as due_date, d.BrokenDes as broken, d.RepairPrice as repair_price,
      d.PartPrice as part_price, d.Status as status, case v.Status1 when '0' then 'in use' when '1' then 'stored' end as device_status
    from $device v join $repair_document d on v.JobTypeCode = d.JobTypeCode and v.DeviceNo = d.DeviceNo
    left join $employee e on d.ContactPerson = e.EmpCode""",
)
def device_repairs(t):
    return U.device_repairs(t.device, t.repair_document, t.employee, {"0": "in use", "1": "stored"})


@query(
    "rpt_devices_filter",
    """select JobTypeCode as job_type_code, CategoryCode as category_code, FloorCode as floor_code, RoomCode as room_code,
      DeviceNo as device_no from $device where Status1 = '0'""",
)
def device_filter(t):
    return U.device_filter(t.device)


def _loans(where: str) -> str:
    dates = {"bill": "BillDate", "prepare": "PrepareDate", "due": "DueDate", "receive": "ReceiveDate", "return": "ReturnDate"}
    columns = ", ".join(
        f"d.{c} as {n}_date, {case_sql(_DOW.format(f'd.{c}'), L.WEEKDAYS)} as {n}_weekday" for n, c in dates.items()
    )
    until = f"case when d.ReturnDate is null then {D} else d.ReturnDate end"
    return f"""select d.ID as loan_id, d.ModelNo as model_no, d.Qty as qty, j.JobTypeName as job_type, a.DepartName as department,
      d.Status as status, {_PERSON.format(e="eo")} as owner_name, er.EmpFullName as receiver_name, et.EmpFullName as returner_name,
      ep.EmpFullName as preparer_name, {columns}, date_diff('day', d.BillDate, {until}) as total_days,
      coalesce(date_diff('day', {until}, d.DueDate), 0) as late_days
    from $mould_loan d left join $employee eo on d.Owner = eo.EmpCode left join $loan_job_type j on d.JobType = j.JobType
    left join $employee er on d.Receiver = er.EmpCode left join $employee et on d.ReturnPerson = et.EmpCode
    left join $employee ep on d.PreparePerson = ep.EmpCode left join $loan_department a on d.DepartCode = a.DepartCode
    where {where}"""


@query("rpt_mould_loans", _loans(f"coalesce(d.ReturnDate, {D}) > {D} - 30"))
def mould_loans(t):
    return U.mould_loans(t.mould_loan, t.employee, t.loan_job_type, t.loan_department, AS_OF)


@query("rpt_mould_loans_completed", _loans("d.Status = '04'"))
def mould_loans_completed(t):
    return U.mould_loans(
        t.mould_loan, t.employee, t.loan_job_type, t.loan_department, AS_OF, days=None, status=U.LOAN_RETURNED
    )


@query(
    "rpt_models",
    f"""select order_number, model_no, {_URL.format(c="path")} as picture, cast(null as int) as checkbox, 0 as qty, '' as job_type, '' as remark
    from (select distinct d.OrderNumber as order_number, p.CastingNo as model_no,
        (select m.ModelPicture from $model_picture m where m.ModelNumber = p.CastingNo) as path
      from $order_detail d join $product_master p on d.ProductID = p.ProductID where p.CastingNo <> '') a""",
)
def models(t):
    return U.models_of_orders(t.order_detail, t.product_master, t.model_picture)


@query("rpt_models_all", f"""select ModelNumber as model_no, {_URL.format(c="ModelPicture")} as picture from $model_picture""")
def models_all(t):
    return U.all_models(t.model_picture)


@query(
    "rpt_purchase_requests",
    f"""select b.Purchase_Bill_ID as bill_id, b.Purchase_Bill_Doc as doc_number, e.EmpFullName as request_name,
      e.NickName as request_nick, {_URL.format(c="e.EmpPict")} as request_picture, s.SectionName as section,
      p.position_name as position, cast(b.Bill_Date as date) as bill_date, b.Status_Code as status, i.EmpFullName as inspector_name,
      case when i.EmpPict is null or i.EmpPict = '' then 'https://pictures.example/avatar.png'
        else {_URL.format(c="i.EmpPict")} end as inspector_picture
    from $purchase_bill b join $position p on b.Section_Code = p.section_code and b.Position_Code = p.position_code
    join $section s on b.Section_Code = s.SectionCode join $employee e on b.Request_ID = e.EmpCode
    left join $employee i on b.Inspactor_ID = i.EmpCode
    where year(b.Bill_Date) > 1995 and coalesce(b.Receive_Date, {D}) > {D} - 30""",
)
def purchase_requests(t):
    return U.purchase_requests(t.purchase_bill, t.position, t.section, t.employee, AS_OF, 1995)


@query(
    "rpt_purchase_requests_header",
    """select b.Purchase_Bill_ID as bill_id, b.Purchase_Bill_Doc as doc_number, b.Request_ID as request_id,
      b.Inspactor_ID as inspector_id, b.Status_Code as status, p.position_name as position
    from $purchase_bill b join $position p on b.Section_Code = p.section_code and b.Position_Code = p.position_code""",
)
def purchase_header(t):
    return U.purchase_header(t.purchase_bill, t.position)


@query(
    "rpt_purchase_requests_first_items",
    f"""select d.Purchase_Bill_ID as bill_id, d.ITEM_NO as item_no,
      case when i.ITEM_NAME = '{L.FREE_TEXT_ITEM}' then d.Remark || ' ({L.FREE_TEXT_ITEM})' else i.ITEM_NAME end as item_name
    from $purchase_bill_detail d join $inventory_new i on d.ITEM_ID = i.ITEM_ID where d.ITEM_NO <= 3""",
)
def purchase_first_items(t):
    return U.purchase_first_items(t.purchase_bill_detail, t.inventory_new)


@query(
    "rpt_purchase_requests_lines",
    """select d.Purchase_Bill_ID as bill_id, d.ITEM_NO as item_no, d.ITEM_ID as item_id, i.ITEM_NAME as item_name,
      d.ITEM_Qty as qty, u.UNIT_NAME as unit, i.PRICE * d.ITEM_Qty as price, d.Remark as remark
    from $purchase_bill_detail d join $inventory_new i on d.ITEM_ID = i.ITEM_ID join $item_unit u on d.ITEM_UNIT_ID = u.UNIT_ID""",
)
def purchase_lines(t):
    return U.purchase_lines(t.purchase_bill_detail, t.inventory_new, t.item_unit)


@query(
    "rpt_purchase_requests_inventory",
    """select i.INV_TYPE_ID as type_id, y.INV_TYPE_NAME as type_name, i.ITEM_ID as item_id, i.ITEM_NAME as item_name,
      u.UNIT_NAME as unit, i.PRICE as price
    from $inventory_new i join $item_type y on i.INV_TYPE_ID = y.INV_TYPE_ID join $item_unit u on i.UNIT_ID = u.UNIT_ID""",
)
def purchase_inventory(t):
    return U.purchase_inventory(t.inventory_new, t.item_type, t.item_unit)


@query(
    "rpt_purchase_requests_waiting",
    """select Request_ID as request_id, count(*) as waiting from $purchase_bill where Status_Code = '4' group by 1""",
)
def purchase_waiting(t):
    return U.purchase_waiting(t.purchase_bill)


@query(
    "rpt_staff",
    f"""select e.EmpCode as code, e.EmpFullName as full_name, {_PERSON.format(e="e")} as display_name,
      d.DepartmentName as department, p.PositionName as position, {_URL.format(c="e.EmpPict")} as picture
    from $employee e left join $department d on e.DepartmentCode = d.DepartmentCode
    left join $staff_position p on e.PositionCode = p.PositionCode""",
)
def staff(t):
    return U.staff(t.employee, t.department, t.staff_position)


_NEWS = {
    "news": """select event_id as ID, concat(event_type, ' ', cast(event_id as string)) as postHeader, ts as postDate,
      user_id % 120 as postOwner, case when event_type = 'error' then '1' else '0' end as postStatus from $events"""
}


@query(
    "rpt_news",
    f"""select n.ID as post_id, n.postHeader as header, n.postDate as post_date, n.postStatus as status, e.EmpFullName as owner_name
    from $news n left join $employee e on n.postOwner = e.EmpCode
    where n.postDate > {NOW} - interval 12 day and n.postStatus = '0'""",
    _NEWS,
)
def news(t):
    posts = t.events.select(
        F.col("event_id").alias("ID"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("postHeader"),
        F.col("ts").alias("postDate"),
        (F.col("user_id") % 120).alias("postOwner"),
        F.when(F.col("event_type") == "error", "1").otherwise("0").alias("postStatus"),
    )
    return U.news(posts, t.employee, METER_NOW, days=12)


@query(
    "rpt_categories",
    r"""select JobTypeCode as job_type_code, CategoryCode as category_code, CategoryName as category,
      cast(regexp_extract(CategoryCode, '^.(\d+)', 1) as bigint) as sort_no from $category""",
)
def categories(t):
    return U.categories(t.category)
