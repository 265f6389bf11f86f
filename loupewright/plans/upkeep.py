"""Maintenance requests, devices, mould loans, purchase requests, staff and news."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupewright.functions import labels as L
from loupewright.functions.dates import days_until, gregorian, shift_hours
from loupewright.functions.text import DEFAULT_PICTURE, display_name, picture_url
from loupewright.operators.aggregates import count_by_status, month_counts
from loupewright.operators.filters import date_between, in_padded, open_or_between, recent, year_cmp
from loupewright.operators.joins import lookup_first, role_join
from loupewright.operators.sorting import numeric_suffix

# Document states.
OPEN_REQUESTS = ("0", "1", "2")
REQUEST_DONE = "3"
LOAN_RETURNED = "04"
READY_TO_COLLECT = "4"
CLOCK_SHIFT = -7
NO_DEVICE = "null"


def _person() -> Column:
    return display_name(F.col("EmpFName"), F.col("NickName"))


def _places(documents: DataFrame, job_type: DataFrame, category: DataFrame, floor: DataFrame, room: DataFrame, how: str) -> DataFrame:
    """Add the names of job type, category, floor and room."""
    return (
        documents.join(job_type, "JobTypeCode", how)
        .join(category, ["JobTypeCode", "CategoryCode"], how)
        .join(floor, "FloorCode", "left")
        .join(room, ["FloorCode", "RoomCode"], "left")
    )


def repair_documents(
    documents: DataFrame,
    job_type: DataFrame,
    category: DataFrame,
    floor: DataFrame,
    room: DataFrame,
    employee: DataFrame,
    pd_process: DataFrame,
    as_of: date,
    job_from: date | None = None,
    job_to: date | None = None,
    job_types: Sequence | None = None,
    statuses: Sequence | None = None,
) -> DataFrame:
    """Maintenance requests in a date range or still open, with places, people and days left."""
    rows = documents
    if job_from is not None:
        in_range = date_between(F.col("JobDate"), job_from, job_to)
        rows = rows.where(open_or_between(in_range, F.col("Status"), OPEN_REQUESTS))
    if job_types is not None:
        rows = rows.where(in_padded(F.col("JobTypeCode"), job_types))
    if statuses is not None:
        rows = rows.where(in_padded(F.col("Status"), statuses))
    rows = _places(rows, job_type, category, floor, room, "inner")
    picture = picture_url(F.col("EmpPict"))
    roles = {
        "contact": ("ContactPerson", {"contact_name": _person(), "contact_picture": picture}),
        "approver": ("Approver", {"approver_name": F.col("EmpFullName"), "approver_picture": picture}),
        "notifier": ("Notifier", {"notifier_name": _person(), "notifier_picture": picture}),
    }
    rows = role_join(rows, employee, "EmpCode", roles)
    rows = rows.withColumn("_process", F.substring("RepairBillNo", 2, 2))
    rows = role_join(rows, pd_process, "PDProcessCode", {"p": ("_process", {"_process_name": F.col("PDProcessName")})})
    suffix = F.when(F.col("RepairBillNo") == "", F.lit("")).otherwise(
        F.concat(F.lit(L.DEPARTMENT_BILL), F.col("_process_name"), F.lit(")"))
    )
    return rows.select(
        F.col("BillID").alias("bill_id"),
        F.col("JobTypeName").alias("job_type"),
        F.col("CategoryName").alias("category"),
        F.col("FloorName").alias("floor"),
        F.col("RoomName").alias("room"),
        F.when(F.col("DeviceNo") == NO_DEVICE, "").otherwise(F.col("DeviceNo")).alias("device_no"),
        *[f"{r}_{c}" for r in roles for c in ("name", "picture")],
        F.concat("BrokenDes", suffix).alias("broken"),
        F.col("RepairBillNo").alias("repair_bill_no"),
        F.col("Status").alias("status"),
        F.col("PartPrice").alias("part_price"),
        F.col("RepairPrice").alias("repair_price"),
        shift_hours(F.col("JobDate"), CLOCK_SHIFT).alias("job_date"),
        F.col("DueDate").alias("due_date"),
        F.col("FinishDate").alias("finish_date"),
        days_until(as_of, gregorian(F.col("DueDate"))).alias("days_left"),
        F.datediff(F.col("FinishDate"), F.to_date("JobDate")).alias("days_worked"),
    )


def device_history(
    documents: DataFrame, job_type: DataFrame, category: DataFrame, floor: DataFrame, room: DataFrame, employee: DataFrame,
    device_no: str | None = None,
) -> DataFrame:
    """Finished requests of one device, or of all devices."""
    rows = documents.where(F.col("Status") == REQUEST_DONE)
    if device_no is not None:
        rows = rows.where(F.col("DeviceNo") == device_no)
    rows = _places(rows, job_type, category, floor, room, "left")
    roles = {r: (c, {f"{r}_name": F.col("EmpFullName")}) for r, c in _REQUEST_PEOPLE.items()}
    days = {"job": F.to_date("JobDate"), "due": F.col("DueDate"), "finish": F.col("FinishDate")}
    return role_join(rows, employee, "EmpCode", roles).select(
        F.col("DeviceNo").alias("device_no"),
        F.col("BillID").alias("bill_id"),
        F.col("JobTypeName").alias("job_type"),
        F.col("CategoryName").alias("category"),
        F.col("FloorName").alias("floor"),
        F.col("RoomName").alias("room"),
        *[f"{r}_name" for r in roles],
        F.col("BrokenDes").alias("broken"),
        *[d.alias(f"{n}_date") for n, d in days.items()],
        *[L.weekday_label(d).alias(f"{n}_weekday") for n, d in days.items()],
    )


_REQUEST_PEOPLE = {"contact": "ContactPerson", "approver": "Approver", "notifier": "Notifier"}


def repair_counts(documents: DataFrame, year: int, job_types: Sequence[str]) -> DataFrame:
    """Requests of a year per status, in one row."""
    rows = documents.where(year_cmp(F.col("JobDate"), "=", year) & in_padded(F.col("JobTypeCode"), job_types))
    return count_by_status(rows, "Status", {"0": "requested", "1": "confirmed", "2": "waiting_part", "3": "finished"})


def repair_months(documents: DataFrame, year: int, types: Mapping[str, str]) -> DataFrame:
    """Requests per calendar month of a year, one column per job type, with the month name."""
    rows = documents.where(year_cmp(F.col("JobDate"), "=", year))
    counted = month_counts(rows, F.col("JobDate"), {n: F.col("JobTypeCode") == c for c, n in types.items()})
    return counted.withColumn("month_name", L.label(F.col("month"), L.MONTHS, None))


def devices(device: DataFrame, job_type: DataFrame, category: DataFrame, floor: DataFrame, room: DataFrame) -> DataFrame:
    """Device inventory with type, category and place."""
    return _places(device, job_type, category, floor, room, "inner").select(
        F.col("ID").alias("device_id"),
        F.col("DeviceNo").alias("device_no"),
        F.col("JobTypeName").alias("job_type"),
        F.col("CategoryName").alias("category"),
        F.col("FloorName").alias("floor"),
        F.col("RoomName").alias("room"),
        F.col("Status1").alias("status"),
        F.col("Owner").alias("owner"),
    )


def device_repairs(device: DataFrame, documents: DataFrame, employee: DataFrame, status_names: Mapping[str, str]) -> DataFrame:
    """Requests of each device."""
    keyed = device.select("ID", "JobTypeCode", "DeviceNo", "Status1")
    rows = documents.join(keyed, ["JobTypeCode", "DeviceNo"])
    roles = {"contact": ("ContactPerson", {"contact_name": F.col("EmpFullName")})}
    return role_join(rows, employee, "EmpCode", roles).select(
        F.col("ID").alias("device_id"),
        F.col("BillID").alias("bill_id"),
        F.col("DeviceNo").alias("device_no"),
        F.col("JobDate").alias("job_date"),
        "contact_name",
        F.col("DueDate").alias("due_date"),
        F.col("BrokenDes").alias("broken"),
        F.col("RepairPrice").alias("repair_price"),
        F.col("PartPrice").alias("part_price"),
        F.col("Status").alias("status"),
        L.label(F.col("Status1"), status_names, None).alias("device_status"),
    )


def device_filter(device: DataFrame) -> DataFrame:
    """Codes of the devices in use, for choosing one."""
    return device.where(F.col("Status1") == "0").select(
        *[F.col(c).alias(n) for c, n in _DEVICE_CODES.items()]
    )


_DEVICE_CODES = {
    "JobTypeCode": "job_type_code", "CategoryCode": "category_code", "FloorCode": "floor_code", "RoomCode": "room_code",
    "DeviceNo": "device_no",
}


def categories(category: DataFrame) -> DataFrame:
    """Categories by type and by the number in their code."""
    return category.select(
        F.col("JobTypeCode").alias("job_type_code"),
        F.col("CategoryCode").alias("category_code"),
        F.col("CategoryName").alias("category"),
        numeric_suffix(F.col("CategoryCode")).alias("sort_no"),
    ).orderBy("job_type_code", "sort_no")


def mould_loans(
    loans: DataFrame,
    employee: DataFrame,
    job_types: DataFrame,
    departments: DataFrame,
    as_of: date,
    days: int | None = 30,
    model: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Mould loans with people, days out and days late; open loans and those returned lately."""
    rows = loans
    if days is not None:
        rows = rows.where(recent(F.col("ReturnDate"), as_of, days))
    if model is not None:
        rows = rows.where(F.col("ModelNo") == model)
    if status is not None:
        rows = rows.where(F.col("Status") == status)
    full = F.col("EmpFullName")
    roles = {
        "owner": ("Owner", {"owner_name": _person()}),
        "receiver": ("Receiver", {"receiver_name": full}),
        "returner": ("ReturnPerson", {"returner_name": full}),
        "preparer": ("PreparePerson", {"preparer_name": full}),
    }
    rows = role_join(rows, employee, "EmpCode", roles).join(job_types, "JobType", "left").join(departments, "DepartCode", "left")
    until = F.coalesce(F.col("ReturnDate"), F.lit(as_of))
    dates = {"bill": "BillDate", "prepare": "PrepareDate", "due": "DueDate", "receive": "ReceiveDate", "return": "ReturnDate"}
    return rows.select(
        F.col("ID").alias("loan_id"),
        F.col("ModelNo").alias("model_no"),
        F.col("Qty").alias("qty"),
        F.col("JobTypeName").alias("job_type"),
        F.col("DepartName").alias("department"),
        F.col("Status").alias("status"),
        *[f"{r}_name" for r in roles],
        *[F.col(c).alias(f"{n}_date") for n, c in dates.items()],
        *[L.weekday_label(F.col(c)).alias(f"{n}_weekday") for n, c in dates.items()],
        F.datediff(until, F.col("BillDate")).alias("total_days"),
        F.coalesce(F.datediff(F.col("DueDate"), until), F.lit(0)).alias("late_days"),
    )


def models_of_orders(order_detail: DataFrame, product_master: DataFrame, model_picture: DataFrame) -> DataFrame:
    """Casting models of each order, once each, with placeholders for the loan form."""
    products = product_master.where(F.col("CastingNo") != "").select("ProductID", F.col("CastingNo").alias("model_no"))
    models = order_detail.select("OrderNumber", "ProductID").join(products, "ProductID").select("OrderNumber", "model_no").distinct()
    pictures = model_picture.withColumnRenamed("ModelNumber", "model_no")
    return lookup_first(models, pictures, ["model_no"], "ModelPicture", ["ModelPicture"], "_picture").select(
        F.col("OrderNumber").alias("order_number"),
        "model_no",
        picture_url(F.col("_picture")).alias("picture"),
        F.lit(None).cast("int").alias("checkbox"),
        F.lit(0).alias("qty"),
        F.lit("").alias("job_type"),
        F.lit("").alias("remark"),
    )


def all_models(model_picture: DataFrame) -> DataFrame:
    return model_picture.select(F.col("ModelNumber").alias("model_no"), picture_url(F.col("ModelPicture")).alias("picture"))


def purchase_requests(
    bills: DataFrame, positions: DataFrame, sections: DataFrame, employee: DataFrame, as_of: date, year_above: int, days: int = 30
) -> DataFrame:
    """Purchase bills that are open or were received lately, with people, section and position."""
    rows = bills.where(year_cmp(F.col("Bill_Date"), ">", year_above) & recent(F.col("Receive_Date"), as_of, days))
    where = positions.withColumnsRenamed({"section_code": "Section_Code", "position_code": "Position_Code"})
    rows = rows.join(where, ["Section_Code", "Position_Code"])
    rows = rows.join(sections.withColumnRenamed("SectionCode", "Section_Code"), "Section_Code")
    requesters = employee.select(
        F.col("EmpCode").alias("Request_ID"), F.col("EmpFullName").alias("request_name"),
        F.col("NickName").alias("request_nick"), picture_url(F.col("EmpPict")).alias("request_picture"),
    )
    inspector = {"inspector_name": F.col("EmpFullName"), "_inspector_path": F.col("EmpPict")}
    rows = role_join(rows.join(requesters, "Request_ID"), employee, "EmpCode", {"i": ("Inspactor_ID", inspector)})
    return rows.select(
        F.col("Purchase_Bill_ID").alias("bill_id"),
        F.col("Purchase_Bill_Doc").alias("doc_number"),
        "request_name",
        "request_nick",
        "request_picture",
        F.col("SectionName").alias("section"),
        F.col("position_name").alias("position"),
        F.to_date("Bill_Date").alias("bill_date"),
        F.col("Status_Code").alias("status"),
        "inspector_name",
        picture_url(F.col("_inspector_path"), default=DEFAULT_PICTURE).alias("inspector_picture"),
    )


def purchase_header(bills: DataFrame, positions: DataFrame) -> DataFrame:
    """Purchase bill headers with the requesting position."""
    where = positions.withColumnsRenamed({"section_code": "Section_Code", "position_code": "Position_Code"})
    return bills.join(where, ["Section_Code", "Position_Code"]).select(
        F.col("Purchase_Bill_ID").alias("bill_id"),
        F.col("Purchase_Bill_Doc").alias("doc_number"),
        F.col("Request_ID").alias("request_id"),
        F.col("Inspactor_ID").alias("inspector_id"),
        F.col("Status_Code").alias("status"),
        F.col("position_name").alias("position"),
    )


def purchase_first_items(detail: DataFrame, inventory: DataFrame, first: int = 3) -> DataFrame:
    """The first item names of each bill; a free-text item shows its remark."""
    name = F.when(
        F.col("ITEM_NAME") == L.FREE_TEXT_ITEM, F.concat(F.col("Remark"), F.lit(f" ({L.FREE_TEXT_ITEM})"))
    ).otherwise(F.col("ITEM_NAME"))
    return detail.where(F.col("ITEM_NO") <= first).join(inventory, "ITEM_ID").select(
        F.col("Purchase_Bill_ID").alias("bill_id"), F.col("ITEM_NO").alias("item_no"), name.alias("item_name")
    )


def purchase_lines(detail: DataFrame, inventory: DataFrame, units: DataFrame) -> DataFrame:
    """Bill lines with item and unit names."""
    named = units.select(F.col("UNIT_ID").alias("ITEM_UNIT_ID"), "UNIT_NAME")
    return detail.join(inventory.select("ITEM_ID", "ITEM_NAME", "PRICE"), "ITEM_ID").join(named, "ITEM_UNIT_ID").select(
        F.col("Purchase_Bill_ID").alias("bill_id"),
        F.col("ITEM_NO").alias("item_no"),
        F.col("ITEM_ID").alias("item_id"),
        F.col("ITEM_NAME").alias("item_name"),
        F.col("ITEM_Qty").alias("qty"),
        F.col("UNIT_NAME").alias("unit"),
        (F.col("PRICE") * F.col("ITEM_Qty")).alias("price"),
        F.col("Remark").alias("remark"),
    )


def purchase_inventory(inventory: DataFrame, types: DataFrame, units: DataFrame, wanted_types: Sequence | None = None) -> DataFrame:
    """Inventory with type and unit names, all or some types; type 0 is always offered."""
    rows = inventory if wanted_types is None else inventory.where(in_padded(F.col("INV_TYPE_ID"), [*wanted_types, 0]))
    return rows.join(types, "INV_TYPE_ID").join(units, "UNIT_ID").select(
        F.col("INV_TYPE_ID").alias("type_id"),
        F.col("INV_TYPE_NAME").alias("type_name"),
        F.col("ITEM_ID").alias("item_id"),
        F.col("ITEM_NAME").alias("item_name"),
        F.col("UNIT_NAME").alias("unit"),
        F.col("PRICE").alias("price"),
    )


def purchase_waiting(bills: DataFrame) -> DataFrame:
    """Bills ready to collect, per requester."""
    waiting = bills.where(F.col("Status_Code") == READY_TO_COLLECT)
    return waiting.groupBy(F.col("Request_ID").alias("request_id")).agg(F.count(F.lit(1)).alias("waiting"))


def staff(employee: DataFrame, departments: DataFrame, positions: DataFrame) -> DataFrame:
    """Staff with department and position; no personal data, no credentials."""
    return employee.join(departments, "DepartmentCode", "left").join(positions, "PositionCode", "left").select(
        F.col("EmpCode").alias("code"),
        F.col("EmpFullName").alias("full_name"),
        _person().alias("display_name"),
        F.col("DepartmentName").alias("department"),
        F.col("PositionName").alias("position"),
        picture_url(F.col("EmpPict"), default=DEFAULT_PICTURE).alias("picture"),
    )


def news(posts: DataFrame, employee: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Notices of the last days that are not disabled, newest first."""
    fresh = posts.where((F.col("postStatus") == "0") & recent(F.col("postDate"), as_of, days, null_is_open=False))
    roles = {"o": ("postOwner", {"owner_name": F.col("EmpFullName")})}
    return role_join(fresh, employee, "EmpCode", roles).orderBy("postStatus", F.desc("postDate"), F.desc("ID")).select(
        F.col("ID").alias("post_id"),
        F.col("postHeader").alias("header"),
        F.col("postDate").alias("post_date"),
        F.col("postStatus").alias("status"),
        "owner_name",
    )
