"""Code-to-label maps. Labels are data: every report takes its map as an argument."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and codes the reports show.
WEEKDAYS = {1: "อา", 2: "จ", 3: "อ", 4: "พ", 5: "พฤ", 6: "ศ", 7: "ส"}
MONTHS = {
    1: "มกราคม",
    2: "กุมภาพันธ์",
    3: "มีนาคม",
    4: "เมษายน",
    5: "พฤษภาคม",
    6: "มิถุนายน",
    7: "กรกฎาคม",
    8: "สิงหาคม",
    9: "กันยายน",
    10: "ตุลาคม",
    11: "พฤศจิกายน",
    12: "ธันวาคม",
}
TEAMS = {"1": "FAC1", "2": "FAC2", "3": "FAC3", "4": "FAC4"}
NO_TEAM = "ไม่ระบุ"
NO_DATA = "ไม่มีข้อมูล"
REPAIR_STATUS = {"": "รอยืนยันรับ", "1": "กำลังซ่อม", "2": "ส่งซ่อมกลับ", "3": "ครบแล้ว"}
ORDER_EARLY, ORDER_PUSH, ORDER_OVERDUE, ORDER_NORMAL = "ดีมาก", "เร่งการผลิต", "เลยกำหนดส่ง", "ปกติ"
CAST_NONE, CAST_PARTIAL, CAST_COMPLETE = "ไม่มีหล่อซ่อม", "ยังรับกลับไม่ครบ", "รับกลับครบแล้ว"
STONE_COMPLETE, STONE_NOT_ORDERED, STONE_ORDERED = "ครบแล้ว", "ยังไม่ได้สั่งซื้อ", "สั่งซื้อแล้ว"
STONE_NO_DATE, STONE_NORMAL, STONE_LATE = "ยังไม่ได้ใส่กำหนด", "ปกติ", "ล่าช้า"
QA_IN_PRODUCTION, QA_ALL_SENT = "กำลังผลิต", "ส่งQAครบ"
QUEUE_NONE, QUEUE_PREFIX, QUEUE_UNSET = "ยังไม่ได้จัดคิว", "คิวที่ ", 99
FREE_TEXT_ITEM = "อื่นๆ"
OWN_CASTING, OWN_CASTING_DUE = "หล่อเอง", "31/12/2565"
DEPARTMENT_BILL = " (บิลแผนก : "
GENDERS = {"M": "ชาย", "F": "หญิง"}
WEEKDAY_COLOUR, WEEKEND_COLOUR = "#A7FFEB", "#FFCDD2"
STONE_GROUPS = ("02", "03", "04", "05", "06")
PART_GROUPS = ("07", "12", "15")
PROCESS_CODES = tuple(f"{n:02d}" for n in range(1, 23))
ORDER_PROCESSES_HIDDEN = ("01", "15", "17", "18", "19", "20", "21", "22")
JOB_PROCESSES_HIDDEN = ("01", "02", "17", "18", "19", "20", "21", "22")

#: Managers are known by their code only; pass a map to show names.
MANAGERS = {"1": "manager 1", "2": "manager 2", "3": "manager 3"}


def label(code: Column, labels: Mapping, default: str | None = "") -> Column:
    """The label of a code, ``default`` for unknown codes and NULL."""
    pairs = list(labels.items())
    column = F.when(code == F.lit(pairs[0][0]), F.lit(pairs[0][1]))
    for key, text in pairs[1:]:
        column = column.when(code == F.lit(key), F.lit(text))
    return column.otherwise(F.lit(default))


def weekday_label(day: Column, default: str = "") -> Column:
    return label(F.dayofweek(day), WEEKDAYS, default)


def month_label(day: Column) -> Column:
    return label(F.month(day), MONTHS, None)


def unit_of_price(price_type: Column, quantity_unit: Column, weight_unit: Column) -> Column:
    """Things priced by piece, or not priced, show the piece unit; the others the weight unit."""
    return F.when(price_type.isin("Q", ""), quantity_unit).otherwise(weight_unit)
