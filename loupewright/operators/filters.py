"""Predicates written so that they reach the parquet scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupewright.functions.dates import moment

# Order-number classes and the status of a live order.
ORDER_PREFIX, MODEL_PREFIX, TEST_PREFIX = "CH-", "CH-M-", "CH-TEST"
LIVE_STATUS = "2"
ALL_TEAMS = ("1", "2", "3", "4")
ALL_BILL_TEAMS = ("1", "2", "3", "4", "W")


def in_padded(column: Column, values: Iterable, expand: Mapping | None = None) -> Column:
    """IN over a list whose empty slots match nothing and whose group values stand for several."""
    chosen: list = []
    for value in values:
        if value is None:
            continue
        chosen.extend(expand[value] if expand and value in expand else [value])
    return column.isin(chosen) if chosen else F.lit(False)


def date_between(column: Column, low: date, high: date, mode: str = "day") -> Column:
    """Date range on a timestamp column.

    ``raw`` compares with midnight of ``high``, so the rest of that day is out. ``day`` and
    ``end_of_day`` take the whole day in; ``end_of_day`` stops at its last second, ``day`` at the
    next midnight. All are plain range comparisons on the column, so row groups can be skipped.
    """
    low_stamp = moment(low).cast("timestamp_ntz")
    if mode == "raw":
        return (column >= low_stamp) & (column <= moment(high).cast("timestamp_ntz"))
    if mode == "day":
        return (column >= low_stamp) & (column < moment(high + timedelta(days=1)).cast("timestamp_ntz"))
    if mode == "end_of_day":
        last = F.lit(f"{high.isoformat()} 23:59:59").cast("timestamp_ntz")
        return (column >= low_stamp) & (column <= last)
    raise ValueError(f"unknown mode {mode!r}")


def open_or_between(in_range: Column, status: Column, open_codes: Sequence[str]) -> Column:
    """Rows in the range, and open rows whatever their date."""
    return in_range | status.isin(list(open_codes))


def live_order_number(number: Column, exclude_test: bool = True) -> Column:
    keep = number.startswith(ORDER_PREFIX) & ~number.startswith(MODEL_PREFIX)
    return keep & ~number.startswith(TEST_PREFIX) if exclude_test else keep


def live_orders(
    orders: DataFrame,
    exclude_test: bool = True,
    due_year_floor: int | None = None,
    order_year: int | None = None,
    status: str = LIVE_STATUS,
) -> DataFrame:
    """Orders in work: live status, ordinary number, and optionally a year bound."""
    keep = (F.col("Status") == status) & live_order_number(F.col("OrderNumber"), exclude_test)
    if due_year_floor is not None:
        keep = keep & year_cmp(F.col("DueDate"), ">=", due_year_floor)
    if order_year is not None:
        keep = keep & year_cmp(F.col("OrderDate"), "=", order_year)
    return orders.where(keep)


def contains_text(column: Column, text: str) -> Column:
    """Substring search in upper case; an empty text matches every row that has a value."""
    return F.contains(F.upper(column), F.lit(text.upper()))


def recent(column: Column, as_of, days: int, null_is_open: bool = True) -> Column:
    """Later than ``days`` before ``as_of``; a row without a date counts as dated now."""
    newer = column > moment(as_of - timedelta(days=days))
    return newer | column.isNull() if null_is_open else newer


def year_cmp(column: Column, op: str, year: int) -> Column:
    """``YEAR(column) op year`` as a range on the column itself."""
    start, following = F.lit(date(year, 1, 1)), F.lit(date(year + 1, 1, 1))
    if op == "=":
        return (column >= start) & (column < following)
    if op == ">=":
        return column >= start
    if op == ">":
        return column >= following
    raise ValueError(f"unknown comparison {op!r}")


def lookup_by_mode(tables: Mapping[int, tuple[DataFrame, str, str]], mode: int, value) -> DataFrame:
    """Distinct keys found through the column that ``mode`` selects.

    ``tables`` maps a mode to (table, search column, key column).
    """
    table, search, key = tables[mode]
    return table.where(F.col(search) == F.lit(value)).select(key).distinct()
