"""Semantics of the column functions: zero, NULL, unset dates, padding, labels."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from loupewright.functions import dates, labels, numbers, text
from loupewright.operators import filters
from tests.util import rows, table


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0][0]


def test_int_percent_truncates_and_guards(spark):
    df = table(spark, "a bigint, b bigint", (7, 9), (-7, 2), (5, 0), (5, None), (None, 5), (0, 4))
    got = [r[0] for r in df.select(numbers.int_percent(F.col("a"), F.col("b"))).collect()]
    assert got == [77, -350, 0, 0, 0, 0]
    thirds = table(spark, "a bigint, b bigint", (-1, 3))
    assert thirds.select(numbers.int_percent(F.col("a"), F.col("b"))).collect()[0][0] == -33


def test_ratio_and_clamp(spark):
    assert one(spark, numbers.guarded_ratio(F.lit(3), F.lit(0))) is None
    assert one(spark, numbers.guarded_ratio(F.lit(3), F.lit(4))) == 0.75
    df = table(spark, "v bigint", (-5,), (0,), (3,), (None,))
    assert [r[0] for r in df.select(numbers.clamp_at_zero(F.col("v"))).collect()] == [0, 0, 3, None]


def test_text(spark):
    assert one(spark, text.trimmed_length(F.lit("ab  "))) == 2
    assert one(spark, text.same_text(F.lit("ch-1 "), F.lit("CH-1")))
    assert one(spark, text.concat_skip_null(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "ab"
    assert one(spark, text.display_name(F.lit("A"), F.lit(None).cast("string"))) is None
    assert one(spark, text.display_name(F.lit("A"), F.lit("b"))) == "A (b)"
    assert one(spark, text.picture_url(F.lit("D:\\P#1\\a.jpg"), base="x/")) == "x/P%231/a.jpg"
    assert one(spark, text.picture_url(F.lit(""), base="x/", default="none.png")) == "x/none.png"
    assert one(spark, text.picture_url(F.lit(None).cast("string"), base="x/", default="none.png")) == "x/none.png"
    assert one(spark, text.picture_url(F.lit(None).cast("string"), base="x/")) is None
    assert one(spark, text.zero_pad(F.lit(42), 5)) == "00042"
    assert one(spark, text.zero_pad(F.lit(123456), 5)) == "123456"
    assert one(spark, text.zero_pad(F.lit(123456), 5, cut=True)) == "23456"
    assert one(spark, text.picture_url(F.lit("D:\\" + "a" * 300), base="x/")) == "x/" + "a" * 300
    assert one(spark, text.clock_text(F.lit("093007"))) == "09:30:07"


def test_dates(spark):
    as_of = date(1998, 6, 15)
    near = table(spark, "d timestamp_ntz", (datetime(1998, 6, 16, 0, 1),), (datetime(1998, 6, 14, 23, 59),))
    assert [r[0] for r in near.select(dates.days_until(as_of, F.to_date("d"))).collect()] == [1, -1]
    eras = table(spark, "d date", (date(2564, 5, 1),), (date(2563, 5, 1),), (None,))
    assert [r[0] for r in eras.select(dates.gregorian(F.col("d"))).collect()] == [date(2021, 5, 1), date(2563, 5, 1), None]
    assert one(spark, dates.buddhist_prefix(F.lit(date(2022, 3, 1)))) == "6503"
    unset = table(spark, "d date", (None,), (date(2014, 12, 31),), (date(2015, 1, 1),))
    assert [r[0] for r in unset.select(dates.unset_before(F.col("d"), 2015)).collect()] == [True, True, False]


def test_labels(spark):
    sunday = F.lit(date(2024, 1, 7))
    assert one(spark, labels.weekday_label(sunday)) == labels.WEEKDAYS[1]
    assert one(spark, labels.weekday_label(F.lit(None).cast("date"), "?")) == "?"
    assert one(spark, labels.label(F.lit("9"), labels.TEAMS, labels.NO_TEAM)) == labels.NO_TEAM
    units = table(spark, "p string", ("Q",), ("",), ("W",))
    assert [r[0] for r in units.select(labels.unit_of_price(F.col("p"), F.lit("q"), F.lit("w"))).collect()] == ["q", "q", "w"]


def test_date_between_modes(spark):
    df = table(
        spark, "t timestamp_ntz",
        (datetime(2024, 1, 1),), (datetime(2024, 1, 2, 0, 0),), (datetime(2024, 1, 2, 12),),
        (datetime(2024, 1, 2, 23, 59, 59, 500000),), (datetime(2024, 1, 3),),
    )
    count = lambda mode: df.where(filters.date_between(F.col("t"), date(2024, 1, 1), date(2024, 1, 2), mode)).count()
    assert (count("raw"), count("end_of_day"), count("day")) == (2, 3, 4)


def test_live_orders(spark):
    df = table(
        spark, "OrderNumber string, Status string, DueDate date, OrderDate date",
        ("CH-1", "2", date(2022, 1, 1), date(2021, 12, 1)),
        ("CH-M-1", "2", date(2022, 1, 1), date(2021, 12, 1)),
        ("CH-TEST1", "2", date(2022, 1, 1), date(2021, 12, 1)),
        ("XX-1", "2", date(2022, 1, 1), date(2021, 12, 1)),
        ("CH-2", "3", date(2022, 1, 1), date(2021, 12, 1)),
        ("CH-3", "2", date(2021, 12, 31), date(2021, 1, 1)),
    )
    numbers_of = lambda frame: [r[0] for r in rows(frame, "OrderNumber")]
    assert numbers_of(filters.live_orders(df)) == ["CH-1", "CH-3"]
    assert numbers_of(filters.live_orders(df, exclude_test=False)) == ["CH-1", "CH-3", "CH-TEST1"]
    assert numbers_of(filters.live_orders(df, due_year_floor=2022)) == ["CH-1"]


def test_padded_list_and_recent(spark):
    df = table(spark, "team string, d date", ("1", None), ("W", date(2024, 1, 1)), ("", date(2024, 1, 31)))
    pick = lambda values: [r[0] for r in rows(df.where(filters.in_padded(F.col("team"), values, {"0": ("1", "W")})), "team")]
    assert pick(["1", None, None]) == ["1"]
    assert pick(["0"]) == ["1", "W"]
    assert pick([None]) == []
    fresh = lambda **k: df.where(filters.recent(F.col("d"), date(2024, 2, 1), 7, **k)).count()
    assert (fresh(), fresh(null_is_open=False)) == (2, 1)


def test_contains_has_no_wildcards(spark):
    df = table(spark, "s string", ("50% off",), ("half",), (None,))
    assert df.where(filters.contains_text(F.col("s"), "0%")).count() == 1
    assert df.where(filters.contains_text(F.col("s"), "HAL")).count() == 1
    assert df.where(filters.contains_text(F.col("s"), "")).count() == 2
