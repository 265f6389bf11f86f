"""Calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupewright.functions.dates import month_start
from loupewright.functions.labels import WEEKDAY_COLOUR, WEEKEND_COLOUR


def day_series(spark: SparkSession, year: int, month: int) -> DataFrame:
    """Day numbers of a month."""
    first = F.lit(month_start(year, month))
    return spark.range(1).select(F.explode(F.sequence(F.lit(1), F.day(F.last_day(first)))).alias("day"))


def calendar(spark: SparkSession, year: int, month: int) -> DataFrame:
    """Dates of a month with weekday number, weekend flag and the colour a calendar shows."""
    first = F.lit(month_start(year, month))
    days = spark.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("date"))
    weekend = F.dayofweek("date").isin(1, 7)
    return days.select(
        F.day("date").alias("day"),
        "date",
        F.dayofweek("date").alias("dow"),
        weekend.cast("int").alias("is_weekend"),
        F.when(weekend, WEEKEND_COLOUR).otherwise(WEEKDAY_COLOUR).alias("colour"),
    )


def order_days(frames: list[DataFrame], key: str, day: str) -> DataFrame:
    """Every calendar day between the first and the last date of a key in any of the frames.

    Each frame is reduced to its first and last day before they meet.
    """
    ends = None
    for frame in frames:
        part = frame.groupBy(key).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
        ends = part if ends is None else ends.unionByName(part)
    if len(frames) > 1:
        ends = ends.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spread = ends.select(key, F.explode(F.sequence("lo", "hi")).alias("day"))
    return spread.withColumn("dow", F.dayofweek("day"))
