"""Balances and allocation of received quantities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupewright.operators.joins import left_default
from loupewright.operators.ranked import running_total


def running_balance(rows: DataFrame, starts: DataFrame, key: str, day: str, quantity: str, start: str) -> DataFrame:
    """What is left of a start quantity after each day, and the total of all days.

    Rows are summed to (key, day) first, so a key has at most one row per day in the window.
    """
    daily = rows.groupBy(key, day).agg(F.sum(quantity).alias(quantity))
    upto = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.join(starts.select(key, start), key).select(
        key,
        day,
        quantity,
        (F.col(start) - F.sum(quantity).over(upto)).alias("balance"),
        F.sum(quantity).over(Window.partitionBy(key)).alias("total"),
    )


def fifo_allocate(
    receipts: DataFrame,
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    required: str = "qty_req",
    delivered: str = "qty_to_fact",
    received: str = "received",
) -> dict[str, DataFrame]:
    """Spread each received quantity over the open lines of its key, in order, until it is used up.

    ``lines`` come back with what each was given and its new delivered quantity and balance,
    ``history`` has one row per line that was given something, and ``rest`` what no line could take.
    A line that already has enough takes nothing. ``order`` must be a total order within the key.
    """
    open_quantity = F.greatest(F.col(required) - F.col(delivered), F.lit(0))
    summed = receipts.groupBy(*keys).agg(F.sum(received).alias("_received"))
    running = running_total(lines.withColumn("_open", open_quantity), keys, order, "_open", "_upto")
    filled = left_default(running, summed, keys, {"_received": 0})
    left_over = F.col("_received") - (F.col("_upto") - F.col("_open"))
    allocated = F.greatest(F.lit(0), F.least(F.col("_open"), left_over))
    result = (
        filled.withColumn("allocated", allocated)
        .withColumn("new_delivered", F.col(delivered) + F.col("allocated"))
        .withColumn("new_balance", F.col(required) - F.col("new_delivered"))
        .drop("_open", "_upto", "_received")
    )
    capacity = lines.groupBy(*keys).agg(F.sum(open_quantity).alias("_capacity"))
    rest = left_default(summed, capacity, keys, {"_capacity": 0}).select(
        *keys, F.greatest(F.col("_received") - F.col("_capacity"), F.lit(0)).alias("rest")
    )
    return {"lines": result, "history": result.where(F.col("allocated") > 0), "rest": rest.where(F.col("rest") > 0)}
