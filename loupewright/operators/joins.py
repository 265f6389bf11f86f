"""Join shapes. No join is forced to broadcast: the planner does so behind its own size check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def restrict(df: DataFrame, keys: DataFrame, on: Sequence[str], here: bool = False) -> DataFrame:
    """Rows whose key is in the key set.

    The planner moves this down towards the scan, which pays where the keys are few. ``here`` keeps it where
    it is written (an inner join with the distinct keys): for a key set that holds most rows, if the rows
    are dealt by the key at this place anyway.
    """
    if here:
        return df.join(keys.select(*on).distinct(), list(on))
    return df.join(keys.select(*on), list(on), "left_semi")


def left_default(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: Mapping) -> DataFrame:
    """Left join with a default for each named column of a missing right row."""
    joined = left.join(right, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def lookup_agg(
    outer: DataFrame,
    inner: DataFrame,
    on: Sequence[str],
    aggregates: Mapping[str, Column],
    defaults: Mapping | None = None,
) -> DataFrame:
    """Several aggregates of ``inner`` per outer row, in one pass over ``inner``.

    ``inner`` is aggregated to the key before the join, so a hot key costs one partial row per task.
    """
    summed = inner.groupBy(*on).agg(*[c.alias(n) for n, c in aggregates.items()])
    return left_default(outer, summed, on, defaults or {})


def lookup_first(
    outer: DataFrame, dim: DataFrame, on: Sequence[str], column: str, order: Sequence[str], name: str
) -> DataFrame:
    """One attribute per key: that of the first row in ``order``."""
    first = dim.groupBy(*on).agg(F.min_by(column, F.struct(*order)).alias(name))
    return outer.join(first, list(on), "left")


def role_join(df: DataFrame, dim: DataFrame, key: str, roles: Mapping[str, tuple[str, Mapping[str, Column]]]) -> DataFrame:
    """Join one dimension once per role.

    ``roles`` maps a role to (foreign key column, {output column: expression over the dimension}).
    """
    for role, (foreign, outputs) in roles.items():
        side = dim.select(F.col(key).alias(f"_{role}_key"), *[c.alias(n) for n, c in outputs.items()])
        df = df.join(side, F.col(foreign) == F.col(f"_{role}_key"), "left").drop(f"_{role}_key")
    return df


def densify(
    left: DataFrame,
    dimension: DataFrame,
    code_column: str,
    facts: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
) -> DataFrame:
    """Every left row with every code of a dimension table, measures from ``facts``, 0 where there are none.

    The codes come as one array in one row, so each left row is spread in place without a shuffle.
    """
    codes = dimension.agg(F.array_sort(F.collect_set(code_column)).alias("_codes"))  # exactly one row
    spread = left.join(F.broadcast(codes)).withColumn(code_column, F.explode("_codes")).drop("_codes")
    summed = facts.groupBy(*keys, code_column).agg(*[F.sum(m).alias(m) for m in measures])
    return left_default(spread, summed, [*keys, code_column], {m: 0 for m in measures})


def cumulative_days(days: DataFrame, day: str) -> DataFrame:
    """Per calendar day: listed days up to and including it, and its own flag.

    The calendar runs from the day before the first listed day to the day after the last, so the
    running sum has one row per day of that time, and its ends stand for all days before and after.
    """
    ends = days.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where(F.col("lo").isNotNull())
    calendar = ends.select(F.explode(F.sequence(F.date_sub("lo", 1), F.date_add("hi", 1))).alias("day"))
    flags = days.select(F.col(day).alias("day")).distinct().withColumn("flag", F.lit(1))
    ordered = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return left_default(calendar, flags, ["day"], {"flag": 0}).select(
        "day", "flag", F.sum("flag").over(ordered).alias("cum")
    )


def count_between(df: DataFrame, cumulative: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """Listed days in the closed interval between two dates, in either direction; NULL if one is unknown.

    Works on the running count of :func:`cumulative_days`: two equality joins and a subtraction
    instead of a range join. Dates outside the calendar count as its nearest end, which is no listed day.
    """
    edges = cumulative.agg(F.min("day").alias("_first"), F.max("day").alias("_last"))  # exactly one row
    ends = cumulative.select(F.col("day").alias("_hi"), F.col("cum").alias("_hi_cum"))
    starts = cumulative.select(F.col("day").alias("_lo"), F.col("cum").alias("_lo_cum"), F.col("flag").alias("_lo_flag"))
    inside = lambda c: F.least(F.greatest(c, F.col("_first")), F.col("_last"))
    counted = F.coalesce(F.col("_hi_cum") - F.col("_lo_cum") + F.col("_lo_flag"), F.lit(0))
    return (
        df.join(F.broadcast(edges))
        .withColumns({"_a": inside(F.least(low, high)), "_b": inside(F.greatest(low, high))})
        .join(starts, F.col("_a") == F.col("_lo"), "left")
        .join(ends, F.col("_b") == F.col("_hi"), "left")
        .withColumn(name, F.when(low.isNotNull() & high.isNotNull(), counted))
        .drop("_first", "_last", "_a", "_b", "_lo", "_hi", "_lo_cum", "_hi_cum", "_lo_flag")
    )


def cum_upto(
    targets: DataFrame, key: str, target_day: str, facts: Mapping[str, tuple[DataFrame, str, str]]
) -> DataFrame:
    """For each target: totals of the fact tables dated up to and including the target day.

    ``facts`` maps an output column to (table, day column, value column). All tables are first reduced
    to one row per (key, day), so a key never brings more rows into the window than there are days,
    however many facts it has; one window then serves all of them, and an equality join brings the
    totals back to the targets.
    """
    zero = F.lit(0).cast("bigint")
    names = list(facts)
    marks = targets.select(key, F.col(target_day).alias("_day")).distinct().select(key, "_day", *[zero.alias(n) for n in names])
    rows = marks
    for name, (table, day, value) in facts.items():
        daily = table.groupBy(key, F.col(day).alias("_day")).agg(F.sum(value).alias("_v"))
        rows = rows.unionByName(daily.select(key, "_day", *[(F.col("_v") if n == name else zero).alias(n) for n in names]))
    upto = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (
        rows.groupBy(key, "_day")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(F.col(key), F.col("_day").alias(target_day), *[F.sum(n).over(upto).alias(n) for n in names])
    )
    return targets.join(running, [key, target_day], "left")


def latest(df: DataFrame, keys: Sequence[str], revision: str) -> DataFrame:
    """Rows of the highest revision of each key."""
    top = df.groupBy(*keys).agg(F.max(revision).alias(revision))
    return df.join(top, [*keys, revision], "left_semi")
