"""Row numbers and running totals over groups of any size.

A window puts one group into one task, which fails when a key holds a large part of the table, or
when there is no key at all. Here the rows are cut into slices, ranges of (key, order), so that a big
group spreads over many slices; each slice is numbered or summed by itself, and the totals of the
slices before it are added. At most one group continues from one slice into the next, so the table of
carried totals never has more rows than there are slices, and can be broadcast.

The borders of the slices are a scalar subquery: quantiles of the rows whose hash is least, which is a
mergeable sample of fixed size that depends on the data alone. So a row has the same slice wherever the
plan computes it; nothing is stored, and no job runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLICE, _CARRY, _VALUE = "_slice", "_carry", "_value"

#: Rows of the sample for each slice. A slice has more than twice its share with a chance below one in a million.
SAMPLED = 64


@dataclass(frozen=True)
class Descending:
    """A column by which an order falls, nulls last."""

    column: str | Column


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ordering(c: str | Column | Descending) -> Column:
    return _as_column(c.column).desc() if isinstance(c, Descending) else _as_column(c)


def _turned(column: Column, kind: T.DataType) -> Column:
    """A value that rises as the column falls, nulls last."""
    if isinstance(kind, T.BooleanType):
        turned = ~column
    elif isinstance(kind, T.DateType):
        turned = -F.unix_date(column)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        turned = -F.unix_micros(column.cast("timestamp"))
    elif isinstance(kind, T.NumericType):
        # The least long has no opposite; it stays the last of its kind.
        turned = F.try_subtract(F.lit(0).cast(kind), column) if isinstance(kind, T.IntegralType) else -column
    else:  # hexadecimal digits the other way round, and an end mark behind all digits
        digits = F.hex(column.cast("string"))
        turned = F.concat(F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    if isinstance(kind, T.IntegralType):
        return F.struct(column.isNull().alias("a"), turned.isNull().alias("b"), turned.alias("c"))
    return F.struct(column.isNull().alias("a"), turned.alias("c"))


def _place(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column | Descending]) -> Column:
    """One value that rises with (keys, order)."""
    parts = [F.col(k) for k in keys]
    for c in order:
        if isinstance(c, Descending):
            column = _as_column(c.column)
            parts.append(_turned(column, df.select(column).schema[0].dataType))
        else:
            parts.append(_as_column(c))
    return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column | Descending], slices: int | None) -> DataFrame:
    """Add the number of the slice of each row."""
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if count < 2:
        return df.withColumn(_SLICE, F.lit(0))
    place = _place(df, keys, order)
    sample = df.select(place.alias("_p")).withColumn("_h", F.xxhash64("_p")).orderBy("_h", "_p").limit(SAMPLED * count)
    ranked = sample.agg(F.array_sort(F.collect_list("_p")).alias("s"))
    every = F.size("s") / F.lit(count)  # fewer rows than slices give some empty slices
    picked = F.transform(F.sequence(F.lit(1), F.lit(count - 1)), lambda k: F.get("s", F.floor(k * every).cast("int")))
    borders = ranked.select(picked).scalar()
    # The number of borders up to the place, bit by bit from the highest.
    bits = F.array(*[F.lit(1 << b) for b in reversed(range((count - 1).bit_length()))])
    number = F.aggregate(
        bits,
        F.lit(0),
        lambda below, bit: F.when(F.get(F.col("_b"), below + bit - 1) <= F.col("_p"), below + bit).otherwise(below),
    )
    return df.withColumns({"_p": place, "_b": borders}).withColumn(_SLICE, number).drop("_p", "_b")


def _with_running(sliced: DataFrame, keys: Sequence[str], order: Sequence[str | Column | Descending], name: str) -> DataFrame:
    """Inclusive running total of ``_value`` as column ``name``."""
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*[_ordering(o) for o in order])
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*keys, _SLICE)
        .agg(F.sum(_VALUE).alias(_VALUE))
        .withColumn(_CARRY, F.sum(_VALUE).over(before))
        .where(F.col(_CARRY).isNotNull())  # only groups that continue from an earlier slice
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_SLICE).alias("_s"), _CARRY)
    )
    same = F.col(_SLICE) == F.col("_s")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return (
        sliced.withColumn(name, F.sum(_VALUE).over(inside))
        .join(F.broadcast(carried), same, "left")  # at most one row per slice
        .withColumn(name, F.col(name) + F.coalesce(F.col(_CARRY), F.lit(0)))
        .drop(*[f"_k_{k}" for k in keys], "_s", _CARRY, _SLICE, _VALUE)
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column | Descending],
    value: str | Column,
    name: str,
    slices: int | None = None,
) -> DataFrame:
    """Add the inclusive running total of ``value`` within ``keys`` in ``order`` (a total order)."""
    valued = df.withColumn(_VALUE, _as_column(value))
    return _with_running(_sliced(valued, keys, order, slices), keys, order, name)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column | Descending],
    name: str,
    slices: int | None = None,
) -> DataFrame:
    """Add the row number (from 1) within ``keys`` in ``order``; without keys, over the whole table."""
    valued = df.withColumn(_VALUE, F.lit(1).cast("bigint"))
    return _with_running(_sliced(valued, keys, order, slices), keys, order, name)
