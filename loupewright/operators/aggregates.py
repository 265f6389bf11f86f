"""Aggregations. Counts and sums combine before the shuffle, so hot keys do no harm."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupewright.operators.joins import left_default


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def pivot_zero(
    df: DataFrame, keys: Sequence[str], code: str, columns: Mapping[str, str], value: str
) -> DataFrame:
    """Sum of ``value`` per key with one column per listed code, 0 for gaps.

    ``columns`` maps a code to its column name. The code list is given, so no job looks for it, and
    one conditional sum per code needs one shuffle where ``pivot`` takes two.
    """
    return df.groupBy(*keys).agg(
        *[sum_where(F.col(code) == c, F.col(value)).alias(n) for c, n in columns.items()]
    )


def count_by_status(df: DataFrame, status: str, columns: Mapping[str, str]) -> DataFrame:
    """One row with the number of documents per status."""
    return df.agg(*[count_where(F.col(status) == c).alias(n) for c, n in columns.items()])


def is_finish(required: Column, delivered: Column) -> Column:
    """1 unless more is required than delivered; unknown totals count as done."""
    return F.when(required > delivered, 0).otherwise(1)


def month_counts(df: DataFrame, day: Column, conditions: Mapping[str, Column]) -> DataFrame:
    """All twelve months with a count per condition, 0 for empty months."""
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    counted = df.groupBy(F.month(day).alias("month")).agg(
        *[count_where(c).alias(n) for n, c in conditions.items()]
    )
    return left_default(months, counted, ["month"], {n: 0 for n in conditions})


def revision_stats(df: DataFrame, key: str, revision: str, quantity: str, changed: str) -> DataFrame:
    """Postponements per key, with the dates of the first and the latest promise.

    The count looks only at revisions with a quantity; the two dates look at all rows. A key with no
    quantity at all is left out.
    """
    by_revision = df.groupBy(key, revision).agg(
        F.max((F.col(quantity) > 0).cast("int")).alias("_has"), F.max(changed).alias("_at")
    )
    return (
        by_revision.groupBy(key)
        .agg(
            (F.sum("_has") - 1).alias("postponements"),
            F.max(F.when(F.col(revision) == 1, F.col("_at"))).cast("date").alias("first_target"),
            F.max(F.when(F.col(revision) != 1, F.col("_at"))).cast("date").alias("last_target"),
        )
        .where(F.col("postponements") >= 0)
    )
