"""Sort keys and limited lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def status_rank(status: Column, first: Sequence[str]) -> Column:
    """Place of a status in ``first``, counted from 1; all others come after."""
    rank = F.lit(len(first) + 1)
    for place in range(len(first), 0, -1):
        rank = F.when(status == first[place - 1], F.lit(place)).otherwise(rank)
    return rank


def numeric_suffix(code: Column, start: int = 2) -> Column:
    """The number in a code such as ``A10``: all digits from place ``start`` on, NULL without any."""
    digits = F.regexp_extract(code, rf"^.{{{start - 1}}}(\d+)", 1)
    return F.when(digits != "", digits.cast("bigint"))


def top_n(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """Sorted list, cut to ``limit`` rows where the caller asks for that (a list without a filter).

    ``order`` must be a total order so that the cut always keeps the same rows.
    """
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def sort_children(array: Column, field: str) -> Column:
    """Order the structs of an array by one field, the rest of the struct breaking ties."""
    return F.array_sort(F.transform(array, lambda e: F.struct(e[field].alias("_sort"), e.alias("_row"))))
