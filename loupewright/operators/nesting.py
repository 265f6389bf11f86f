"""Nested arrays of child rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupewright.operators.ranked import number_rows


def long_form(child: DataFrame, keys: Sequence[str], fields: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """The children of every key in order, one row each: keys, ``ordinal`` from 1, ``fields``.

    This is the form for children of any number: nothing is gathered into an array, and a key's rows
    spread over many tasks.
    """
    return number_rows(child.select(*keys, *fields), keys, list(fields), ordinal).select(*keys, ordinal, *fields)


def collect_children(
    child: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str, only: Column | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per key, with the children as an array of structs sorted by ``fields`` from left to right.

    An array is one value of one row: use it where the key bounds the number of children (items of a
    bill, days of a calendar, processes of a job), and :func:`long_form` where it does not. With ``only``
    other rows stay out of the array; ``totals`` are aggregates over all rows in the same pass.
    """
    entry = F.struct(*fields) if only is None else F.when(only, F.struct(*fields))
    sums = [c.alias(n) for n, c in (totals or {}).items()]
    return child.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(name), *sums)


def _attach(parent: DataFrame, packed: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    kind = packed.schema[name].dataType
    return parent.join(packed, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def nest_many(
    parent: DataFrame, children: Sequence[tuple[DataFrame, Sequence[str], str]], keys: Sequence[str]
) -> DataFrame:
    """Each parent once, with several child tables as arrays; an empty array where there are no children.

    ``children`` lists (table, fields, array name). Each child table is read once.
    """
    nested = parent
    for child, fields, name in children:
        nested = _attach(nested, collect_children(child, keys, fields, name), keys, name)
    return nested


def nest(
    parent: DataFrame, child: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str, only: Column | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Each parent once, with one child table as an array.

    ``only`` and ``totals`` as in :func:`collect_children`; the totals of a parent without children are NULL.
    """
    return _attach(parent, collect_children(child, keys, fields, name, only, totals), keys, name)


def column_to_array(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct values of a column per key as one sorted array; for columns of few different values."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(column)).alias(name))


def row_span(*arrays: Column) -> Column:
    """Rows a report needs for parallel lists: the longest one, and at least one row."""
    return F.greatest(*[F.size(a) for a in arrays], F.lit(1))


def children_text(array: Column, *fields: str) -> Column:
    """The children as one text, ``field:field`` per child, for flat files and comparisons."""
    entry = lambda e: F.concat_ws(":", *[e[f].cast("string") for f in fields])
    return F.array_join(F.transform(array, entry), ",")
