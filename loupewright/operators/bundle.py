"""Several related results from one pass over one base."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_bundle(base: DataFrame, parts: Mapping[str, Sequence[str]], aggregates: Mapping[str, Column]) -> DataFrame:
    """part, all key columns, aggregates: for each part its groups, with the other parts' keys null.

    The parts are grouping sets of one aggregate, so the base is planned and read once and shuffled
    once, and each task sends one row per group it has. Two parts cannot have the same keys. A key that
    is null in the data is a group of its own. The aggregates can serve some parts only; the reader of
    a part takes the columns it wants. An empty base gives no rows, also for a part without keys.
    """
    columns = list(dict.fromkeys(c for keys in parts.values() for c in keys))
    sets = [sorted(keys, key=columns.index) for keys in parts.values()]
    if len(set(map(tuple, sets))) < len(sets):
        raise ValueError("two parts have the same keys")
    # A grouping id has a bit for each column, the first the highest, set where the column is left out.
    number = {name: sum(1 << len(columns) - 1 - k for k, c in enumerate(columns) if c not in keys) for name, keys in parts.items()}
    grouped = base.groupingSets([[F.col(c) for c in keys] for keys in sets], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_id"), *[a.alias(n) for n, a in aggregates.items()]
    )
    part = F.lit(None).cast("string")
    for name, value in number.items():
        part = F.when(F.col("_id") == value, F.lit(name)).otherwise(part)
    return grouped.select(part.alias("part"), *columns, *aggregates)
