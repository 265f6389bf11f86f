"""Writers of nested JSON documents. Histories are in :mod:`loupewright.sources.ledgers`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_column(df: DataFrame, keys: Sequence[str], name: str = "document") -> DataFrame:
    """Keep ``keys`` and fold the whole row into one JSON text column."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias(name))


def to_documents(df: DataFrame, path: str) -> None:
    """Write one JSON document per row, split over as many files as the data has partitions."""
    df.write.mode("overwrite").json(path)
