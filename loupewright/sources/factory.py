"""Loading of factory tables: keys and unset dates are normalised once, at the border."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupewright.functions.dates import unset_before
from loupewright.functions.text import key_text


def normalise(
    df: DataFrame,
    keys: Sequence[str] = (),
    dates: Sequence[str] = (),
    texts: Sequence[str] = (),
    unset_year: int = 2015,
) -> DataFrame:
    """Make plain equality and NULL checks mean what the source system means by them.

    ``keys`` lose trailing blanks and letter case, ``texts`` (status codes, for instance) only the
    blanks, and ``dates`` before ``unset_year``, which stand for "not set", become NULL. Apply it when
    a table is written to storage, so that later filters on these columns still reach the scan.
    """
    columns = {k: key_text(F.col(k)) for k in keys}
    columns |= {t: F.rtrim(F.col(t)) for t in texts}
    columns |= {d: F.when(~unset_before(F.col(d).cast("date"), unset_year), F.col(d)) for d in dates}
    return df.withColumns(columns)


def parse_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dates that arrive as text; an empty or unreadable text becomes NULL."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as date)") for c in columns})


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored factory table with its declared schema."""
    return spark.read.schema(schema).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table of a relational database, read in parallel over ranges of a numeric key."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options
    )


def write_table(df: DataFrame, path: str, cluster_by: str, files: int | None = None) -> None:
    """Store a factory table sorted by its usual filter column, so that row groups can be skipped."""
    ranged = df.repartitionByRange(files, cluster_by) if files else df.repartitionByRange(cluster_by)
    ranged.sortWithinPartitions(cluster_by).write.mode("overwrite").parquet(path)

