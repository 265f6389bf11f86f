"""Snapshots in buckets of their key, of which a change rewrites only those it touches.

A row lies in the bucket of its key's hash. A change reads the buckets that its keys fall into, writes
them anew to a folder of its own, and commits which folder each bucket is in from then on. Readers see
the snapshot of the last commit as a whole; of two changes at once the one that comes second reads what
the first one left and is applied to that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupewright.operators.changes import apply_upserts
from loupewright.sources.ledgers import Commits


class BucketedSnapshot:
    """A table with a unique key. The number of buckets is fixed when it is first written."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self.commits = Commits(spark, f"{self.path}/commits")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folders(self, entries: list[dict]) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        found: dict[int, str] = {}
        for entry in entries:
            for bucket in entry["touched"]:
                found.pop(bucket, None)
            found.update(dict.fromkeys(entry["filled"], entry["folder"]))
        return found

    def _read(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/rows/folder={folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The snapshot as of the last commit."""
        return self._read(self._folders(self.commits.entries()))

    def change(self, touched_keys: DataFrame, apply: Callable[[DataFrame], DataFrame], batch: str) -> int:
        """Replace the touched buckets by ``apply`` of their rows; the number of buckets written.

        ``apply`` may only add, change or remove rows of the touched keys. A batch that is there already
        is not applied again (-1). The buckets, not the keys, of a change come to the driver.
        """
        touched = sorted(r[0] for r in touched_keys.select(self._bucket()).distinct().collect())
        while True:
            entries = self.commits.entries()
            if any(e["batch"] == batch for e in entries):
                return -1
            if not touched:
                return 0
            before = self._folders(entries)
            new = apply(self._read({b: before[b] for b in touched if b in before})).select(*self.schema.fieldNames())
            folder = uuid.uuid4().hex
            target = f"{self.path}/rows/folder={folder}"
            new.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(target)
            filled = self._filled(target, touched)
            if self.commits.add(f"{len(entries) + 1:012d}", {"batch": batch, "folder": folder, "touched": touched, "filled": filled}):
                return len(touched)

    def _filled(self, target: str, touched: Sequence[int]) -> list[int]:
        """The buckets that have rows; a bucket that lost its last row has no folder."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.Path(target).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [b for b in touched if files.exists(hadoop.Path(f"{target}/bucket={b}"))]

    def upsert(self, changes: DataFrame, seq: Sequence[str], batch: str) -> int:
        """Replace or insert whole rows by key; the last change of a key wins."""
        return self.change(changes, lambda rows: apply_upserts(rows, changes, self.keys, seq), batch)

    def delete(self, keys: DataFrame, batch: str) -> int:
        """Remove rows by key."""
        gone = keys.select(*self.keys).distinct()
        return self.change(gone, lambda rows: rows.join(gone, self.keys, "left_anti"), batch)
