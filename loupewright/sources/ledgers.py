"""Appends that happen once, and numbers that are given once, for batches that run side by side.

A commit is a small file that appears whole or not at all (it is written under another name and renamed,
which fails if the name is taken). Data of a batch lies in a folder of its own, and counts from the
moment its commit is there: a reader sees whole batches, an attempt that died leaves nothing that anyone
reads, and a batch that is run again finds its commit and changes nothing.

Numbers are reserved in blocks, one block per key and batch. Reservations are commits numbered 1, 2, …:
of two batches that try for the same number one loses, reads what the other took, and tries the next.
Folders must lie in a file system that renames atomically, such as the cluster's shared one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupewright.operators.ranked import number_rows

#: Every so many reservations the folder of one holds the last numbers of all keys, not only of its own.
WHOLE_EVERY = 32


class Commits:
    """The commit files of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path(self.folder)
        self._files = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """All commits in order of their names. There is one row per batch."""
        if not self._files.exists(self._path):
            return []
        names = sorted(s.getPath().getName() for s in self._files.listStatus(self._path))
        names = [n for n in names if n.endswith(".json") and not n.startswith("_")]
        if not names:
            return []
        lines = self.spark.read.text([f"{self.folder}/{n}" for n in names]).select("value", F.input_file_name().alias("f"))
        return [json.loads(r.value) for r in sorted(lines.collect(), key=lambda r: r.f)]

    def has(self, name: str) -> bool:
        return self._files.exists(self._hadoop.Path(f"{self.folder}/{quote(name, safe='')}.json"))

    def add(self, name: str, entry: dict) -> bool:
        """Whether the commit was made; False if the name is taken."""
        target = self._hadoop.Path(f"{self.folder}/{quote(name, safe='')}.json")
        draft = self._hadoop.Path(f"{self.folder}/_{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(self._files.makeQualified(draft), self._files.makeQualified(target), options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            self._files.delete(draft, False)
            return False


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    """Equality of the keys of two aliased frames; nulls are equal."""
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return same


class Numbers:
    """The numbers given per key, from 1 on and without gaps."""

    def __init__(self, spark: SparkSession, path: str, keys: T.StructType):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys.fieldNames()
        self.commits = Commits(spark, f"{self.path}/commits")
        numbers = [T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("own", T.BooleanType())]
        self._schema = T.StructType([*keys.fields, *numbers, T.StructField("folder", T.StringType())])

    def _blocks(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(f"{self.path}/blocks").where(F.col("folder").isin(list(folders)))

    def last_numbers(self, entries: list[dict] | None = None) -> DataFrame:
        """keys, last: the last number given of each key."""
        entries = self.commits.entries() if entries is None else entries
        whole = max((k for k, e in enumerate(entries) if e["whole"]), default=0)
        blocks = self._blocks([e["folder"] for e in entries[whole:]])
        return blocks.groupBy(*self.keys).agg(F.max("last").alias("last"))

    def reserve(self, counts: DataFrame, batch: str) -> DataFrame:
        """keys, first, last: the block of each key of ``counts`` (keys and a positive count, each key once).

        A batch that has reserved before gets the same blocks again, whatever its counts are now. A null
        key is a key like any other.
        """
        while True:
            entries = self.commits.entries()
            known = [e["folder"] for e in entries if e["batch"] == batch]
            if known:
                return self._blocks(known).where("own").select(*self.keys, "first", "last")
            folder, number = uuid.uuid4().hex, len(entries) + 1
            before, wanted = self.last_numbers(entries).alias("b"), counts.select(*self.keys, "count").alias("w")
            whole = number % WHOLE_EVERY == 0
            joined = wanted.join(before, _same(self.keys, "w", "b"), "full" if whole else "left")
            taken = F.coalesce(F.col("b.last"), F.lit(0).cast("bigint"))
            blocks = joined.select(
                *[F.coalesce(F.col(f"w.{k}"), F.col(f"b.{k}")).alias(k) for k in self.keys],
                (taken + 1).alias("first"),
                (taken + F.coalesce(F.col("w.count"), F.lit(0))).cast("bigint").alias("last"),
                F.col("w.count").isNotNull().alias("own"),
            )
            blocks.write.mode("overwrite").parquet(f"{self.path}/blocks/folder={folder}")
            if self.commits.add(f"{number:012d}", {"batch": batch, "folder": folder, "whole": whole}):
                return self._blocks([folder]).where("own").select(*self.keys, "first", "last")


def numbered_once(
    rows: DataFrame, path: str, batch: str, keys: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """Add to each row its number within its key, going on after all batches before.

    The block of numbers is reserved under ``path``. ``order`` must be a total order within the key, so
    that a batch run again numbers its rows as before.
    """
    numbers = Numbers(rows.sparkSession, path, T.StructType([rows.schema[k] for k in keys]))
    blocks = numbers.reserve(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")), batch)
    placed = number_rows(rows, keys, order, "_place").alias("r")
    joined = placed.join(blocks.alias("b"), _same(keys, "r", "b"))
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("b.first") + F.col("r._place") - 1).alias(name))


def append_history(
    rows: DataFrame,
    path: str,
    batch: str,
    keys: Sequence[str],
    order: Sequence[str | Column],
    partition_by: str,
    sequence: str = "sequence",
) -> bool:
    """Append a batch of history rows with the next sequence numbers of their keys; False if it is there already.

    Rows are clustered on the history date, so each task writes few files, and adaptive execution may
    split a date that holds most of the batch.
    """
    spark = rows.sparkSession
    commits = Commits(spark, f"{path}/commits")
    if commits.has(batch):
        return False
    numbered = numbered_once(rows, f"{path}/numbers", batch, keys, order, sequence)
    folder = uuid.uuid4().hex
    target = f"{path}/rows/folder={folder}"
    numbered.hint("rebalance", F.col(partition_by)).write.partitionBy(partition_by).parquet(target)
    return commits.add(batch, {"batch": batch, "folder": folder})


def read_history(spark: SparkSession, path: str, schema: T.StructType, sequence: str = "sequence") -> DataFrame:
    """The rows of all batches that are committed, with their sequence numbers."""
    whole = T.StructType([*schema.fields, T.StructField(sequence, T.LongType())])
    folders = [e["folder"] for e in Commits(spark, f"{path}/commits").entries()]
    if not folders:
        return spark.createDataFrame([], whole)
    stored = T.StructType([*whole.fields, T.StructField("folder", T.StringType())])
    return spark.read.schema(stored).parquet(f"{path}/rows").where(F.col("folder").isin(folders)).select(*whole.fieldNames())
