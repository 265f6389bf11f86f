"""Helpers that several operators share: table reads, shared folders, clash-free columns, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from loupewright.sources.session import shared_folder

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name below the shared folder of the cluster."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends and nothing is computed twice."""
    path = work_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def whole_text(text: str = "text") -> Column:
    """The text as UTF-8 bytes, empty where it is null."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def remainder(doc_id: str | Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate results that the frame does not use."""
    taken = {c.lower() for c in frame.columns}
    return [name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex[:8]}" for name in names]


def map_rows(
    frame: DataFrame,
    columns: Sequence[str],
    function: Callable[..., Sequence],
    schema: str,
) -> DataFrame:
    """Map Arrow batches: ``function(*lists of the columns)`` returns one list per new column.

    The result has the frame's own columns and then the new ones, row by row, without a shuffle.
    """
    names = [frame.schema.names.index(c) for c in columns]
    keep = frame.schema.names
    added = StructType.fromDDL(schema)
    new = added.names
    kinds = [to_arrow_type(field.dataType) for field in added]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = function(*[batch.column(i).to_pylist() for i in names])
            arrays = list(batch.columns) + [m if isinstance(m, pa.Array) else pa.array(m, kind) for m, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=keep + new)

    return frame.mapInArrow(batches, StructType(frame.schema.fields + added.fields))


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a worker process keeps for an operator; what it kept for others is dropped.

    Spark uses workers again, so without this they would hold the tables of every operator they ever ran.
    """
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
    return _KEPT[owner]


def parts_of(spark: SparkSession, per_partition: int = 4) -> int:
    """How many parts packed values are dealt to: some for each shuffle partition, so that they even out."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Split columns by part number; the order within a part is kept."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(part)]])):
        if b > a:
            yield int(part[a]), [c[a:b] for c in columns]


def packed_batch(rows: list[tuple[int, list[np.ndarray]]], names: Sequence[str], zipped: bool = False) -> pa.RecordBatch:
    """Rows (part, one binary per column) for the parts that :func:`dealt` gives.

    ``zipped`` values are compressed, so that files and shuffles are as large in the executor's memory as
    they look to Spark; their sizes follow in one more column, ``sizes``.
    """
    columns = {"part": pa.array([part for part, _ in rows], pa.int32())}
    packed = [[a.tobytes() for a in arrays] for _, arrays in rows]
    sizes = [np.array([len(x) for x in values], np.int64).tobytes() for values in packed]
    for k, name in enumerate(names):
        values = [v[k] for v in packed]
        columns[name] = pa.array([pa.compress(v, "zstd", asbytes=True) if v else v for v in values] if zipped else values, pa.binary())
    if zipped:
        columns["sizes"] = pa.array(sizes, pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def sizes_of(batch: pa.RecordBatch, name: str) -> list[int | None]:
    """Bytes of a packed column in each row before it was compressed; null where it was not."""
    names = batch.schema.names
    if "sizes" not in names:
        return [None] * batch.num_rows
    place = names.index(name) - names.index("part") - 1
    return [None if x is None else int(np.frombuffer(x, np.int64)[place]) for x in batch.column("sizes").to_pylist()]


def unpacked(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """All packed columns of a partition, put together."""
    found: dict[str, list[bytes]] = {name: [] for name in kinds}
    for batch in batches:
        for name in kinds:
            for value, size in zip(batch.column(name).to_pylist(), sizes_of(batch, name)):
                found[name].append(pa.decompress(value, size, "zstd", asbytes=True) if size else value)
    return {name: np.frombuffer(b"".join(found[name]), kind) for name, kind in kinds.items()}
