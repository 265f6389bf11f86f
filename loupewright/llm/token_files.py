"""Token ids in files of independent zstandard frames with a seek table (operator 4).

A file holds one frame for each document, in ascending order of ids, then two skippable frames: an
index (document ids and token counts) and, last, the seek table of the public seekable format: for
each frame its compressed and its plain size and the low 32 bits of the XXH64 of the plain bytes. A
plain zstandard decoder reads such a file as the concatenation of all ids; a reader that wants some
documents reads the two tables from the end and then only the frames it needs.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loupewright.llm.common import stored, table, work_folder
from loupewright.llm.pieces import library_coder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
LEVEL = 3

#: Fixed values of the seekable format.
_SKIPPABLE_SEEK, _SKIPPABLE_INDEX, _SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_CHECKSUMS = 0x80
_ENTRY, _FOOTER = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")]), struct.Struct("<IBI")
_INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("frames", "<u4"), ("tokens", "<u8")])
_HEAD = struct.Struct("<II")
#: A document's ids are cut into frames of at most this many bytes, as sizes have 32 bits.
FRAME = 1 << 24


class Writer:
    """Appends documents to an open binary file; ``close`` adds the tables."""

    def __init__(self, sink, level: int = LEVEL):
        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, packed_ids: bytes) -> None:
        parts = [packed_ids[i : i + FRAME] for i in range(0, len(packed_ids), FRAME)] or [b""]
        for part in parts:
            frame = self.pack.compress(part)
            self.sink.write(frame)
            self.entries.append((len(frame), len(part), xxh64_intdigest(part) & 0xFFFFFFFF))
        self.index.append((doc_id is not None, doc_id or 0, len(parts), len(packed_ids) // 4))

    def close(self) -> None:
        body = np.array(self.index, _INDEX).tobytes()
        self.sink.write(_HEAD.pack(_SKIPPABLE_INDEX, len(body)) + body)
        seek = np.array(self.entries, _ENTRY).tobytes() + _FOOTER.pack(len(self.entries), _CHECKSUMS, _SEEK_MAGIC)
        self.sink.write(_HEAD.pack(_SKIPPABLE_SEEK, len(seek)) + seek)
        self.sink.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        frames, flags, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != _SEEK_MAGIC or not flags & _CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        seek = size - _FOOTER.size - frames * _ENTRY.itemsize - _HEAD.size
        self.entries = np.frombuffer(self._read(seek + _HEAD.size, frames * _ENTRY.itemsize), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        _, length = _HEAD.unpack(self._read(int(self.starts[-1]), _HEAD.size))
        self.index = np.frombuffer(self._read(int(self.starts[-1]) + _HEAD.size, length), _INDEX)
        self.first = np.concatenate([[0], np.cumsum(self.index["frames"], dtype=np.int64)])
        self.tokens_before = np.concatenate([[0], np.cumsum(self.index["tokens"], dtype=np.int64)])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, place: int) -> int | None:
        return int(self.index["doc_id"][place]) if self.index["known"][place] else None

    def places(self, doc_id: int) -> list[int]:
        return np.flatnonzero((self.index["known"] == 1) & (self.index["doc_id"] == doc_id)).tolist()

    def packed_ids(self, place: int) -> bytes:
        """The ids of the document at that place, from its own frames alone, checked."""
        parts = []
        for k in range(int(self.first[place]), int(self.first[place + 1])):
            plain_size = int(self.entries["plain"][k])
            frame = self._read(int(self.starts[k]), int(self.entries["packed"][k]))
            plain = self.unpack.decompress(frame, max_output_size=plain_size) if plain_size else b""
            if len(plain) != plain_size or xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.entries["check"][k]):
                raise ValueError(f"frame {k} is damaged")
            parts.append(plain)
        return b"".join(parts)


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, files: int | None = None) -> DataFrame:
    """Encode and write all documents; returns the manifest: shard, path, n_docs, n_tokens.

    Documents are range-partitioned and sorted by doc_id (null first), ties by text, so the files in
    order of their shard are in ascending order. Null and empty texts have the end id alone. Repeated
    rows are written each; a row number spreads a doc_id that very many rows share. A file whose task
    was lost or run twice is not in the manifest, which alone says what counts. An empty table gives
    an empty manifest. Other columns are not written.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    count = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("doc_id"), F.col("_tie"), F.col("_row")]
    ranged = plain.repartitionByRange(count, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = library_coder(path), struct.pack("<I", END_ID)
        system, base = fs.FileSystem.from_uri(folder)
        shard, writer, name, total = TaskContext.get().partitionId(), None, "", 0
        for batch in stream:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    system.create_dir(base, recursive=True)
                    name = f"{base}/ids-{shard:06d}-{uuid.uuid4().hex}.zst"
                    writer = Writer(system.open_output_stream(name, compression=None))
                ids = b"".join(coder.encode(text)[1]) + end
                total += len(ids) // 4
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [f"{folder}/{name.rpartition('/')[2]}"], "n_docs": [len(writer.index)], "n_tokens": [total]}
            )

    return stored(ranged.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "manifest")


def documents_in(path: str, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, tokens before it in the file, packed ids) of the wanted documents, or of all."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as source:
        reader = Reader(source)
        places = range(len(reader)) if wanted is None else sorted(p for w in set(wanted) for p in reader.places(w))
        for place in places:
            yield reader.doc_id(place), int(reader.tokens_before[place]), reader.packed_ids(place)


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The window runs over one row per file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = based.select("path", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(d, base + at, len(ids) // 4, zlib.crc32(ids)) for d, at, ids in documents_in(path)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_ids(write_ids(table(spark, folder, "documents"), work_folder(spark, "token-files")))
