"""Near-duplicates by SimHash fingerprints and pigeonhole blocks (operator 6).

A fingerprint is cut into blocks. If two differ in at most d bits, at least (blocks - d) blocks are
the same in both, so the pair meets under the key of that choice of blocks. Each key's members are
compared there by Hamming distance, and only a spanning forest of the links found leaves the task.
A key with very many members is split into chunks, and each pair of chunks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loupewright.llm.common import dealt, map_rows, packed_batch, parts_of, stored, table, unpacked
from loupewright.llm.components import connected

SEED = 42
#: Blocks of a 64-bit word, and how many of them make a key (about 21 bits).
BLOCKS, AGREE = 6, 2
#: Members of a key that are compared in one task.
TILE = 2048

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

def _masks() -> np.ndarray:
    edges = np.linspace(0, 64, BLOCKS + 1).round().astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return np.array([sum(blocks[k] for k in chosen) for chosen in combinations(range(BLOCKS), AGREE)], np.uint64)


MASKS = _masks()


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths).tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops[width - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, width: int = 4, words: int = 1) -> bytes:
    """Words of 64 bits; a bit is set where over half of the hashes have it set. All zero without words."""
    return _majority(shingle_hashes(text, width), words)


def _majority(hashes: np.ndarray, words: int) -> bytes:
    made = np.zeros(words * 64, np.uint8)
    for k in range(words if len(hashes) else 0):
        mixed = hashes
        if k:  # further words come from further mixes of the same hashes
            mixed = (hashes ^ (_MIX[:1] * np.uint64(k))) * _MIX[1]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]
            mixed ^= mixed >> np.uint64(32)
        counts = np.zeros(64, np.int64)
        for i in range(0, len(mixed), 1 << 16):
            some = mixed[i : i + (1 << 16)]
            counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        made[64 * k : 64 * k + 64] = 2 * counts > len(mixed)
    return np.packbits(made, bitorder="little").tobytes()


def with_prints(docs: DataFrame, text: str = "text", width: int = 4, words: int = 1) -> DataFrame:
    """Add ``print`` (binary fingerprint) to each document; null and empty texts have all bits zero."""
    return map_rows(docs, [text], lambda texts: [[fingerprint((t or "").encode(), width, words) for t in texts]], "print binary")


def forest(prints: np.ndarray, limit: int) -> np.ndarray:
    """For each row of 64-bit words the first row of its component under Hamming distance <= limit.

    A breadth-first search that compares each row with the rows not yet reached.
    """
    n = len(prints)
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        seed, left = left[0], left[1:]
        root[seed], queue = seed, [seed]
        while queue and len(left):
            near = np.bitwise_count(prints[left] ^ prints[queue.pop()]).sum(axis=1, dtype=np.int64) <= limit
            if near.any():
                root[left[near]] = seed
                queue += left[near].tolist()
                left = left[~near]
    return root


def _block_keys(words: np.ndarray) -> np.ndarray:
    """A key for each choice of blocks in each word: rows x keys."""
    salt = np.arange(words.shape[1] * len(MASKS), dtype=np.uint64).reshape(words.shape[1], -1)
    keys = ((words[:, :, None] & MASKS) ^ (salt * _MIX[1])) * _MIX[0]
    return ((keys ^ (keys >> np.uint64(31))) * _MIX[1]).reshape(len(words), -1)


def _packed_keys(node: np.ndarray, keys: np.ndarray, parts: int) -> pa.RecordBatch:
    owner = np.repeat(node, keys.shape[1])
    keys = keys.ravel()
    return packed_batch(list(dealt((keys >> np.uint64(33)) % np.uint64(parts), keys, owner)), ["key", "node"])


def _several(stream: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, node and number of members for the keys with several members, in ascending order of the key."""
    got = unpacked(stream, {"key": np.uint64, "node": np.uint64})
    order = np.argsort(got["key"], kind="stable")
    keys, node = got["key"][order], got["node"][order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    several = size > 1
    return keys[several], node[several], size[several]


def _tiled(keys: np.ndarray, node: np.ndarray, size: np.ndarray, tile: int) -> Iterator[pa.RecordBatch]:
    """key, tile, node: each pair of a key's members is in a tile of at most about twice ``tile`` members."""
    chunks = -(-size // tile)
    chunk = ((node * _MIX[0]) >> np.uint64(33)).astype(np.int64) % chunks
    for k in range(int(chunks.max(initial=0))):  # a member of chunk c is in the tiles (c, k), both ways round
        on = chunks > k
        low, high = np.minimum(chunk[on], k), np.maximum(chunk[on], k)
        for i in range(0, len(low), 1 << 16):
            some = slice(i, i + (1 << 16))
            yield _longs([keys[on][some], low[some] * (1 << 31) + high[some], node[on][some]], ["key", "tile", "node"])


def _longs(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64), pa.int64()) for c in columns], names=names)


def _groups(stream: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of the rows of whole (key, tile) groups; the last column is binary and becomes rows of words."""
    held: list[np.ndarray] | None = None
    for batch in stream:
        if not batch.num_rows:
            continue
        *plain, packed = batch.columns
        now = [c.to_numpy() for c in plain]
        now.append(np.frombuffer(b"".join(packed.to_pylist()), np.uint64).reshape(batch.num_rows, -1))
        if held is not None:
            now = [np.concatenate(pair) for pair in zip(held, now)]
        new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        held = [a[new[-1] :] if len(new) else a for a in now]
        if len(new):
            yield [a[: new[-1]] for a in now]
    if held is not None:
        yield held


def links(nodes: DataFrame, limit: int, tile: int = TILE) -> DataFrame:
    """u, v: edges that connect what links of at most ``limit`` differing bits connect.

    ``nodes`` has ``node`` (long, unique) and ``print`` (binary, unique). All such links are found for
    one word and a limit of up to BLOCKS - AGREE.
    """
    parts = parts_of(nodes.sparkSession)

    def keyed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                node = np.array(batch.column(0).to_pylist(), np.uint64)
                words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(node), -1)
                yield _packed_keys(node, _block_keys(words), parts)

    def shared(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tiled(*_several(stream), tile)

    def compared(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(stream):
            yield _edges(rows, limit)

    tiles = (
        nodes.select("node", "print").mapInArrow(keyed, "part int, key binary, node binary").repartition("part")
        .mapInArrow(shared, "key long, tile long, node long")
    )
    spread = tiles.join(nodes.select("node", "print"), "node").select("key", "tile", "node", "print")
    return spread.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(compared, "u long, v long")


def _edges(rows: list[np.ndarray], limit: int) -> pa.RecordBatch:
    """Edges from each node to the root of its component within its (key, tile)."""
    key, place, node, words = rows
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]))
    sizes = np.diff(np.append(starts, len(key)))
    u, v = [], []
    pairs = starts[sizes == 2]  # most keys have two members
    near = np.bitwise_count(words[pairs] ^ words[pairs + 1]).sum(axis=1, dtype=np.int64) <= limit
    u.append(node[pairs[near]])
    v.append(node[pairs[near] + 1])
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        own = node[start : start + size]
        root = forest(words[start : start + size], limit)
        linked = root != np.arange(size)
        u.append(own[linked])
        v.append(own[root[linked]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()) for a in (u, v)], names=["u", "v"])


def _place() -> Column:
    """The order of documents; null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")


def _least(nodes: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
    """The columns of each node, and first: the least document of its component."""
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return rooted.join(least, "root").select(*columns, F.col("least").alias("first"))


def grouped(marked: DataFrame, limit: int) -> DataFrame:
    """print, first (struct of doc_id and row): the least document of each fingerprint's component.

    ``marked`` has doc_id, row (unique) and print. Null ids come last.
    """
    nodes = stored(marked.groupBy("print").agg(F.min(_place()).alias("first")).withColumn("node", F.col("first.row")), "prints")
    return _least(nodes, connected(links(nodes, limit)), "print")


def _hexadecimal(words: int) -> Column:
    """The words as hexadecimal digits, highest digit first within each."""
    digits = [F.substring(F.hex("print"), 16 * k + 2 * b + 1, 2) for k in range(words) for b in reversed(range(8))]
    return F.lower(F.concat(*digits))


def components(docs: DataFrame, limit: int = 4, width: int = 4, words: int = 1) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id: the least doc_id that links reach.

    Fingerprints of up to ``limit`` = BLOCKS - AGREE differing bits are all found. Texts without words
    have fingerprint zero and are linked like any other; null texts are texts without words. Repeated
    rows appear each. An empty table gives an empty result; further columns are not carried.
    """
    narrow = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    marked = stored(with_prints(narrow, "text", width, words).drop("text"), "fingerprints")
    named = marked.join(grouped(marked, limit), "print")
    return named.select("doc_id", _hexadecimal(words).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_copies(docs: DataFrame, limit: int = 4, width: int = 4) -> DataFrame:
    """The least document (by doc_id) of each component of fingerprints; all columns are kept.

    Null ids come last. Null, empty and blank texts have fingerprint zero and are one group. Of repeated
    rows one stays. An empty table stays empty. Columns may have any names.
    """
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, doc_id = (f"c{docs.columns.index(c)}" for c in ("text", "doc_id"))
    marked = stored(with_prints(plain.withColumn("row", F.monotonically_increasing_id()), text, width), "marked")
    first = grouped(marked.select(F.col(doc_id).alias("doc_id"), "row", "print"), limit)
    kept = first.select(F.col("first.row").alias("row")).distinct()
    return marked.join(kept, "row", "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return components(table(spark, folder, "documents"))
