"""Ranked lexical search with document FP-trees (operator 13).

Documents are restricted to the terms that any query holds. A shard's restricted vectors, each in order
of falling document frequency, form a trie in which documents with the same frequent terms share their
path. Every node knows, for each term, the largest count below it, and the least length measure m; as a
score grows with counts and falls with m, these bound the score of all documents below. A query goes
down the tree depth first, best bound first, and leaves out what cannot reach its k best. A task carries
these over from shard to shard.

Only terms of queries, their document frequencies and weights are sent to the tasks: their number is
bounded by a block of queries, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from loupewright.llm.common import map_rows, stored, table, whole_text

K = 20
#: Documents and terms of a shard, documents below which a subtree is not split, cells of a tree's table of bounds.
SHARD, ENTRIES, LEAF, CELLS = 16_384, 4_000_000, 64, 1 << 23
#: Terms, repeats included, of the queries that are searched in one pass over the documents.
BLOCK = 1 << 18

#: Every byte that is no part of a term becomes a space; letters A to Z become lower case.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A to Z in lower case."""
    return text.translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's count adds to a score, for a weight of one; grows with the count, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def measures(lengths: list[int], documents: int, total: int) -> np.ndarray:
    """m of documents of these lengths; the product is formed without a limit."""
    return np.array([75 + 25 * n * documents // total for n in lengths], np.int64)


class Tree:
    """The trie of a shard, down to subtrees of few documents, with the bounds of its nodes.

    ``starts``, ``ranks``, ``tf`` are the documents' restricted vectors one after another (``starts`` has
    one more entry), at least one term each; ranks fall with document frequency. A node is a range of the
    documents in the order of their paths; children of a node stand side by side, and neighbouring
    children of few documents are one leaf.
    """

    def __init__(self, starts: np.ndarray, ranks: np.ndarray, tf: np.ndarray, m: np.ndarray, place: np.ndarray, leaf: int = LEAF):
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((ranks, owner))  # each document's terms in order of rank
        ranks, tf = ranks[order], tf[order]
        packed = ranks.astype(">u4").tobytes()
        paths = [packed[4 * a : 4 * b] for a, b in zip(starts.tolist(), starts[1:].tolist())]
        by_path = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        sizes = sizes[by_path]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        entry = np.repeat(starts[by_path] - self.starts[:-1], sizes) + np.arange(len(ranks))
        tf, m = tf[entry].astype(np.int64), m[by_path]
        #: Rows of the shard's documents in tree order, and their places in the order of ids.
        self.rows, self.place = by_path, place[by_path]
        self.known, self.column = np.unique(ranks[entry], return_inverse=True)
        self.gains = gain(tf, np.repeat(m, sizes))
        cells = max(1, CELLS // max(1, len(self.known)))
        self._grow(max(leaf, 2 * len(sizes) // cells + 1))
        self._bound(tf, m)

    def _grow(self, leaf: int) -> None:
        """Nodes breadth first: their documents [begin, end), and their children [first, last)."""
        count = len(self.starts) - 1
        begin, end, first, last = [0], [count], [0], [0]
        most = 4 * (count // leaf + 1)  # where paths leave one document at a time, the rest stays one leaf
        node = 0
        while node < len(begin):
            a, b = begin[node], end[node]
            if b - a > leaf and len(begin) < most:
                cuts = self._children(a, b)
                packed, at = [], a
                for stop, following in zip(cuts[1:], cuts[2:] + [None]):
                    if following is None or following - at > leaf:
                        packed.append((at, stop))
                        at = stop
                if len(packed) > 1:
                    first[node], last[node] = len(begin), len(begin) + len(packed)
                    for low, high in packed:
                        begin.append(low), end.append(high), first.append(0), last.append(0)
            node += 1
        self.begin, self.end, self.first, self.last = begin, end, first, last

    def _children(self, a: int, b: int) -> list[int]:
        """Borders between the documents [a, b) at the first place where their paths part."""
        one, other = (self.column[self.starts[k] : self.starts[k + 1]] for k in (a, b - 1))
        least = min(len(one), len(other))
        apart = np.flatnonzero(one[:least] != other[:least])
        depth = int(apart[0]) if len(apart) else least
        at = self.starts[a:b] + depth
        there = at < self.starts[a + 1 : b + 1]
        term = np.where(there, self.column[np.minimum(at, len(self.column) - 1)], -1)
        return [a, *(np.flatnonzero(np.diff(term)) + a + 1).tolist(), b]

    def _bound(self, tf: np.ndarray, m: np.ndarray) -> None:
        """For each node the largest counts and the least m below, as the largest gain of each term."""
        nodes = len(self.begin)
        leaves = np.array([k for k in range(nodes) if not self.last[k]])
        leaf_of = np.zeros(len(m), np.int64)
        for k in leaves:
            leaf_of[self.begin[k] : self.end[k]] = k
        most, least = np.zeros((nodes, len(self.known)), np.int64), np.full(nodes, np.iinfo(np.int64).max)
        np.maximum.at(most.reshape(-1), np.repeat(leaf_of, np.diff(self.starts)) * len(self.known) + self.column, tf)
        np.minimum.at(least, leaf_of, m)
        for k in reversed(range(nodes)):  # children stand behind their parents
            if self.last[k]:
                most[k] = most[self.first[k] : self.last[k]].max(axis=0)
                least[k] = least[self.first[k] : self.last[k]].min()
        self.bounds = gain(most, least[:, None])

    def search(self, ranks: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, row) of documents that score ``floor`` or more, the k best and more; ties to the smaller place."""
        at = np.minimum(np.searchsorted(self.known, ranks), len(self.known) - 1)
        here = self.known[at] == ranks
        if not here.any():
            return []
        columns, weights = at[here], weights[here]
        by_column = np.zeros(len(self.known), np.int64)
        by_column[columns] = weights
        best: list[tuple[int, int, int]] = []  # -score, place, row
        waiting = [(int(self.bounds[0, columns] @ weights), 0)]
        while waiting:
            bound, node = waiting.pop()
            if bound < floor:
                continue
            if self.last[node]:
                below = self.bounds[self.first[node] : self.last[node]][:, columns] @ weights
                for child in np.argsort(below, kind="stable").tolist():  # the best bound is popped first
                    if below[child] >= floor:
                        waiting.append((int(below[child]), self.first[node] + child))
                continue
            a, b = self.begin[node], self.end[node]
            low, high = self.starts[a], self.starts[b]
            scores = np.add.reduceat(by_column[self.column[low:high]] * self.gains[low:high], self.starts[a:b] - low)
            found = np.flatnonzero(scores >= floor)
            if len(found) > k:
                found = found[np.lexsort((self.place[a:b][found], -scores[found]))[:k]]
            best += zip((-scores[found]).tolist(), self.place[a:b][found].tolist(), self.rows[a:b][found].tolist())
            if len(best) >= k:
                best.sort()
                del best[k:]
                floor = max(floor, -best[-1][0])
        return [(-score, row) for score, _, row in best]


class Searcher:
    """A block of queries with what scoring needs of the whole table: (key, ranks, weights) each."""

    def __init__(self, queries: list[tuple[int, np.ndarray, np.ndarray]], ranks: np.ndarray, documents: int, total: int, k: int):
        self.queries, self.ranks, self.documents, self.total, self.k = queries, ranks, documents, total, k

    def run(self, batches: Iterator[pa.RecordBatch], shard: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {key: [] for key, _, _ in self.queries}
        held: list[pa.RecordBatch] = []
        size = entries = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                held.append(some)
                size, entries = size + some.num_rows, entries + len(some.column("terms").flatten())
                if size >= shard or entries >= ENTRIES:
                    self._shard(pa.Table.from_batches(held).combine_chunks(), best)
                    held, size, entries = [], 0, 0
        if held:
            self._shard(pa.Table.from_batches(held).combine_chunks(), best)
        rows = [(key, None if unknown else i, -score) for key, found in best.items() for score, unknown, i in found]
        if rows:
            key, doc_id, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc_id, kind), pa.array(score, pa.int64())], ["row", "doc_id", "score"])

    def _shard(self, docs: pa.Table, best: dict[int, list[tuple]]) -> None:
        lists = docs["terms"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ids = docs["doc_id"]
        place = np.empty(len(ids), np.int64)
        place[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        m = measures(docs["n"].to_pylist(), self.documents, self.total)
        tree = Tree(starts, self.ranks[lists.flatten().to_numpy()], docs["tfs"].combine_chunks().flatten().to_numpy(), m, place)
        for key, ranks, weights in self.queries:
            known = best[key]
            floor = max(1, -known[-1][0]) if len(known) == self.k else 1
            found = tree.search(ranks, weights, self.k, floor)
            if found:
                for score, row in found:
                    i = ids[row].as_py()
                    known.append((-score, i is None, 0 if i is None else i))
                known.sort(key=lambda e: (e[0], e[1], e[2]) if not e[1] else (e[0], True))
                del known[self.k :]


def term_vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), and of the vocabulary's terms in the text their numbers and counts.

    ``vocabulary`` is a broadcast dictionary from terms (bytes) to numbers from 0 on.
    """

    def counted(texts: list) -> list:
        number = vocabulary.value.get
        lengths, sizes, terms, tfs = [], [], [], []
        for text in texts:
            found = terms_of(text)
            counts = Counter(map(number, found))
            counts.pop(None, None)
            lengths.append(len(found))
            sizes.append(len(counts))
            terms += counts
            tfs += counts.values()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, kind)) for v, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
        return [lengths, *lists]

    bare = docs.select("doc_id", whole_text().alias("text"))
    return map_rows(bare, ["text"], counted, "n long, terms array<int>, tfs array<long>").drop("text")


def _document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in stream:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], ["term", "df"])

    rows = vectors.select("terms").mapInArrow(partial, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    held = np.zeros(size, np.int64)
    held[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return held


def rank(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not used. Equal scores
    come in ascending order of doc_id, null ids last. Null and empty texts have no terms: such documents
    do not count and such items find nothing. Repeated rows of documents are documents of their own, and
    repeated rows of items are ranked each. An empty table on either side gives an empty result. Items
    are searched in blocks of about ``block`` terms, each in one pass over all documents.
    """
    spark = docs.sparkSession
    numbered = stored(items.select("item_id", "text").withColumn("row", F.monotonically_increasing_id()), "items")

    def counted(texts: list) -> list[list]:
        found = [Counter(terms_of(t)) for t in texts]
        return [[list(f) for f in found], [list(f.values()) for f in found]]

    asked = map_rows(numbered.select("row", whole_text().alias("text")), ["text"], counted, "terms array<binary>, counts array<long>")
    asked = stored(asked.drop("text").where(F.size("terms") > 0), "asked")
    blocks = -(-(asked.agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c))).first()[0] or 0) // block)
    kind = docs.schema["doc_id"].dataType
    if not blocks:
        item_id = numbered.schema["item_id"]
        return spark.createDataFrame([], StructType([item_id, *StructType.fromDDL("rank int"), StructField("doc_id", kind), *StructType.fromDDL("score long")]))
    found = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()
        part = _search(docs, some, k, shard) if some else None
        found = part if found is None else found if part is None else found.union(part)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(numbered.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, items: list, k: int, shard: int) -> DataFrame:
    """row, doc_id, score: for each item the k best of every task."""
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    for item in items:
        for term in item.terms:
            numbers.setdefault(bytes(term), len(numbers))
    vectors = stored(term_vectors(docs, spark.sparkContext.broadcast(numbers)), "vectors")
    whole = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total")).first()
    held = _document_counts(vectors, len(numbers))
    ranks = np.empty(len(numbers), np.int64)
    ranks[np.lexsort((np.arange(len(numbers)), -held))] = np.arange(len(numbers))
    queries = []
    for item in items:
        at = np.array([numbers[bytes(t)] for t in item.terms])
        weights = np.array([weight(whole.documents, int(held[i])) * c for i, c in zip(at, item.counts)], np.int64)
        queries.append((item.row, ranks[at], weights))
    searcher = spark.sparkContext.broadcast(Searcher(queries, ranks, whole.documents, whole.total or 0, k))
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def best(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from searcher.value.run(stream, shard, arrow)

    schema = StructType([*StructType.fromDDL("row long"), StructField("doc_id", kind), *StructType.fromDDL("score long")])
    return vectors.where(F.size("terms") > 0).mapInArrow(best, schema)


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS all_documents, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(all_documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, whole GROUP BY term
),
scored AS (
    SELECT item_id, doc_id,
           CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_documents) // all_terms)))) AS BIGINT) AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole
    GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {K}
"""
