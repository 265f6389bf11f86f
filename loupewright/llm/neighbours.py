"""Nearest neighbours by multiprobe p-stable hashing (operator 9).

An index shard holds a share of the vectors in several hash tables. A hash is a tuple of floors of
random Gaussian projections. A query visits, in each table, its own bucket and perturbed ones, in the
order of the estimated chance to hold near vectors (least sum of squared distances to the borders
crossed). The candidates of all tables are merged, their exact scores computed, and the best of each
shard merged over the shards.

Largest inner products are least distances once every vector gets one more component that brings
it to the largest norm, while queries are scaled to that norm and get 0 there.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupewright.llm.common import table

TABLES, PROJECTIONS = 4, 7
#: Bucket width in deviations of a projection between a query and a vector (over the root of two), and
#: buckets visited per table.
WIDTH, PROBES = 1.6, 900
#: Vectors of the sample that sets the width, and vectors and queries in one block.
SAMPLE, SHARD, BLOCK = 4096, 16_384, 4096
SEED = 9

#: All perturbations by -1, 0 or +1 of each projection, and their steps down and up.
_STEPS = np.array(list(product((-1, 0, 1), repeat=PROJECTIONS)))
_DOWN, _UP = (_STEPS < 0).astype(float), (_STEPS > 0).astype(float)
_MOVES = (_STEPS << (9 * np.arange(PROJECTIONS))).sum(axis=1)
#: Queries that are looked up together, and the share of visited vectors from which all products with them
#: are computed at once, which costs less than to gather the vectors query by query.
TOGETHER, DENSE = 128, 1 / 8


class Tables:
    """The hash functions; all shards and queries use the same."""

    def __init__(self, dimension: int, norm: float, sample: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.norm = norm
        self.axes = rng.standard_normal((dimension + 1, TABLES * PROJECTIONS))
        apart = (self.lift(sample) - np.roll(self.aim(sample), 1, axis=0)) @ self.axes
        spread = np.sqrt((apart**2).mean(axis=0) / 2) if len(sample) > 1 else np.ones(TABLES * PROJECTIONS)
        self.width = WIDTH * np.where(spread > 0, spread, 1.0)
        self.shift = rng.random(TABLES * PROJECTIONS)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (vectors**2).sum(axis=1)))
        return np.column_stack([vectors, rest])

    def aim(self, queries: np.ndarray) -> np.ndarray:
        """Queries at the largest norm; their length changes no ranking."""
        return np.column_stack([queries * (self.norm / np.sqrt((queries**2).sum(axis=1)))[:, None], np.zeros(len(queries))])

    def places(self, lifted: np.ndarray) -> np.ndarray:
        """Position along each projection in bucket widths: rows x tables x projections."""
        return (lifted @ self.axes / self.width + self.shift).reshape(len(lifted), TABLES, PROJECTIONS)

    @staticmethod
    def codes(cells: np.ndarray) -> np.ndarray:
        """Cells as one number (equal cells have equal numbers; others differ within +-2^8 cells)."""
        return ((np.clip(cells, -255, 255).astype(np.int64) + 256) << (9 * np.arange(PROJECTIONS))).sum(axis=-1)

    def probes(self, queries: np.ndarray, count: int) -> np.ndarray:
        """The codes of the ``count`` best buckets to visit: queries x tables x codes."""
        at = self.places(self.aim(queries))
        cells, within = np.floor(at), at - np.floor(at)
        cost = (within**2) @ _DOWN.T + ((1 - within) ** 2) @ _UP.T
        if count < len(_STEPS):
            best = np.argpartition(cost, count - 1, axis=2)[:, :, :count]
        else:
            best = np.broadcast_to(np.arange(len(_STEPS)), cost.shape)
        if np.abs(cells).max(initial=0) < 255:  # the code of a sum is the sum of the codes
            return self.codes(cells)[:, :, None] + _MOVES[best]
        return self.codes(cells[:, :, None] + _STEPS[best])


def _in_shard(tables: Tables, base: pd.DataFrame, queries: pd.DataFrame, k: int, count: int) -> pd.DataFrame:
    """The k best candidates of one shard for one block of queries."""
    vectors = np.array(base["vector"].tolist(), float)
    codes = tables.codes(np.floor(tables.places(tables.lift(vectors))))
    buckets = [np.unique(codes[:, t], return_inverse=True) for t in range(TABLES)]
    ids = base["ids"].tolist()
    longest = np.sqrt((vectors**2).sum(axis=1).max())
    keys, asked = queries["query"].tolist(), np.array(queries["vector"].tolist(), float)
    out_query, out_id, out_score = [], [], []
    for start in range(0, len(asked), TOGETHER):
        some = asked[start : start + TOGETHER]
        hit = _visited(buckets, tables.probes(some, count))
        # Where the visited buckets hold too few, the rest of the shard is visited too.
        hit[hit.sum(axis=1) < k] = True
        products = some @ vectors.T if hit.mean() >= DENSE else None
        for i, query in enumerate(some):
            at = np.flatnonzero(hit[i])
            rough = vectors[at] @ query if products is None else products[i, at]
            if len(at) > k:  # all that can be among the k best in spite of rounding, however many tie
                error = 4 * (len(query) + 2) * np.finfo(float).eps * longest * np.sqrt(query @ query)
                at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 2 * error]
            exact = (vectors[at] * query).sum(axis=1)
            pairs = sorted((-s, i) for s, v in zip(exact, at) for i in ids[v])[:k]
            out_query += [keys[start + i]] * len(pairs)
            out_id += [i for _, i in pairs]
            out_score += [-s for s, _ in pairs]
    return pd.DataFrame({"query": out_query, "vec_id": out_id, "score": out_score}).astype(
        {"query": "int64", "vec_id": "int64", "score": "float64"}
    )


def _visited(buckets: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray) -> np.ndarray:
    """Queries x vectors: whether a vector's bucket (of each table: distinct codes, bucket of each vector) is among the wanted ones."""
    hit = np.zeros((len(wanted), len(buckets[0][1])), bool)
    for t, (distinct, bucket) in enumerate(buckets):
        query = np.repeat(np.arange(len(wanted)), wanted.shape[2])
        codes = wanted[:, t].ravel()
        place = np.minimum(np.searchsorted(distinct, codes), len(distinct) - 1)
        there = distinct[place] == codes
        chosen = np.zeros((len(wanted), len(distinct)), bool)
        chosen[query[there], place[there]] = True
        hit |= chosen[:, bucket]
    return hit


def usable(frame: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, not zero, and has finite components only, as array<double>."""
    doubles = F.col(vector).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = frame.where(F.col(vector).isNotNull() & F.forall(doubles, fine) & F.exists(doubles, lambda x: x != 0))
    return kept.withColumn(vector, F.transform(doubles, lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int = PROBES, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, itself left out.

    Both frames have ``vec_id`` and ``embedding``. Vectors that are null, zero or not finite take no
    part, nor do those of another length than most. Equal vectors are searched once and keep their
    k + 1 smallest ids, which is all that a ranking with ties to the smaller id can use. Repeated
    rows of an id and vector count once; null ids take no part. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    plain = usable(vectors.select("vec_id", F.col("embedding").alias("vector")).where("vec_id is not null"), "vector")
    sizes = plain.groupBy(F.size("vector").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")
    )
    most = sizes.orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], schema)
    one = plain.where(F.size("vector") == most.d).groupBy("vector", "vec_id").agg(F.count(F.lit(1)).alias("_n"))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    key = F.xxhash64("vector")
    distinct = (
        one.withColumn("_r", first).where(F.col("_r") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    sample = distinct.select("vector").orderBy(key).limit(SAMPLE).toPandas()["vector"]
    tables = spark.sparkContext.broadcast(Tables(most.d, most.norm, np.array(sample.tolist(), float).reshape(len(sample), most.d)))

    asked = usable(queries.select("vec_id", F.col("embedding").alias("vector")).where("vec_id is not null"), "vector")
    asked = asked.where(F.size("vector") == most.d).groupBy("vector", F.col("vec_id").alias("query_id")).agg(F.count(F.lit(1)).alias("_n"))
    keyed = asked.groupBy("vector").agg(F.min("query_id").alias("query"))
    shards, blocks = -(-most.n // shard), -(-keyed.count() // block)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    if not blocks:
        return spark.createDataFrame([], schema)
    left = distinct.select("vector", "ids", F.pmod(key, F.lit(shards)).cast("int").alias("shard"), every(blocks, "block"))
    right = keyed.select("vector", "query", F.pmod(key, F.lit(blocks)).cast("int").alias("block"), every(shards, "shard"))

    def search(base: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if base.empty or some.empty:
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype({"query": "int64", "vec_id": "int64"})
        return _in_shard(tables.value, base, some, k + 1, probes)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        search, "query long, vec_id long, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    owners = keyed.select("query", "vector").join(asked.select("vector", "query_id"), "vector").select("query", "query_id")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        owners.join(lists, "query")
        .select("query_id", F.posexplode(others).alias("place", "one"))
        .select("query_id", (F.col("place") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.s")).alias("score"))
    )


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
