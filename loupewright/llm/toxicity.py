"""Toxicity by FTRL-proximal logistic regression on hashed n-grams and skip-grams (operator 7).

A document is the set of its hashed words (whole, and cut to five bytes, which joins inflected
forms), word pairs and pairs with one word between. Each shard of
the labelled rows runs FTRL-proximal, whose learning rate is per coordinate and whose L1 term leaves
most coordinates at exactly zero; the shards' weights are averaged per coordinate. What is left is a
short list of weights, bounded by the number of coordinates, which is broadcast to score every text.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loupewright.llm.common import map_rows, remainder, table, whole_text

#: Coordinates are 2^BITS; this bounds what is collected and broadcast (at most 16 MB).
BITS = 20
STEM = 5
#: Labelled rows that are learnt from, chosen by a hash of their ids; all of them if there are fewer.
SAMPLE = 30_000
#: Rows that one shard learns from, and passes over them.
SHARD_ROWS, EPOCHS = 7_500, 3
#: Learning rate, its smoothing, and the L1 and L2 terms.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0

_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TO_SPACE = bytes(c if c >= 128 or bytes([c]) in _ALNUM else 32 for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def features(text: bytes) -> np.ndarray:
    """The coordinates of a text, with repeats; 0 is the bias and always there.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII bytes.
    """
    split = text.lower().translate(_TO_SPACE).split()
    words = np.array([xxh64_intdigest(w) for w in split], np.uint64)
    stems = np.array([xxh64_intdigest(w[:STEM], 1) for w in split], np.uint64)
    pairs = (words[:-1] * _MIX[0] + words[1:]) * _MIX[1]
    skips = (words[:-2] * _MIX[1] + words[2:]) * _MIX[2]
    places = np.concatenate([words * _MIX[0], stems * _MIX[0], pairs, skips]) >> np.uint64(64 - BITS)
    return np.append(places, np.uint64(0)).astype(np.int32)


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over (coordinates, label) rows; returns the dense weights."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        strong = np.abs(z[at]) > L1
        return np.where(strong, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(1 << BITS))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> dict[int, float]:
    """Weights by coordinate, from texts (doc_id, text) and labels (doc_id, toxic).

    Null labels and labels without a text take no part; an id with several labels counts as toxic if
    one says so, and of several texts of an id the least is read. ``sample`` ids are chosen while rows
    are still narrow. Without rows of both labels the result is empty.
    """
    by_id = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    hashed = by_id.withColumn("_h", F.xxhash64("doc_id", F.lit(7)))
    chosen = hashed.orderBy("_h", "doc_id").limit(sample)
    shards = max(1, -(-chosen.count() // shard_rows))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("_h", "toxic").agg(F.min("text").alias("text"))
    made = map_rows(
        texts.select("_h", "toxic", whole_text().alias("bytes")), ["bytes"], lambda b: [[np.unique(features(t)) for t in b]], "places array<int>"
    )
    spread = made.select("_h", "toxic", "places", F.pmod("_h", F.lit(shards)).cast("int").alias("shard"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_h", kind="stable")
        if group["toxic"].nunique() < 2:
            return pd.DataFrame({"place": [], "weight": []}).astype({"place": "int32", "weight": "float64"})
        w = train(list(zip(group["places"], group["toxic"])))
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at.astype(np.int32), "weight": w[at]})

    fitted = spread.groupBy("shard").applyInPandas(fit, "place int, weight double")
    summed = fitted.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).toPandas()
    return dict(zip(summed["place"].tolist(), summed["weight"].tolist()))


def score(docs: DataFrame, weights: dict[int, float], text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) to each document. Null texts count as empty; without weights all scores are 0."""
    plain = docs.drop("score")
    if not weights:
        return plain.withColumn("score", F.lit(0.0))
    places = np.array(sorted(weights), np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((places, np.array([weights[p] for p in places.tolist()])))

    def scores(texts: list) -> list:
        at, weight = sent.value
        dense = np.zeros(1 << BITS)
        dense[at] = weight

        def one(t: str | None) -> float:
            places = features((t or "").encode())
            total = dense[np.unique(places[dense[places] != 0])].sum()
            return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))

        return [[one(t) for t in texts]]

    return map_rows(plain, [text], scores, "score double")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    weights = learn(docs, table(spark, folder, "labels").where(remainder("doc_id") != 0))
    held = score(docs.select("doc_id", "text"), weights)
    return held.select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


