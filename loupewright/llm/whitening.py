"""Whitening of embeddings from a bit-sliced scatter matrix (operator 12).

Entries become integers, floor(256 c). Each dimension is shifted to start at 0, and its bit planes are
packed across rows into 64-bit words: bit k of 64 rows is one word. A product of two dimensions summed
over the rows is then the sum over pairs of planes of 2^(a+b) times the number of rows that have both
bits, which is the popcount of an AND. So the scatter matrix is exact, and it is centred as integers
(n * sum(xy) - sum(x) * sum(y)) before anything becomes a double.

The fit list, each distinct integer vector once, is a grouped table; every task reduces its share of it
to d(d+1)/2 products, and only their sums, whose number depends on the dimension alone, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupewright.llm.common import stored, table

SCALE = 256.0
COMPONENTS = 4
#: Rows whose bit planes are in memory together.
BLOCK = 1 << 15
#: Sums leave the tasks as digits of this many bits, so that Spark can add them up as longs.
DIGIT, DIGITS = 40, 5


def entries(vector: str | Column, scale: float = SCALE) -> Column:
    """floor(scale * c) of each component, as longs; products beyond a long stay at its end."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(column.cast("array<double>"), lambda c: F.floor(c * F.lit(scale)) + F.lit(0).cast("bigint"))


def finite(frame: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds no null and no component that is not finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return frame.where(F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), fine))


def rows_of(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix of longs."""
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, width)


def planes(values: np.ndarray, low: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Packed bit planes of the shifted columns, lowest bit first: (sum of bits) x words."""
    shifted = values.astype(np.uint64) - low.astype(np.uint64)  # right modulo 2^64, also where a long would overflow
    made = np.zeros((int(bits.sum()), -(-len(values) // 64) * 8), np.uint8)
    row = 0
    for k, count in enumerate(bits):
        for bit in range(int(count)):
            packed = np.packbits((shifted[:, k] >> np.uint64(bit)).astype(np.uint8) & 1)
            made[row, : len(packed)] = packed
            row += 1
    return made.view(np.uint64)


def products(sliced: np.ndarray, bits: np.ndarray, into: np.ndarray) -> None:
    """Add the sums of products of every two dimensions to the upper triangle of ``into``.

    Row i gets, for each plane of dimension i, the popcounts of its AND with every plane of the
    dimensions from i on, weighted with both planes' powers of two.
    """
    starts = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
    used = np.flatnonzero(bits)  # a constant dimension has no planes and products of zero
    power = np.array([1 << int(p - starts[k]) for k in used for p in range(starts[k], starts[k + 1])], dtype=into.dtype)
    for i in used:
        rest = used[used >= i]
        after = starts[rest] - starts[i]
        for plane in range(starts[i], starts[i + 1]):
            counts = np.bitwise_count(sliced[starts[i] :] & sliced[plane]).sum(axis=1, dtype=np.int64)
            summed = np.add.reduceat(counts.astype(into.dtype, copy=False) * power[starts[i] :], after)
            into[i, rest] += summed * power[plane]


def sums(values: np.ndarray, low: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sum of each shifted column."""
    return np.array([sum(int(v) for v in column) if b > 40 else int(column.sum(dtype=np.uint64)) for column, b in
                     zip((values.astype(np.uint64) - low.astype(np.uint64)).T, bits)], dtype=object)


class Whitening:
    """Mean, components and integer sums of a fit list; small enough to be sent to every task."""

    def __init__(self, n: int, total: np.ndarray, scatter: np.ndarray, reach: int, components: int = COMPONENTS):
        """``total`` and ``scatter`` are exact integers: sums, and n^2 times the covariance; ``reach`` bounds |n x - total|."""
        self.n, self.total = n, total
        self.small = reach < 1 << 62 and len(total) * reach**2 < 1 << 63
        covariance = (scatter / (n * n)).astype(float)
        value, vector = np.linalg.eigh(covariance)
        order = np.argsort(-value, kind="stable")[:components]
        self.value, self.vector = value[order], vector[:, order]
        turn = self.vector[np.abs(self.vector).argmax(axis=0), np.arange(len(order))] < 0
        self.vector = np.where(turn, -self.vector, self.vector)
        trace = float(np.trace(covariance))
        self.explained = [float(e) / trace if trace > 0 else None for e in self.value]
        #: Components whose variance is more than rounding.
        self.real = self.value > (value.max(initial=0.0) * len(value) * np.finfo(float).eps)

    def deviations(self, values: np.ndarray) -> np.ndarray:
        """n x - total, exact."""
        kind = np.int64 if self.small else object
        return values.astype(kind) * (np.int64(self.n) if self.small else self.n) - self.total.astype(kind)

    def project(self, apart: np.ndarray) -> np.ndarray:
        """Whitened values of rows of :meth:`deviations`; NaN in components without variance."""
        centred = (apart / self.n).astype(float) @ self.vector
        return np.where(self.real, centred / np.sqrt(np.where(self.real, self.value, 1.0)), np.nan)

    def squares(self, apart: np.ndarray) -> pa.Array:
        """Sums of squares of rows of :meth:`deviations`; null where 38 digits do not hold them."""
        added = (apart * apart).sum(axis=1)
        if self.small:
            return pa.array(added, pa.int64()).cast(pa.decimal128(38, 0))
        from decimal import Decimal

        return pa.array([Decimal(int(a)) if a < 10**38 else None for a in added], pa.decimal128(38, 0))


def _bounds(fit: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest entry of each dimension."""

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in stream:
            if batch.num_rows:
                x = rows_of(batch, "x", width)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], ["dim", "low", "high"])

    found = fit.mapInArrow(partial, "dim long, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = found.orderBy("dim").toArrow()
    return rows["low"].to_numpy(), rows["high"].to_numpy()


def _scatter(fit: DataFrame, low: np.ndarray, bits: np.ndarray, block: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sums of the shifted dimensions and of their products, exact."""
    width = len(low)
    names = [f"d{k}" for k in range(DIGITS)]

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        # A long holds a block's products if two entries and the block's rows fit in it; blocks are added up beyond that.
        kind = np.int64 if 2 * int(bits.max(initial=0)) + int(block).bit_length() < 62 else object
        cross = np.zeros((width, width), object)
        for batch in stream:
            for start in range(0, batch.num_rows, block):
                x = rows_of(batch.slice(start, block), "x", width)
                some = np.zeros((width, width), kind)
                products(planes(x, low, bits), bits, some)
                n, total, cross = n + len(x), total + sums(x, low, bits), cross + some
        if not n:
            return
        i, j = (np.concatenate([a, b]) for a, b in zip(np.triu_indices(width), ([-1] * (width + 1), range(-1, width))))
        values = list(cross[np.triu_indices(width)]) + [n] + list(total)
        digits = [[v >> DIGIT * k & (1 << DIGIT) - 1 for v in values] for k in range(DIGITS)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (i, j, *digits)], ["i", "j", *names])

    found = fit.select("x").mapInArrow(partial, "i long, j long, " + ", ".join(f"{c} long" for c in names))
    rows = found.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    value = sum(rows[c].to_numpy().astype(object) << DIGIT * k for k, c in enumerate(names))
    cross = np.zeros((width, width), object)
    pair = i >= 0
    cross[i[pair], j[pair]] = cross[j[pair], i[pair]] = value[pair]
    total = np.zeros(width, object)
    total[j[~pair & (j >= 0)]] = value[~pair & (j >= 0)]
    return int(value[(i < 0) & (j < 0)][0]), total, cross


def fit(frame: DataFrame, vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> tuple[Whitening, DataFrame, int] | None:
    """The whitening of a table, its fit list (x) and the vectors' length; None if no vector remains.

    The fit list holds each distinct integer vector once, of vectors as long as most (the longer of
    equally frequent lengths). Repeats are dropped in each task before any vector is moved.
    """
    kept = finite(frame, vector).select(F.col(vector).alias("v"))
    most = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or most.d == 0:
        return None
    listed = stored(kept.where(F.size("v") == most.d).select(entries("v").alias("x")).distinct(), "fit")
    low, high = _bounds(listed, most.d)
    bits = np.array([(int(h) - int(l)).bit_length() for l, h in zip(low, high)])
    n, shifted, cross = _scatter(listed, low, bits, block)
    centred = n * cross - np.multiply.outer(shifted, shifted)
    total = shifted + n * low.astype(object)
    reach = max(max(abs(n * int(h) - int(s)), abs(n * int(l) - int(s))) for l, h, s in zip(low, high, total))
    return Whitening(n, total, centred, reach, components), listed, most.d


def identity_error(made: Whitening, listed: DataFrame, width: int) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity); None without variance."""
    count = int(made.real.sum())
    if not count:
        return None
    names = [f"w{k}" for k in range(count)]

    def projected(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            w = made.project(made.deviations(rows_of(batch, "x", width)))[:, made.real]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in w.T], names=names)

    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    white = listed.select("x").mapInArrow(projected, ", ".join(f"{c} double" for c in names))
    found = white.agg(*[F.covar_pop(names[a], names[b]) for a, b in pairs]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs))


def whiten(frame: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation (decimal(38,0)), whitened, explained, identity_error for each row and component.

    Rows whose vector is null, or holds nulls or components that are not finite, are left out; zero
    vectors stay. Rows of another length than most take no part in the fit and have a null deviation
    and null whitened values. Repeated rows, repeated and null ids all keep their rows. A component
    without variance has null whitened values, and a table without variance null ``explained`` and
    ``identity_error``. An empty table, or vectors of no components, give an empty result; further
    columns are not carried. A deviation of more than 38 digits is null.
    """
    spark, kind = frame.sparkSession, frame.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    narrow = frame.select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
    fitted = fit(narrow, "v", components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    made, listed, width = fitted
    error = identity_error(made, listed, width)
    count = len(made.value)

    def whitened(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows, fits = batch.num_rows, batch.column("x").value_lengths().to_numpy() == width
            x = batch.column("x").filter(pa.array(fits)).flatten().to_numpy().reshape(-1, width)
            apart = made.deviations(x)
            place = pa.array(np.repeat(np.cumsum(fits) - 1, count), mask=np.repeat(~fits, count))
            white = made.project(apart).ravel()
            values = np.full(rows * count, np.nan)
            values[np.repeat(fits, count)] = white
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(rows), count))),
                    pa.array(np.tile(np.arange(1, count + 1), rows), pa.int32()),
                    pa.array(np.full(rows * count, made.n)),
                    made.squares(apart).take(place),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(made.explained * rows, pa.float64()),
                    pa.array([error] * (rows * count), pa.float64()),
                ],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return finite(narrow, "v").select("id", entries("v").alias("x")).mapInArrow(whitened, schema)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
