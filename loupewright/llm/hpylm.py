"""Language-model scores of a hierarchical Pitman-Yor model (operator 1).

A token's context is the word before it (the end token before the first). Each context has a Chinese
restaurant whose tables serve tokens; contexts whose words end in the same three bytes share a parent
restaurant, and those share the root, so unseen words still have an informed context. A table of a
child is a customer of its parent. Restaurants are addressed by a hash of fixed width (2^18 contexts
under 2^12 parents), so every context is covered and what is sent to all tasks has a fixed size.

Seating is sampled by Gibbs sweeps: a sweep takes all customers of a token out of a restaurant, and
their tables out of the restaurant above, and draws a new number of tables by its chance given all
other tables (:mod:`loupewright.llm.seating`). A task holds all restaurants' tables of
its share of the tokens. After each sweep the totals of contexts, parents and root are summed over all
tasks, and every task takes these for its next sweep. After the burn-in several seatings are kept, and
their predictive probabilities are averaged.

Counts are added up in each batch before they move. Texts are scored by sending each batch's tokens
to where their restaurants are; frequent tokens are spread over several copies of theirs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loupewright.llm.common import dealt, packed_batch, parts_of, remainder, sizes_of, table, unpacked, whole_text, work_folder
from loupewright.llm.seating import draw, seatings

#: Address widths of contexts and of their parents.
CONTEXT_BITS, PARENT_BITS = 18, 12
_CONTEXTS, _PARENTS = 1 << CONTEXT_BITS, 1 << PARENT_BITS
_WITHIN = CONTEXT_BITS - PARENT_BITS
#: Sweeps before seatings are kept, and seatings kept.
BURN_IN, SEATINGS = 3, 3
#: Concentrations of contexts, parents and root.
THETA = (1.0, 1.0, 1.0)
#: Bytes and number of texts that are put together in one step of a task.
STEP, STEP_TEXTS = 2 << 20, 20_000
SEED = 1
#: Slices of the contexts whose totals are summed apart.
SLICES = 16

#: The end token; no word has a space.
_END = b" end"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


_EMPTY = _mixed(np.zeros(1, np.uint64))[0]


def _put_together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens in ascending order, (place there, context) of each token as one number, and its text's number.

    Each distinct word is hashed once.
    """
    places: defaultdict[bytes, int] = defaultdict()
    places.default_factory = places.__len__
    places[_END]  # noqa: B018 - the first
    found: list[int] = []
    lengths = []
    for text in texts:
        words = text.lower().split()
        words.append(_END)
        found.extend(map(places.__getitem__, words))
        lengths.append(len(words))
    words = list(places)
    hashes = np.array([xxh64_intdigest(w, SEED) for w in words], np.uint64)
    endings = np.full(len(words), _EMPTY)
    tails = np.frombuffer(b"".join([w[-3:].rjust(3, b" ") for w in words[1:]]), np.uint8).reshape(-1, 3).astype(np.uint64)
    endings[1:] = _mixed(tails[:, 0] + (tails[:, 1] << np.uint64(8)) + (tails[:, 2] << np.uint64(16)) + np.uint64(1))
    parent = endings >> np.uint64(64 - PARENT_BITS)
    address = ((parent << np.uint64(_WITHIN)) | (_mixed(hashes) >> np.uint64(64 - _WITHIN))).astype(np.int64)
    tokens, rank = np.unique(hashes, return_inverse=True)
    place = np.array(found, np.int64)
    before = np.zeros_like(place)  # the first word of a text comes after the end of the one before
    before[1:] = place[:-1]
    pair = (rank.astype(np.int64) << CONTEXT_BITS)[place] | address[before]
    return tokens, pair, np.repeat(np.arange(len(texts), dtype=np.int64), lengths)


def _apart(tokens: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and contexts of the numbers of :func:`_put_together`."""
    return tokens[pair >> CONTEXT_BITS], (pair & (_CONTEXTS - 1)).astype(np.int32)


def _tokens_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of one text (hashes, the end last) and the context address of each."""
    tokens, pair, _ = _put_together([text])
    return _apart(tokens, pair)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of about ``STEP`` bytes, and at most ``STEP_TEXTS`` texts, at a time."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= STEP or len(texts) >= STEP_TEXTS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _by_pair(token: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n for each (token, context), in ascending order of both."""
    order = np.lexsort((context, token))
    token, context, n = token[order], context[order], n[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (context[1:] != context[:-1])
    first = np.flatnonzero(new)
    return token[first], context[first], np.add.reduceat(n, first) if len(first) else n


def _starts(token: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)


def _discount(one: float, two: float) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one and two else 0.5


class Share:
    """The restaurants' seats for some of the tokens: (token, context) pairs in ascending order."""

    def __init__(self, token: np.ndarray, context: np.ndarray, n: np.ndarray):
        self.token, self.context, self.n = token, context.astype(np.int64), n.astype(np.int64)
        self.first = _starts(token)
        self.of_token = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        parent = self.of_token * _PARENTS + (self.context >> _WITHIN)
        self.parent_key, self.of_parent = np.unique(parent, return_inverse=True)  # ascending, as the pairs are
        self.parent = self.parent_key % _PARENTS
        self.token_of_parent = self.parent_key // _PARENTS

    def customers(self, tables: np.ndarray) -> np.ndarray:
        """Customers of the parents' dishes, which are the contexts' tables."""
        return np.bincount(self.of_parent, tables, len(self.parent_key)).astype(np.int64)

    def root_customers(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.token_of_parent, tables, len(self.first)).astype(np.int64)

    def sweep(
        self, a: np.ndarray, b: np.ndarray, c: np.ndarray, all_: Sums, rng: np.random.Generator, discounts: tuple | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables in contexts, parents and root after a sweep; ``all_``: totals of the seating before, over all tokens.

        All customers of a dish are taken out of their restaurant and with them its tables, which are
        customers of the restaurant above, from every total; then a number of tables is drawn given the
        tables of all other dishes and of the restaurants above. Dishes are drawn in two random halves, the
        second given the first.
        """
        da, db, dr = discounts or (_discount(*two) for two in all_.ones)
        a, b, at_context, at_parent = a.copy(), b.copy(), all_.tables_a.copy(), all_.tables_b.copy()
        below = at_context.reshape(_PARENTS, -1).sum(axis=1)  # customers of the parents
        up = self.context >> _WITHIN
        for on in _halves(np.flatnonzero(self.n > 1), rng):  # one customer has one table
            context, parent, old, dish = self.context[on], up[on], a[on], self.of_parent[on]
            others = at_context[context] - old
            size, guests, served = below[parent] - old, self.customers(a)[dish] - old, b[dish]

            def passed(i, k):
                price = seatings(db).one_more_customer(guests[i] + k, served[i])
                return price + np.log(THETA[0] + da * (others[i] + k)) - np.log(THETA[1] + size[i] + k)

            new = draw(self.n[on], served - guests, seatings(da), passed, rng)
            a[on] = new
            np.add.at(at_context, context, new - old)
            np.add.at(below, parent, new - old)
        customers, size_r = self.customers(a), int(at_parent.sum())
        for on in _halves(np.flatnonzero((customers > 1) | (b > 1)), rng):
            parent, old, dish = self.parent[on], b[on], self.token_of_parent[on]
            others, guests, served = at_parent[parent] - old, self.root_customers(b)[dish] - old, c[dish]

            def passed(i, k):
                price = seatings(dr).one_more_customer(guests[i] + k, served[i])
                return price + np.log(THETA[1] + db * (others[i] + k)) - np.log(THETA[2] + size_r - old[i] + k)

            new = draw(customers[on], served - guests, seatings(db), passed, rng)
            b[on] = new
            np.add.at(at_parent, parent, new - old)
            size_r += int((new - old).sum())
        left = all_.tables_r - c

        def started(i, k):
            return np.log((THETA[2] + dr * (left[i] + k)) / (all_.vocabulary + 1))

        return a, b, draw(self.root_customers(b), np.ones(len(c), np.int64), seatings(dr), started, rng)


def _halves(places: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    first = rng.random(len(places)) < 0.5
    return [places[first], places[~first]]


class Sums:
    """Totals of one seating, of fixed size; those of several shares of the tokens add up."""

    def __init__(self):
        self.size = np.zeros(_CONTEXTS, np.int64)  # customers of each context
        self.tables_a = np.zeros(_CONTEXTS, np.int64)
        self.tables_b = np.zeros(_PARENTS, np.int64)
        self.ones = np.zeros((3, 2))  # dishes with one and two customers at each level
        self.tables_r = self.vocabulary = self.tokens = 0

    def add(self, share: Share, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        np.add.at(self.size, share.context, share.n)
        np.add.at(self.tables_a, share.context, a)
        np.add.at(self.tables_b, share.parent, b)
        for level, customers in enumerate((share.n, share.customers(a), share.root_customers(b))):
            self.ones[level] += (customers == 1).sum(), (customers == 2).sum()
        self.tables_r += int(c.sum())
        self.vocabulary += len(share.first)
        self.tokens += int(share.n.sum())

    def rows(self) -> list[tuple[int, list[np.ndarray]]]:
        """One row per slice of contexts, and one for the rest."""
        sliced = np.stack([self.size, self.tables_a]).reshape(2, SLICES, -1)
        packed = [(sliced[:, k], _NOTHING) for k in range(SLICES)]
        packed.append((self.tables_b, np.array([*self.ones.ravel(), self.tables_r, self.vocabulary, self.tokens], float)))
        return [(k, [_NOTHING, _NOTHING, _NOTHING, n, *[_NOTHING] * 3, few, _NOTHING, _NOTHING]) for k, (n, few) in enumerate(packed)]

    def take(self, k: int, n: bytes, few: bytes) -> None:
        """The values of a row."""
        values = np.frombuffer(n, np.int64)
        if k < SLICES:
            step = _CONTEXTS // SLICES
            self.size[k * step : (k + 1) * step], self.tables_a[k * step : (k + 1) * step] = values.reshape(2, -1)
        else:
            numbers = np.frombuffer(few, np.float64)
            self.tables_b, self.ones = values, numbers[:6].reshape(3, 2)
            self.tables_r, self.vocabulary, self.tokens = (int(x) for x in numbers[6:])


class Totals:
    """What the predictive probabilities need of all tokens, for each kept seating; of fixed size."""

    def __init__(self, kept: list[Sums]):
        last = kept[-1]
        self.size = last.size.astype(float)
        self.tables_a = np.stack([k.tables_a for k in kept]).astype(float)
        self.tables_b = np.stack([k.tables_b for k in kept]).astype(float)
        self.tables_r = np.array([k.tables_r for k in kept], float)
        self.ones, self.vocabulary, self.tokens = last.ones, last.vocabulary, last.tokens

    def discount(self, level: int) -> float:
        return _discount(*self.ones[level])


_ARRAYS = ["token", "pairs", "context", "n", "a", "b", "r", "docs", "number", "count"]
_KINDS = {
    "token": np.uint64, "pairs": np.int32, "context": np.int32, "n": np.int64, "a": np.uint32, "b": np.uint32,
    "r": np.uint32, "docs": np.uint8, "number": np.int32, "count": np.int32,
}
_NOTHING = np.zeros(0)


def _tagged(kind: str, batch_id: int, rows: list) -> pa.RecordBatch:
    """Rows of a kind; large ones are compressed."""
    n, zipped = len(rows), kind in ("seats", "asked", "totals")
    columns = packed_batch(rows, _ARRAYS, zipped).columns
    if not zipped:
        columns = [*columns, pa.array([None] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n), pa.array([batch_id] * n, pa.int64()), *columns], names=["kind", "batch", "part", *_ARRAYS, "sizes"]
    )


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))


_SCHEMA = "kind string, batch long, part int, " + ", ".join(f"{name} binary" for name in [*_ARRAYS, "sizes"])


def _seats_row(part: int, share: Share, a: np.ndarray, b: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    """A part's seats; a, b and r have a column for each seating."""
    cut = np.append(share.first, len(share.token))
    tables = [np.ascontiguousarray(x, np.uint32) for x in (a, b, r)]
    own = [share.token[share.first], np.diff(cut).astype(np.int32), share.context.astype(np.int32), share.n, *tables]
    return _tagged("seats", 0, [(part, [*own, _NOTHING, _NOTHING, _NOTHING])])


class Model:
    """The fitted model: seats by part in a stored table, totals, and the copies of frequent tokens."""

    def __init__(self, seats: DataFrame, totals: Totals, copies: dict[int, int], parts: int):
        self.seats, self.totals, self.copies, self.parts = seats, totals, copies, parts


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Learn from all rows. Null texts count as empty; repeated rows count each; no rows are fine."""
    spark = docs.sparkSession
    parts = parts_of(spark)

    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _steps(stream):
            tokens, pair, _ = _put_together(texts)
            pair, n = np.unique(pair, return_counts=True)
            token, context = _apart(tokens, pair)
            rows = []
            for part, (t, c, k) in dealt((token % np.uint64(parts)).astype(np.int64), token, context, n):
                first = _starts(t)
                pairs = np.diff(np.append(first, len(t))).astype(np.int32)
                rows.append((part, [t[first], pairs, c, k.astype(np.int32)]))
            yield packed_batch(rows, ["token", "pairs", "context", "n"], zipped=True)

    def begun(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in stream:
            numbers = batch.column(0).to_numpy()
            for part in np.unique(numbers):
                held.setdefault(int(part), []).append(batch.filter(pa.array(numbers == part)))
        sums = Sums()
        for part in list(held):
            got = unpacked(iter(held.pop(part)), {"token": np.uint64, "pairs": np.int32, "context": np.int32, "n": np.int32})
            share = Share(*_by_pair(np.repeat(got["token"], got["pairs"]), got["context"], got["n"].astype(np.int64)))
            tables = [np.ones((len(x), 1), np.int64) for x in (share.n, share.parent_key, share.first)]
            sums.add(share, *(t[:, 0] for t in tables))
            yield _seats_row(part, share, *tables)
        yield _tagged("totals", 0, sums.rows())

    def swept(number: int, before: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def sweep(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_, sums = before.value, Sums()
            for row in _one_by_one(stream):
                part = row.column(row.schema.get_field_index("part"))[0].as_py()
                got = unpacked(iter([row]), {k: _KINDS[k] for k in ("token", "pairs", "context", "n", "a", "b", "r")})
                share = Share(np.repeat(got["token"], got["pairs"]), got["context"], got["n"])
                old = [got[k].reshape(size, -1) for k, size in (("a", len(share.n)), ("b", len(share.parent_key)), ("r", len(share.first)))]
                rng = np.random.default_rng([SEED, number, part])  # no matter which parts a task has
                new = share.sweep(*(x[:, -1].astype(np.int64) for x in old), all_, rng)
                sums.add(share, *new)
                kept = old if number > BURN_IN else [x[:, :0] for x in old]
                yield _seats_row(part, share, *(np.column_stack([x, y]) for x, y in zip(kept, new)))
                if number == BURN_IN + SEATINGS - 1:
                    total = np.add.reduceat(share.n, share.first)
                    often = total * 2 * parts > all_.tokens
                    if often.any():
                        yield _tagged("often", 0, [(0, [share.token[share.first][often], _NOTHING, _NOTHING, total[often], *[_NOTHING] * 6])])
            yield _tagged("totals", 0, sums.rows())

        return sweep

    def summed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for row in _one_by_one(stream):
            part = row.column(0)[0].as_py()
            now = list(unpacked(iter([row]), {"n": np.int64, "docs": np.float64}).values())
            sums[part] = [x + y for x, y in zip(sums[part], now)] if part in sums else now
        if sums:
            yield packed_batch(list(sums.items()), ["n", "few"])

    def written(frame: DataFrame) -> tuple[str, DataFrame, Sums]:
        path = work_folder(spark, "seats")
        frame.write.option("compression", "none").parquet(path)  # its values are compressed
        found, sums = spark.read.schema(_SCHEMA).parquet(path), Sums()
        slices = found.where("kind = 'totals'").select("part", *_ARRAYS, "sizes").repartition("part")
        for row in slices.mapInArrow(summed, "part int, n binary, few binary").collect():  # of fixed size; one job
            sums.take(*row)
        return path, found, sums

    counts = docs.select(F.lit(0).alias("id"), whole_text(text).alias("bytes")).mapInArrow(
        counted, "part int, token binary, pairs binary, context binary, n binary, sizes binary"
    )
    path, found, sums = written(counts.repartition("part").mapInArrow(begun, _SCHEMA))
    kept = [sums] * SEATINGS
    for number in range(BURN_IN + SEATINGS if sums.tokens else 0):
        before = spark.sparkContext.broadcast(sums)
        old = path
        path, found, sums = written(found.where("kind = 'seats'").mapInArrow(swept(number, before), _SCHEMA))
        kept = [*kept[1:], sums]
        before.unpersist()
        place = spark._jvm.org.apache.hadoop.fs.Path(old)  # the seats before the sweep, which nothing reads again
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    totals = Totals(kept)
    copies: dict[int, int] = {}
    for row in found.where("kind = 'often'").select("token", "n").collect():  # at most 2 x parts tokens; one job
        for token, n in zip(np.frombuffer(row.token, np.uint64), np.frombuffer(row.n, np.int64)):
            wanted = -(-2 * parts * int(n) // max(1, totals.tokens))
            if wanted > 1:
                copies[int(token)] = min(parts, wanted)
    return Model(found.where("kind = 'seats'"), totals, copies, parts)


def _place(token: np.ndarray, copy: np.ndarray, parts: int) -> np.ndarray:
    """Part of a token's copy; copy 0 is where the token was counted."""
    return ((token % np.uint64(parts)).astype(np.int64) + copy * 7919) % parts


class _Seats:
    """The seats of a partition, for looking up predictive probabilities."""

    def __init__(self, got: dict[str, np.ndarray], totals: Totals):
        self.totals = totals
        token, first = np.unique(got["token"], return_index=True)  # copies of one token may meet here
        cut = np.concatenate([[0], np.cumsum(got["pairs"], dtype=np.int64)])
        size = got["pairs"][first].astype(np.int64)
        at = np.repeat(cut[first] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        share = self.share = Share(np.repeat(token, size), got["context"][at], got["n"][at])
        self.token = token
        self.a = got["a"].reshape(-1, SEATINGS)[at].astype(np.int64)
        # Seats of parents are stored token by token, in ascending order of the parent.
        owner = np.repeat(np.arange(len(got["token"])), got["pairs"])
        stored_keys = np.unique(owner * _PARENTS + (got["context"].astype(np.int64) >> _WITHIN))
        wanted = first[share.token_of_parent] * _PARENTS + share.parent
        self.b = got["b"].reshape(-1, SEATINGS)[np.searchsorted(stored_keys, wanted)].astype(np.int64)
        self.r = got["r"].reshape(-1, SEATINGS)[first].astype(np.int64)
        self.n = np.bincount(share.of_token, share.n, len(token)).astype(np.int64)
        self.pair_key = share.of_token * _CONTEXTS + share.context
        # Per kept seating: what customers of their own give a token in context, parent and root, and what
        # each context and parent passes on from above.
        t = totals
        da, db, dr = (t.discount(k) for k in range(3))
        self.own, self.middle, self.root, self.pass_a, self.pass_b, self.size_b = [], [], [], [], [], []
        self.size_a = 1 / (THETA[0] + t.size)
        for k in range(SEATINGS):
            ta, tb, tr = t.tables_a[k], t.tables_b[k], t.tables_r[k]
            sb, sr = ta.reshape(_PARENTS, -1).sum(axis=1), tb.sum()
            cb, cr = share.customers(self.a[:, k]), share.root_customers(self.b[:, k])
            self.own.append(share.n - da * self.a[:, k])
            self.middle.append(cb - db * self.b[:, k])
            new = (THETA[2] + dr * tr) / (t.vocabulary + 1)
            self.root.append(np.append(cr - dr * self.r[:, k] + new, new) / (THETA[2] + sr))  # the last: unknown tokens
            self.pass_a.append((THETA[0] + da * ta) * self.size_a)
            self.pass_b.append((THETA[1] + db * tb) / (THETA[1] + sb))
            self.size_b.append(1 / (THETA[1] + sb))
        del self.a, self.b, self.r

    def probabilities(self, token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Averaged predictive probability, and training count, of each token in its context."""
        context = context.astype(np.int64)
        up = context >> _WITHIN
        which, known = _find(self.token, token)
        at = np.where(known, which, 0)
        pair, seen = _find(self.pair_key, at * _CONTEXTS + context)
        above, met = _find(self.share.parent_key, at * _PARENTS + up)
        seen, met = np.flatnonzero(seen & known), np.flatnonzero(met & known)
        at = np.where(known, which, len(self.token))
        size_a, total = self.size_a[context], np.zeros(len(token))
        for k in range(SEATINGS):
            middle = self.pass_b[k][up] * self.root[k][at]
            middle[met] += self.middle[k][above[met]] * self.size_b[k][up[met]]
            total += self.pass_a[k][context] * middle
            total[seen] += self.own[k][pair[seen]] * size_a[seen]
        return total / SEATINGS, np.append(self.n, 0)[at]


def _find(ascending: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(ascending, wanted)
    inside = np.minimum(at, max(0, len(ascending) - 1))
    return inside, (ascending[inside] == wanted) if len(ascending) else np.zeros(len(wanted), bool)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row.

    Null and empty texts have the end token alone. Rows of one id are scored each; null ids stay null;
    an empty table gives an empty result; other columns are not carried.
    """
    parts = model.parts
    sent = docs.sparkSession.sparkContext.broadcast((model.totals, model.copies))
    kind = docs.schema[doc_id].dataType.simpleString()

    def asked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = sent.value[1]
        often = np.array(sorted(copies), np.uint64)
        times = np.array([copies[int(w)] for w in often], np.int64)
        for step, (ids, texts) in enumerate(_steps(stream)):
            batch_id = (TaskContext.get().partitionId() << 32) + step
            tokens, pair, number = _put_together(texts)
            lengths = np.bincount(number, minlength=len(texts)).astype(np.int32)
            pair, count = np.unique(pair * len(texts) + number, return_counts=True)
            pair, number = np.divmod(pair, len(texts))
            (token, context), number, count = _apart(tokens, pair), number.astype(np.int32), count.astype(np.int32)
            copy = np.zeros(len(token), np.int64)
            at, frequent = _find(often, token)
            if frequent.any():
                copy[frequent] = number[frequent] % times[at[frequent]]
            rows = []
            for part, (t, c, n, k) in dealt(_place(token, copy, parts), token, context, number, count):
                f = _starts(t)
                rows.append((part, [t[f], np.diff(np.append(f, len(t))).astype(np.int32), c, *[_NOTHING] * 5, n, k]))
            unknown = np.array([i is None for i in ids], np.uint8)
            plain = np.array([i or 0 for i in ids], np.int64)
            meta = [_NOTHING, _NOTHING, _NOTHING, plain, _NOTHING, _NOTHING, _NOTHING, unknown, lengths, _NOTHING]
            yield _tagged("asked", batch_id, rows)
            yield _tagged("docs", batch_id, [(batch_id % parts, meta)])

    def copied(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The seats once more for each further copy of a frequent token."""
        copies = sent.value[1]
        often = np.array(sorted(copies), np.uint64)
        for row in _one_by_one(stream):
            yield pa.RecordBatch.from_arrays(row.columns, names=row.schema.names)
            _, frequent = _find(often, unpacked(iter([row]), {"token": np.uint64})["token"])
            if not frequent.any():
                continue
            got = unpacked(iter([row]), _KINDS)
            cut = np.concatenate([[0], np.cumsum(got["pairs"], dtype=np.int64)])
            owner = np.repeat(np.arange(len(got["token"])), got["pairs"])
            _, of_parent = np.unique(owner * _PARENTS + (got["context"].astype(np.int64) >> _WITHIN), return_index=True)
            parents = np.concatenate([[0], np.cumsum(np.bincount(owner[of_parent], minlength=len(got["token"])))])
            a, b, r = (got[k].reshape(-1, SEATINGS) for k in ("a", "b", "r"))
            for i in np.flatnonzero(frequent):
                token = got["token"][i : i + 1]
                p, q = slice(cut[i], cut[i + 1]), slice(parents[i], parents[i + 1])
                own = [token, got["pairs"][i : i + 1], got["context"][p], got["n"][p], a[p], b[q], r[i], _NOTHING, _NOTHING, _NOTHING]
                one = _tagged("seats", 0, [(0, own)])
                for part in _place(token, np.arange(1, copies[int(token[0])]), parts):
                    yield one.set_column(2, "part", pa.array([part], pa.int32()))

    def answered(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows stay packed until their part's turn, so one part's seats are unpacked at a time.
        totals = sent.value[0]
        held: dict[int, dict[str, list[pa.RecordBatch]]] = {}
        for batch in stream:
            kinds, numbers = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(2).to_pylist())
            for part in np.unique(numbers):
                for kind in ("seats", "asked"):
                    if (on := (kinds == kind) & (numbers == part)).any():
                        held.setdefault(int(part), {"seats": [], "asked": []})[kind].append(batch.filter(pa.array(on)))
            if (on := kinds == "docs").any():
                docs_ = batch.filter(pa.array(on))
                columns = [docs_.column(docs_.schema.get_field_index(c)) for c in ("batch", "n", "docs", "number")]
                empty = pa.array([None] * docs_.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, *[empty] * 4], names=_ANSWER)
        sums: dict[int, np.ndarray] = {}  # by batch: score, base and known tokens of each of its texts
        for part in list(held):
            own = held.pop(part)
            if own["asked"]:
                _add_answers(_Seats(unpacked(iter(own["seats"]), _KINDS), totals), own["asked"], sums)
        empty = pa.array([None], pa.binary())
        for key, found in sums.items():
            texts = np.flatnonzero(found[1])  # every token makes the base smaller
            row = [texts.astype(np.int32), found[0, texts], found[1, texts], found[2, texts].astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), empty, empty, empty, *[pa.array([x.tobytes()], pa.binary()) for x in row]], names=_ANSWER
            )

    def _add_answers(seats: _Seats, asked: list[pa.RecordBatch], sums: dict[int, np.ndarray]) -> None:
        totals = seats.totals
        for batch in (b.slice(i, 64) for b in asked for i in range(0, b.num_rows, 64)):
            got = unpacked(iter([batch]), {k: _KINDS[k] for k in ("token", "pairs", "context", "number", "count")})
            p, n = seats.probabilities(np.repeat(got["token"], got["pairs"]), got["context"])
            base = np.log10((n + 0.5) / (totals.tokens + 0.5 * (totals.vocabulary + 1)))
            values = [x * got["count"] for x in (np.log10(p), base, n > 0)]
            at = 0
            for key, size in zip(batch.column(1).to_pylist(), (n // 4 for n in sizes_of(batch, "number"))):
                number = got["number"][at : at + size]
                known = sums.get(key, np.zeros((3, 0)))
                if number.max() >= known.shape[1]:
                    known = np.pad(known, ((0, 0), (0, int(number.max()) + 1 - known.shape[1])))
                for k in range(3):
                    known[k] += np.bincount(number, values[k][at : at + size], known.shape[1])
                sums[key] = known
                at += size

    def together(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, list] = {}
        sums: dict[int, list[list[bytes]]] = {}
        for batch in stream:
            for key, n, unknown, lengths, *parts_ in zip(*(c.to_pylist() for c in batch.columns)):
                if n is not None:
                    texts[key] = [np.frombuffer(n, np.int64), np.frombuffer(unknown, np.uint8), np.frombuffer(lengths, np.int32)]
                else:
                    for column, part in zip(sums.setdefault(key, [[], [], [], []]), parts_):
                        column.append(part)
        for key, (ids, unknown, lengths) in texts.items():
            number, *values = (np.frombuffer(b"".join(c), k) for c, k in zip(sums[key], (np.int32, np.float64, np.float64, np.int32)))
            total = [np.bincount(number, v, len(ids)) for v in values]
            columns = [
                pa.array(ids, mask=unknown == 1), pa.array(lengths.astype(np.int64)), pa.array(total[2].astype(np.int64)),
                pa.array(total[1].astype(np.float64)), pa.array(total[0].astype(np.float64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    questions = docs.select(F.col(doc_id).cast("bigint"), whole_text(text)).toDF("id", "bytes").mapInArrow(asked, _SCHEMA)
    seats = model.seats.mapInArrow(copied, _SCHEMA)
    answer = "batch long, n binary, docs binary, number binary, texts binary, score binary, base binary, known binary"
    answers = seats.union(questions).repartition("part").mapInArrow(answered, answer)
    scored = answers.repartition("batch").mapInArrow(together, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))


_ANSWER = ["batch", "n", "docs", "number", "texts", "score", "base", "known"]


def op1_hpylm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs.where(remainder("doc_id") != 1))
    return score(docs, model).select(
        "doc_id", (remainder("doc_id") == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.totals.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
