"""Removing repeated passages with hash-compared suffix sorts (operator 8).

A passage is repeated if its ``LENGTH`` bytes also start anywhere else. Sorting every suffix of the
corpus would move it many times over, so only suffixes at anchors are sorted. The anchor of a
``LENGTH``-byte window is its k-gram of least hash, so equal windows have equal anchors at the same
distance, and every window has one.

1. Count the k-grams at anchors (one number each). Those seen once can start no repeat.
2. Cut out the surroundings of the others and bring those of one k-gram together.
3. Sort the suffixes that start at the anchors, and the reversed prefixes that end there, by merge
   sort; where all of the surroundings are equal byte by byte, one is sorted for all. Two are compared
   by the length of their common extension, found by binary search on prefix polynomial hashes, so a
   comparison takes a logarithmic number of steps. The common extensions of neighbours are then
   verified byte by byte.
4. Two windows with the anchor at distance d are equal if their reversed prefixes share a class at
   depth d and their suffixes one at depth LENGTH - d. Classes are the stretches of the sorted order
   whose neighbouring extensions are at least as long.
5. K-grams with very many anchors do not go to one task. Their windows are hashed (128 bits), equal
   ones of some hundred thousand are settled on the spot, and one of each is counted by its hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loupewright.llm.common import dealt, kept, map_rows, packed_batch, parts_of, table, unpacked, whole_text

LENGTH, KGRAM = 200, 40
_WINDOW = LENGTH - KGRAM + 1
#: Anchors of one k-gram that may be sorted in one task.
GROUP = 4096
#: The two fixed-size maps of k-grams that are sent to all tasks have 2^MAP_BITS bits (8 MB each), and a
#: k-gram has two of them. Bits set by other k-grams only cost work.
MAP_BITS = 26
#: Surroundings that are put together, and compressed, before they are sent.
GATHER = 8 << 20
#: Windows of crowded k-grams that are compared with each other before they are sent.
TOGETHER = 1 << 18
#: Texts are hashed in segments that stay in a core's cache.
_SEGMENT = 1 << 17
#: Powers that a worker keeps.
_POWERS = 1 << 21
_PLACE_BITS = np.uint64(21)

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class PrefixHash:
    """Polynomial hashes, modulo 2^64, of all substrings of a byte array."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        known = kept("suffix_dedup")
        up, down = known.get(base, (np.zeros(0), np.zeros(0)))
        if len(up) < len(data) + 1:
            n = max(len(data) + 1, min(1 << max(len(data).bit_length(), 16), _POWERS))
            up, down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
            if n <= _POWERS:
                known[base] = (up, down)
        self.up = up
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.up[start]

    def of_all(self, length: int) -> np.ndarray:
        """Hashes of the substrings of that length at all places."""
        found = self.sums[length:] - self.sums[:-length]
        found *= self.up[: len(found)]
        return found

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of each pair of places, at most ``most``, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = self.of(a, middle) == self.of(b, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by running minima from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, hashes of their k-grams, and the first and last window start of each.

    ``inside`` tells for each window start whether the window counts (lies in one document).
    """
    found = []
    for start in range(0, max(0, len(data) - LENGTH + 1), _SEGMENT):
        part = data[start : start + _SEGMENT + LENGTH - 1]
        kgrams = _mixed(PrefixHash(part).of_all(KGRAM))
        marked = (kgrams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(kgrams), dtype=np.uint64)
        place = (_least(marked, _WINDOW) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        windows = np.arange(len(place))
        if inside is not None:
            windows = np.flatnonzero(inside[start : start + len(place)])
            place = place[windows]
        if len(place):
            new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(windows) != 1)]))
            last = np.append(new[1:], len(place)) - 1
            found.append([place[new] + start, kgrams[place[new]], windows[new] + start, windows[last] + start])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, hashes, low, high = (np.concatenate(c) for c in zip(*found))
    # A run that goes on over the end of a segment is one anchor.
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (low[1:] != high[:-1] + 1)]))
    last = np.append(first[1:], len(place)) - 1
    return place[first], hashes[first], low[first], high[last]


def _blocks(rows: list, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together to about a segment: bytes, rows, document starts, and which windows count."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _SEGMENT):
            size += len(texts[stop])
            stop += 1
        lengths = np.array([len(t) for t in texts[at:stop]])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        data = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        long = lengths >= LENGTH
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, starts[long] + lengths[long] - LENGTH + 1, -1)
        yield data, np.array(rows[at:stop], np.int64), starts, np.cumsum(inside[:-1]) > 0
        at = stop


def suffix_sort(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[start : start + length] within ascending groups, and common extensions.

    Bottom-up merge sort over all groups at once: each element finds its place in the run next to its
    own by binary search. The second result is the common extension of each string with the one
    before it in the order, -1 at the first of a group; it is verified byte by byte, and on a
    collision of hashes the strings are sorted by their bytes instead.
    """
    hashes = PrefixHash(data)

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        short = np.minimum(lengths[a], lengths[b])
        common = hashes.extension(starts[a], starts[b], short)
        ended = common == short
        at = np.minimum(common, np.maximum(short - 1, 0))
        bytes_a, bytes_b = data[np.minimum(starts[a] + at, len(data) - 1)], data[np.minimum(starts[b] + at, len(data) - 1)]
        return np.where(ended, lengths[a] < lengths[b], bytes_a < bytes_b)

    order = np.argsort(groups, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(groups[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(order)))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    local = np.arange(len(order)) - base
    width = 1
    while width < sizes.max(initial=0):
        run = local // width
        right = run % 2 == 1
        other = np.where(right, run - 1, run + 1) * width
        low, high = np.minimum(other, size), np.minimum(other + width, size)
        begin = low.copy()
        while len(at := np.flatnonzero(low < high)):
            middle = (low[at] + high[at]) >> 1
            mine, theirs = order[at], order[base[at] + middle]
            before = np.where(right[at], ~less(mine, theirs), less(theirs, mine))
            low[at] = np.where(before, middle + 1, low[at])
            high[at] = np.where(before, high[at], middle)
        moved = base + (run // 2) * 2 * width + (local - run * width) + (low - begin)
        new = np.empty_like(order)
        new[moved] = order
        order, width = new, width * 2
    one, two = order[:-1], order[1:]
    common = np.full(len(order), -1, np.int64)
    short = np.minimum(lengths[one], lengths[two])
    common[1:] = np.where(groups[one] == groups[two], hashes.extension(starts[one], starts[two], short), -1)
    if not _verified(data, starts, lengths, order, common):
        strings = [data[s : s + n].tobytes() for s, n in zip(starts, lengths)]
        order = np.array(sorted(range(len(starts)), key=lambda i: (groups[i], strings[i])), np.int64)
        for k, (i, j) in enumerate(zip(order[:-1], order[1:]), 1):
            a, b = strings[i], strings[j]
            n = next((p for p, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            common[k] = n if groups[i] == groups[j] else -1
    return order, common


def _verified(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray, common: np.ndarray) -> bool:
    """Whether neighbours agree in exactly their common extension and are in ascending order."""
    at = np.flatnonzero(common >= 0)
    one, two, n = order[at - 1], order[at], common[at]
    total = int(n.sum())
    offsets = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    if (data[np.repeat(starts[one], n) + offsets] != data[np.repeat(starts[two], n) + offsets]).any():
        return False
    short = np.minimum(lengths[one], lengths[two])
    differ = n < short
    a, b = data[(starts[one] + n)[differ]], data[(starts[two] + n)[differ]]
    return bool((a < b).all() and (lengths[one] <= lengths[two])[~differ].all())


def first_alike(before: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each member the first one with the same bytes around its anchor, the k-gram included; bytes are compared."""
    whole, first = data.tobytes(), {}
    members = zip(before.tolist(), offsets.tolist(), (offsets + sizes).tolist())
    return np.array([first.setdefault((b, whole[i:j]), m) for m, (b, i, j) in enumerate(members)], np.int64)


def repeated_windows(groups, before, after, offsets, data, copied) -> np.ndarray:
    """Member x distance: whether that member's window with its anchor at that distance has an equal.

    Member m's bytes are data[offsets[m] : ...], its anchor ``before[m]`` bytes after their start; its
    windows have the distances after[m] .. before[m]. ``copied`` members stand for several that are alike,
    so each of their windows has an equal.
    """
    n = len(groups)
    anchor = offsets + before
    right, right_common = suffix_sort(data, anchor, LENGTH - after, groups)
    back = np.ascontiguousarray(data[::-1])
    left, left_common = suffix_sort(back, len(data) - anchor, before, groups)
    distance = np.arange(_WINDOW)
    found = copied[:, None] & (after[:, None] <= distance) & (distance <= before[:, None])
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(after.min()), int(before.max()) + 1):
        has = np.flatnonzero((after <= d) & (d <= before))
        if len(has) < 2:
            continue
        right_class[right] = np.cumsum(right_common < LENGTH - d)
        left_class[left] = np.cumsum(left_common < d)
        key = right_class[has] * (n + 1) + left_class[has]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        found[has[order[1:][same]], d] = True
        found[has[order[:-1][same]], d] = True
    return found


def _map_of(hashes: np.ndarray) -> list[np.ndarray]:
    """The two places of each k-gram in a map."""
    low = np.uint64((1 << MAP_BITS) - 1)
    return [(hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64), (hashes & low).astype(np.int64)]


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for at in _map_of(hashes))
    return one & two


def _cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several stretches, one after the other."""
    return data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def _ranges(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of window starts, none of which lies within another, put together where they meet in a row."""
    if not len(row):
        return row, low, high
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (low[1:] - high[:-1] > 1)]))
    return row[new], low[new], high[np.append(new[1:], len(high)) - 1]


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of distances found for a member: member, least, greatest."""
    padded = np.zeros((len(found), found.shape[1] + 1), bool)
    padded[:, :-1] = found
    flat = padded.ravel()
    change = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    if len(flat) and flat[0]:
        change = np.concatenate([[0], change])
    (member, least), stop = np.divmod(change[::2], padded.shape[1]), change[1::2]
    return member, least, least + stop - change[::2] - 1


def _range_batch(row, low, high) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (row, low, high)], names=["row", "low", "high"])


_PACKED = ["hash", "second", "row", "low", "before", "after", "data"]
_KINDS = {"hash": np.uint64, "second": np.uint64, "row": np.int64, "low": np.int64, "before": np.int16, "after": np.int16, "data": np.uint8}


def sorted_groups(got: dict[str, np.ndarray], group: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of packed surroundings, about ``group`` at a time; those that are alike are sorted as one."""
    before, after = got["before"].astype(np.int64), got["after"].astype(np.int64)
    size = before - after + LENGTH
    offset = np.cumsum(size) - size
    alike = first_alike(before, offset, size, got["data"])
    copies = np.bincount(alike, minlength=len(alike))
    members = np.argsort(alike, kind="stable")
    begin = np.cumsum(copies) - copies
    order = np.flatnonzero(copies)
    order = order[np.argsort(got["hash"][order], kind="stable")]
    hashes = got["hash"][order]
    same = hashes[1:] == hashes[:-1]
    several_ = (copies[order] > 1) | np.concatenate([[False], same])[: len(order)] | np.append(same, False)[: len(order)]
    order, hashes = order[several_], hashes[several_]
    group_of = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    at = 0
    while at < len(order):
        stop = min(len(order), at + group)
        while stop < len(order) and group_of[stop] == group_of[stop - 1]:
            stop += 1
        some = order[at:stop]
        n = size[some]
        data = _cut_out(got["data"], offset[some], n)
        found = repeated_windows(group_of[at:stop], before[some], after[some], np.cumsum(n) - n, data, copies[some] > 1)
        member, least, greatest = _runs(found)
        one = some[member]
        times = copies[one]
        every = members[np.repeat(begin[one] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
        start = (got["low"] + before)[every]
        yield _range_batch(*_ranges(got["row"][every], start - np.repeat(greatest, times), start - np.repeat(least, times)))
        at = stop


def repeat_ranges(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """row, low, high: the windows low .. high (byte offsets) of a row that also start elsewhere.

    ``docs`` has ``row`` (long, unique) and ``bytes``. Ranges may come in pieces and overlap.
    """
    spark = docs.sparkSession
    parts = parts_of(spark)

    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            got = [anchors(data, inside)[1] for data, _, _, inside in _blocks(list(range(len(texts))), texts)]
            hashes, n = np.unique(np.concatenate(got), return_counts=True)
            part = (hashes % np.uint64(parts)).astype(np.int64)
            yield packed_batch(list(dealt(part, hashes, n.astype(np.int64))), ["hash", "n"])

    def several(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = unpacked(stream, {"hash": np.uint64, "n": np.int64})
        hashes, back = np.unique(got["hash"], return_inverse=True)
        n = np.zeros(len(hashes), np.int64)
        np.add.at(n, back, got["n"])
        places = [np.unique(np.concatenate(_map_of(hashes[n > least]))).astype(np.int32).tobytes() for least in (1, group)]
        yield pa.RecordBatch.from_pydict({"repeated": [places[0]], "crowded": [places[1]]})

    counts = docs.select("row", "bytes").mapInArrow(counted, "part int, hash binary, n binary").repartition("part")
    maps = [np.zeros(1 << (MAP_BITS - 3), np.uint8) for _ in range(2)]
    for found in counts.mapInArrow(several, "repeated binary, crowded binary").toLocalIterator():  # bounded: the maps' own size
        for bits, places in zip(maps, found):
            at = np.frombuffer(places, np.int32)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    sent = spark.sparkContext.broadcast(maps)

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, crowded = sent.value
        windows: list[list[np.ndarray]] = []
        for batch in stream:
            rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held: list[list[np.ndarray]] = []
            for data, row, starts, inside in _blocks(rows, texts):
                place, hashes, low, high = anchors(data, inside)
                keep = _holds(repeated, hashes)
                place, hashes, low, high = place[keep], hashes[keep], low[keep], high[keep]
                if not len(place):
                    continue
                doc = np.searchsorted(starts, place, "right") - 1
                crowd = _holds(crowded, hashes)
                held.append(_contexts(data, ~crowd, place, hashes, low, high, row[doc], starts[doc]))
                if sum(len(h[-1]) for h in held) > GATHER:
                    yield from _sent(held)
                    held = []
                if crowd.any():
                    windows.append(_windows(data, *(c[crowd] for c in (low, high, row[doc], starts[doc]))))
                    if sum(len(w[0]) for w in windows) > TOGETHER:
                        yield from _settled(windows)
                        windows = []
            yield from _sent(held)
        yield from _settled(windows)

    def _contexts(data, on, place, hashes, low, high, row, start):
        place, hashes, low, high, row, start = (c[on] for c in (place, hashes, low, high, row, start))
        text = _cut_out(data, low, high - low + LENGTH)
        return [hashes, row, low - start, (place - low).astype(np.int16), (place - high).astype(np.int16), text]

    def _sent(held):
        if not held:
            return
        hashes, row, low, before, after, text = (np.concatenate(c) for c in zip(*held))
        size = before.astype(np.int64) - after + LENGTH
        start = np.cumsum(size) - size
        pack, nothing = zstandard.ZstdCompressor(level=1), np.zeros(0)
        out = []
        for number, (index,) in dealt((hashes % np.uint64(parts)).astype(np.int64), np.arange(len(hashes))):
            own = np.frombuffer(pack.compress(_cut_out(text, start[index], size[index]).tobytes()), np.uint8)
            out.append((number, [hashes[index], nothing, row[index], low[index], before[index], after[index], own]))
        if out:
            yield _tagged("context", out)

    def _windows(data, low, high, row, start):
        size = high - low + 1
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        h1, h2 = (_mixed(PrefixHash(data, base).of(at, LENGTH)) for base in _BASES)
        return [h1, h2, np.repeat(row, size), at - np.repeat(start, size)]

    def _settled(windows):
        if not windows:
            return
        h1, h2, row, local = (np.concatenate(c) for c in zip(*windows))
        order = np.lexsort((h2, h1))
        h1, h2, row, local = h1[order], h2[order], row[order], local[order]
        first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        alone = first & np.append(first[1:], True)
        settled = _ranges(row[~alone], local[~alone], local[~alone])
        nothing = np.zeros(0)
        if len(settled[0]):
            yield _tagged("range", [(int(settled[0][0] % parts), [nothing, nothing, *settled[:2], nothing, nothing, settled[2]])])
        owner = np.where(alone, row, -1)[first]  # no owner: at least two that are settled already
        part = (h1[first] % np.uint64(parts)).astype(np.int64)
        out = [(n, [a, b, r, w, nothing, nothing, nothing]) for n, (a, b, r, w) in dealt(part, h1[first], h2[first], owner, local[first])]
        yield _tagged("window", out)

    def _tagged(kind, rows):
        batch = packed_batch(rows, _PACKED)
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows)), *batch.columns], names=["kind", *batch.schema.names])

    schema = "kind string, part int, " + ", ".join(f"{name} binary" for name in _PACKED)
    pieces = docs.select("row", "bytes").mapInArrow(cut, schema).repartition("part")

    def gathered(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What came to this partition, part by part; surroundings stay compressed until their part's turn."""
        held: dict[tuple[int, str], dict[str, list[bytes]]] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in stream:
            kinds, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in _PACKED:
                for kind, number, value in zip(kinds, numbers, batch.column(batch.schema.get_field_index(name)).to_pylist()):
                    if kind != "range":
                        held.setdefault((number, kind), {}).setdefault(name, []).append(value)
            for i, kind in enumerate(kinds):
                if kind == "range":
                    low, row, high = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("low", "row", "data"))
                    yield _range_batch(row, low, high)
        for number, kind in sorted(held):
            columns = held.pop((number, kind))
            if kind == "context":
                columns["data"] = [unpack.decompress(value) for value in columns["data"]]
            whole = {name: np.frombuffer(b"".join(columns.pop(name)), _KINDS[name]) for name in _PACKED}
            yield from sorted_groups(whole, group) if kind == "context" else counted_windows(whole)

    def counted_windows(got: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((got["second"], got["hash"]))
        h1, h2, row, low = (got[k][order] for k in ("hash", "second", "row", "low"))
        if len(h1):
            group_of = np.cumsum(np.concatenate([[0], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            weight = np.bincount(group_of, np.where(row < 0, 2, 1))
            hit = (weight[group_of] >= 2) & (row >= 0)
            yield _range_batch(*_ranges(row[hit], low[hit], low[hit]))

    return pieces.mapInArrow(gathered, "row long, low long, high long")


def _without(text: bytes, low: list | None, high: list | None) -> tuple[bytes, int]:
    """The bytes outside all windows, and the number of removed runs."""
    if not low:
        return text, 0
    order = np.argsort(np.array(low), kind="stable")
    start, stop = np.array(low)[order], np.maximum.accumulate(np.array(high)[order] + LENGTH)
    first = np.concatenate([[True], start[1:] > stop[:-1]])
    begins, ends = start[first], stop[np.append(np.flatnonzero(first)[1:] - 1, len(stop) - 1)]
    kept = [text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)])]
    return b"".join(kept), len(begins)


def _cut(docs: DataFrame, group: int, finish: Callable[[bytes, bytes, int], tuple], schema: str) -> DataFrame:
    """Add the columns of ``schema``: ``finish(bytes, remaining bytes, removed runs)`` of each document."""
    added = StructType.fromDDL(schema).names
    names = docs.drop(*added).columns
    plain = docs.drop(*added).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    text = whole_text(f"c{names.index('text')}")
    ranges = repeat_ranges(numbered.select("row", text.alias("bytes")), group)
    by_row = ranges.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    joined = numbered.join(by_row, "row", "left").select(
        *plain.columns, text.alias("bytes"), F.col("found.low").alias("low"), F.col("found.high").alias("high")
    )

    def remove(texts: list, lows: list, highs: list) -> list:
        done = [finish(t, *_without(t, a, b)) for t, a, b in zip(texts, lows, highs)]
        return [list(c) for c in zip(*done)] or [[] for _ in added]

    found = map_rows(joined, ["bytes", "low", "high"], remove, schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *added)


def without_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Add n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes) to each document.

    Null texts count as empty. A text of a repeated row is repeated, so all of it goes if it has
    ``LENGTH`` bytes or more; the row stays. An empty table gives an empty result. The input is read
    twice and has to be a table, so that its row numbers are the same both times. Columns of the
    input called like the new ones are replaced.
    """
    made = lambda text, rest, runs: (len(text), len(text) - len(rest), runs, rest)
    return _cut(docs, group, made, "n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of their texts; characters cut in two are dropped."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    clean = lambda text, rest, runs: (rest.decode("utf-8", "ignore") if len(rest) < len(text) else None,)
    cut = _cut(docs.select("text", *[F.col(c).alias(n) for c, n in names.items()]), GROUP, clean, "clean_text string")
    text = F.coalesce("clean_text", "text").alias("text")
    return cut.select(*[text if c == "text" else F.col(names[c]).alias(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
