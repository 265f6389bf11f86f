"""Byte-level BPE by dynamic programming over prefixes (operator 2).

A token sequence is what BPE gives exactly if BPE keeps each neighbouring pair as it is. So each
byte prefix has one valid last token: the one that ends there and is compatible with the valid last
token of the prefix before it. With the last token of every prefix stored, appending bytes only adds
prefixes, and an edit needs new prefixes only until the stored ones agree again over the length of
the longest token.
"""

from __future__ import annotations

import base64
from array import array
from functools import cached_property

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupewright.llm.common import kept, map_rows, table
from loupewright.llm.pieces import Remembered, split

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces, and token pairs with their compatibility, that a worker remembers before it starts over.
PIECES, PAIRS = 400_000, 300_000


class PrefixCoder:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.sizes = {rank: len(token) for rank, token in self.tokens.items()}
        self._pairs: dict[int, bool] = {}
        self._made: dict[bytes, tuple[bytes, bytes] | None | bool] = {}  # at most one entry per token
        self.memory = Remembered(lambda new: [self.encode_piece(p.encode()) for p in new], PIECES)

    @cached_property
    def endings(self) -> dict[bytes, int]:
        """All ends of tokens, with the rank where the end is a token itself and -1 where not."""
        return {t[i:]: -1 for t in self.ranks for i in range(1, len(t))} | self.ranks

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """Plain BPE of a short string: merge the neighbours of least rank while there are more than ``least``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_merge(self, token: bytes) -> tuple[bytes, bytes] | None | bool:
        """The two parts that BPE merges last into a token; None for a byte, False if BPE never makes it."""
        known = self._made.get(token, 0)
        if known == 0:
            known = None
            if len(token) > 1:
                parts = self.merge(token, 2)
                known = len(parts) == 2 and parts[0] + parts[1] in self.ranks and tuple(parts)
            self._made[token] = known
        return known

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether BPE keeps the two tokens side by side.

        BPE is run backwards at the border: of the two parts that meet there, the one merged later is
        taken apart, until both are bytes. The tokens would not stay apart if at some time the parts at
        the border had a merge of their own due before the next merge of either.
        """
        ranks, due = self.ranks, 1 << 40
        while True:
            across = ranks.get(left + right)
            if across is not None and across < due:
                return False
            a, b = self.last_merge(left), self.last_merge(right)
            if a and (not b or ranks[left] > ranks[right]):
                due, left = ranks[left], a[1]
            elif b:
                due, right = ranks[right] + 1, b[0]  # of equal ranks the left one is merged first
            else:
                return True

    def extend(self, data: bytes, last: list[int], end: int | None = None) -> None:
        """Append to ``last`` (rank of the last token of each prefix) up to the prefix of ``end`` bytes."""
        endings, sizes, pairs = self.endings, self.sizes, self._pairs
        for stop in range(len(last), (len(data) if end is None else end) + 1):
            # Tokens that end here, shortest first; nothing longer can once the bytes end no token.
            fitting, start = [], stop - 1
            while start >= 0 and (rank := endings.get(data[start:stop])) is not None:
                if rank >= 0:
                    fitting.append(rank)
                start -= 1
            for rank in reversed(fitting):
                before = last[stop - sizes[rank]]
                if before < 0:
                    if self.last_merge(self.tokens[rank]) is False:
                        continue
                else:
                    pair = before << 32 | rank
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.last_merge(self.tokens[rank]) is not False and self.compatible(
                            self.tokens[before], self.tokens[rank]
                        )
                    if not fits:
                        continue
                last.append(rank)
                break
            else:
                raise ValueError(f"no token of the vocabulary ends at byte {stop}")

    def walk(self, last: list[int]) -> list[int]:
        """The tokens from the end to the start, turned round."""
        ids, stop = [], len(last) - 1
        while stop:
            ids.append(last[stop])
            stop -= self.sizes[last[stop]]
        return ids[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is a token as a whole is that token, whether merges reach it or not."""
        if data in self.ranks:
            return [self.ranks[data]]
        last = [-1]
        self.extend(data, last)
        return self.walk(last)

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian unsigned 32-bit integers."""
        return b"".join(self.memory.packed(split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", packed)))


class PrefixState:
    """One unsplit byte string with the last token of each of its prefixes (-1 for the empty one)."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.coder.extend(self.data, self.last)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Replace bytes [start, stop); returns how many prefixes were computed anew."""
        shift = len(data) - (stop - start)
        old, self.data = self.last, self.data[:start] + data + self.data[stop:]
        self.last, same, edited = old[: start + 1], 0, start + len(data)
        while len(self.last) <= len(self.data):
            at = len(self.last)
            self.coder.extend(self.data, self.last, at)
            # A later last token depends on that many bytes and last tokens before it, all after the edit.
            same = same + 1 if at > edited and self.last[at] == old[at - shift] else 0
            if same > self.coder.longest:
                self.last += old[at - shift + 1 :]
                return at - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        return self.coder.walk(self.last)


class EncodedText:
    """A text with its pieces; an edit splits and encodes again only near its place."""

    def __init__(self, coder: PrefixCoder, text: str):
        self.coder, self.text = coder, text
        self.pieces = split(text)

    def replace(self, start: int, stop: int, new: str) -> int:
        """Replace characters [start, stop); returns how many pieces were made anew."""
        text = self.text[:start] + new + self.text[stop:]
        shift, old, self.text = len(new) - (stop - start), self.pieces, text
        first = at = 0
        while first < len(old) and at + len(old[first]) <= start - 3:  # a match looks ahead three characters at most
            at += len(old[first])
            first += 1
        kept, ends, place = old[:first], {}, at
        for k in range(first, len(old)):
            ends[place] = k
            place += len(old[k])
        made: list[str] = []
        window = 256
        while at < len(text):
            found = split(text[at : at + window])
            if at + window < len(text):
                found = found[:-4]  # the cut may have changed the last ones
                if not found:
                    window *= 2
                    continue
            for piece in found:
                made.append(piece)
                at += len(piece)
                again = ends.get(at - shift)
                if at >= start + len(new) and again is not None and at - shift >= stop:
                    self.pieces = kept + made + old[again:]
                    return len(made)
        self.pieces = kept + made
        return len(made)

    def ids(self) -> list[int]:
        return list(array("I", b"".join(self.coder.memory.packed(self.pieces))))


def prefix_coder(path: str) -> PrefixCoder:
    """One coder per worker process and vocabulary."""
    coders = kept("prefix_bpe")
    if path not in coders:
        coders[path] = PrefixCoder(path)
    return coders[path]


def encode_texts(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add ``ids`` (packed little-endian unsigned 32-bit integers) to each document.

    Null and empty texts have no ids. Each row is encoded for itself, so repeated rows agree; an empty
    table stays empty; a column called ``ids`` is replaced. No shuffle; a worker remembers a bounded
    number of pieces and token pairs.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return map_rows(
        docs.drop("ids"), [text], lambda texts: [[prefix_coder(path).encode(t or "") for t in texts]], "ids binary"
    )


def decode_ids(encoded: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Add ``decoded`` (bytes) to each row of packed ids; null ids decode to no bytes."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    return map_rows(
        encoded.drop("decoded"), [ids], lambda rows: [[prefix_coder(path).decode(r or b"") for r in rows]], "decoded binary"
    )


def encode_and_decode(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add ``ids`` and ``decoded``, as :func:`encode_texts` and :func:`decode_ids` do, in one pass of one worker."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def both(texts: list) -> list[list[bytes]]:
        coder = prefix_coder(path)
        ids = [coder.encode(t or "") for t in texts]
        return [ids, [coder.decode(i) for i in ids]]

    return map_rows(docs.drop("ids", "decoded"), [text], both, "ids binary, decoded binary")


def op2_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encode_and_decode(docs).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
