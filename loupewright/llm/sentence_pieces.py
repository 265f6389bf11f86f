"""SentencePiece BPE by backtracking (operator 11).

A token sequence is what merging gives exactly if every neighbouring pair, merged by itself, stays the
same two tokens. So each prefix of a text has at most one valid sequence, and the text is encoded from
the left: an Aho-Corasick automaton gives the longest token at each position, a token that does not go
with the one before it gives way to its longest proper prefix, and a position from which no token goes
on is marked in a bitfield, its last token taken back, and never tried again.

Pairs are judged by merging the two tokens' characters again. Texts are cut first where no token of the
vocabulary has the two characters side by side, so no merge can cross the cut.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupewright.llm.common import map_rows, table

MODEL = "piece_bpe_32k.model"
#: The mark that the library writes for a space.
SPACE = "▁"
#: Segments and token pairs that a worker remembers before it starts over; longer segments are not kept.
SEGMENTS, PAIRS, LONGEST = 400_000, 400_000, 64

_NEVER = float("inf")


class PieceCoder(dict):
    """Encodes and decodes; as a dictionary, the packed ids of segments met before."""

    def __init__(self, path: str):
        super().__init__()
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(library.get_piece_size())
        fixed = {i for i in every if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        self.bytes = {int(library.id_to_piece(i)[3:5], 16): i for i in every if library.is_byte(i)}
        if len(self.bytes) < 256 or any(map(library.is_unused, every)) or library.encode(SPACE + "a  ") != library.encode(" a  "):
            raise ValueError("the model needs byte pieces, no unused ones, and no normalising beyond that of spaces")
        self.ids = {library.id_to_piece(i): i for i in every if i not in fixed}
        self.due = {piece: -library.get_score(i) for piece, i in self.ids.items()}
        self.shown = [b"" if i in fixed else library.id_to_piece(i).replace(SPACE, " ").encode() for i in every]
        for byte, i in self.bytes.items():
            self.shown[i] = bytes([byte])
        self.unseen = fixed - set(self.bytes.values())
        self.longest = ahocorasick.Automaton()
        for piece in self.ids:
            self.longest.add_word(piece, len(piece))
        self.longest.make_automaton()
        self.cut = re.compile(self._segments())
        self._shorter: dict[str, str] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    def _segments(self) -> str:
        """A pattern for segments that no merge connects: spaces, then marks, then all up to the next of either.

        A mark is a character, no letter or digit, that hardly any token has behind a character other than
        marks and spaces; those few characters keep the marks that follow them.
        """
        inside = {(a, b) for piece in self.ids for a, b in zip(piece, piece[1:])}
        if any(a != SPACE and b == SPACE for a, b in inside):
            return r"(?s).+"
        marks = {c for c in {c for piece in self.ids for c in piece} | set(map(chr, range(128))) if not c.isalnum()} - {" ", SPACE}
        held: set[str] = set()
        while marks:
            before: dict[str, set[str]] = {}
            for a, b in inside:
                if b in marks and a not in marks and a != SPACE:
                    before.setdefault(b, set()).add(a)
            crowded = {mark for mark, letters in before.items() if len(letters) > 3}
            held = set().union(*before.values())
            if not crowded:
                break
            marks -= crowded
        m, h = ("".join(map(re.escape, sorted(s))) for s in (marks, held))
        go_on = rf"(?:[{h}][{m}]*[^ {m}{h}]*)*" if held else ""
        return rf" *[{m}]*[^ {m}{h}]*{go_on}" if marks else r" *[^ ]*"

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: of neighbours that make a piece, the best scored and leftmost merge first."""
        parts = list(text)
        while len(parts) > 1:
            due, at = min((self.due.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if due == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the two tokens' characters again gives the same tokens; ``left`` is empty at the start."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def shorter(self, token: str) -> str:
        """The longest proper prefix that is a piece; a single character stands for itself, and '' ends the row."""
        found = self._shorter.get(token)
        if found is None:
            found = token[:-1]
            while len(found) > 1 and found not in self.ids:
                found = found[:-1]
            if token in self.ids:
                self._shorter[token] = found
        return found

    def tokens(self, segment: str) -> list[str]:
        """The pieces of a segment (spaces as their mark); characters outside the vocabulary stand alone."""
        n = len(segment)
        reach = [1] * n
        for end, length in self.longest.iter(segment):
            reach[end + 1 - length] = length  # of one start the longer matches end later
        shorter, fits, failed = self._shorter, self._fits, bytearray(n // 8 + 1)
        found: list[str] = []
        at, last, token = 0, "", segment[: reach[0]] if n else ""
        while at < n:
            end = at + len(token)
            if not token:  # nothing goes on from here: the last token gives way
                failed[at >> 3] |= 1 << (at & 7)
                token = found.pop()
                at -= len(token)
                last = found[-1] if found else ""
            elif not failed[end >> 3] >> (end & 7) & 1:
                fit = fits.get((last, token))
                if fit or fit is None and self.fits(last, token):
                    found.append(token)
                    at, last = end, token
                    token = segment[at : at + reach[at]] if at < n else ""
                    continue
            known = shorter.get(token)
            token = self.shorter(token) if known is None else known
        return found

    def __missing__(self, segment: str) -> bytes:
        packed = array("i")
        for token in self.tokens(segment.replace(" ", SPACE)):
            known = self.ids.get(token)
            if known is not None:
                packed.append(known)
            else:
                packed.extend(self.bytes[b] for b in token.encode())
        packed = packed.tobytes()
        if len(segment) <= LONGEST:
            if len(self) >= SEGMENTS:
                self.clear()
            self[segment] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian 32-bit integers; a text that is not empty gets one space in front."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        return b"".join(map(self.__getitem__, self.cut.findall(" " + text)))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; one space at the start of the first piece goes.

        Ids whose bytes make no text, and those of control pieces, are left to the library, which has a
        sign for each.
        """
        if self.unseen.isdisjoint(ids):
            try:
                text = b"".join(map(self.shown.__getitem__, ids)).decode()
                return text[1:] if ids and self.library.id_to_piece(ids[0]).startswith(SPACE) else text
            except UnicodeDecodeError:
                pass
        return self.library.decode(ids)


_CODERS: dict[str, PieceCoder] = {}


def piece_coder(path: str) -> PieceCoder:
    """One coder per worker process and model."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encode_texts(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """Add ``ids`` (array<int>) and ``decoded`` (what they decode to) to each document.

    Null and empty texts have no ids and decode to the empty text. Each row is encoded for itself, so
    repeated rows agree; an empty table stays empty; columns called ``ids`` or ``decoded`` are replaced
    and all others kept. No shuffle; a worker remembers a bounded number of segments and pairs, and a
    text of any length is one row of the batch that brought it.
    """
    path = model or public_tokenizers.path(MODEL)

    def coded(texts: list) -> list[pa.Array]:
        coder = piece_coder(path)
        packed = [coder.encode(t or "") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        ids = np.frombuffer(b"".join(packed), "<i4")
        decoded = [coder.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(decoded, pa.string())]

    return map_rows(docs.drop("ids", "decoded"), [text], coded, "ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """Add ``decoded`` (string) to each row of ids; null lists decode to the empty text, null ids are left out."""
    path = model or public_tokenizers.path(MODEL)
    return map_rows(
        encoded.drop("decoded"),
        [ids],
        lambda rows: [[piece_coder(path).decode([i for i in r or [] if i is not None]) for r in rows]],
        "decoded string",
    )


def op11_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_texts(table(spark, folder, "documents").select("doc_id", "text"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
