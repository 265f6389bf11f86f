"""Token counts with overlap resynchronisation of huge documents (operator 3).

A huge text is cut into overlapping chunks that are encoded apart from each other, each with the
offsets of its pieces. Two neighbours are spliced at a boundary that both have in the overlap and
that the cut cannot have moved: the tokenizer scans from the left and its state at a boundary is the
position alone, so from a common boundary on the right chunk goes as the whole text does. Where the
overlap has no such boundary, the left chunk is widened, twice as far each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupewright.llm.common import map_rows, table
from loupewright.llm.pieces import LibraryCoder, library_coder

TOKENIZER = "byte_bpe_50k.json"
#: Characters of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 32_768, 1_024
#: A boundary at least this far before a cut cannot have been moved by it: the pattern looks ahead
#: three characters at most, and a special string that is cut has been shorter than the rest.
_LOOK_AHEAD = 3
LIMIT = 1024


def boundaries(coder: LibraryCoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Piece boundaries of a text (characters, from 0) and the tokens before each."""
    pieces, packed = coder.encode(text)
    ends = np.cumsum([0] + [len(p) for p in pieces])
    return ends.astype(np.int64), np.cumsum([0] + [len(p) >> 2 for p in packed]).astype(np.int64)


def margin(coder: LibraryCoder) -> int:
    return _LOOK_AHEAD + max(map(len, coder.special), default=0)


def splice(coder: LibraryCoder, chunks: list[tuple[str, np.ndarray, np.ndarray]], size: int) -> int:
    """Tokens of the text whose chunks (text, boundaries, tokens before) start every ``size`` characters."""
    edge = margin(coder)
    text, ends, before = chunks[0]
    start, total, entry = 0, 0, 0  # where the left chunk starts, tokens up to its entry, its tokens before the entry
    entry_at = 0
    k = 1
    while k < len(chunks):
        right_text, right_ends, right_before = chunks[k]
        right_start = k * size
        sure = ends[(ends <= len(text) - edge) & (ends >= entry_at - start)] + start
        common = sure[np.isin(sure, right_ends + right_start)]
        if len(common):
            at = int(common[0])
            total += int(before[np.searchsorted(ends, at - start)]) - entry
            entry_at, start = at, right_start
            text, ends, before = chunks[k]
            entry = int(right_before[np.searchsorted(right_ends, at - right_start)])
            k += 1
            continue
        # No common boundary: widen the left chunk into the right one, twice as far each time.
        reach, whole = start + len(text), right_start + len(right_text)
        wanted = min(whole, right_start + 2 * (reach - right_start))
        text += right_text[reach - right_start : wanted - right_start]
        ends, before = boundaries(coder, text)
        entry = int(before[np.searchsorted(ends, entry_at - start)])
        if wanted == whole:  # the right chunk is used up
            k += 1
    return total + int(before[-1]) - entry


def cut(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of ``size`` characters that reach ``overlap`` characters into the next."""
    return [text[i : i + size + overlap] for i in range(0, max(1, len(text)), size)]


def count_spliced(coder: LibraryCoder, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text by chunks, as the job counts huge documents."""
    return splice(coder, [(c, *boundaries(coder, c)) for c in cut(text, size, overlap)], size)


def count_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row, special strings inside texts counting as one token.

    Null and empty texts have no bytes and no tokens; repeated rows are counted each; an empty table
    gives an empty result; other columns are not carried. Texts of up to ``size`` characters are
    encoded where they lie. The chunks of longer ones are spread over the cluster by row and chunk
    number, so one huge document does not hold up a task, and come together by row for the splicing,
    which holds one document.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    plain = plain.withColumn("n_bytes", F.octet_length("text").cast("bigint"))

    def count(texts: list) -> list:
        coder = library_coder(path)
        return [[sum(map(len, coder.encode(t)[1])) >> 2 for t in texts]]

    short = map_rows(plain.where(F.char_length("text") <= size), ["text"], count, "n_tokens long").drop("text")

    def chunked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = cut(t, size, overlap)
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pa.RecordBatch.from_pydict({"row": [row] * len(some), "chunk": list(range(i, i + len(some))), "text": some})

    def encoded(texts: list) -> list:
        coder = library_coder(path)
        found = [boundaries(coder, t) for t in texts]
        return [[e.astype(np.int32).tobytes() for e, _ in found], [b.astype(np.int32).tobytes() for _, b in found]]

    long = plain.where(F.char_length("text") > size).withColumn("row", F.monotonically_increasing_id())
    chunks = long.select("row", "text").mapInArrow(chunked, "row long, chunk long, text string").repartition("row", "chunk")
    marked = map_rows(chunks, ["text"], encoded, "ends binary, before binary")

    def together(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        arrays = lambda c: [np.frombuffer(b, np.int32).astype(np.int64) for b in group[c]]
        n = splice(library_coder(path), list(zip(group["text"], arrays("ends"), arrays("before"))), size)
        return pd.DataFrame({"row": [key[0]], "n_tokens": [n]})

    counted = marked.groupBy("row").applyInPandas(together, "row long, n_tokens long")
    huge = long.select("row", "doc_id", "n_bytes").join(counted, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.union(huge).select(F.col("doc_id").cast(kind).alias("doc_id"), "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
