"""The queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from loupewright.llm import (
    hpylm,
    lexical,
    mixing,
    neighbours,
    prefix_bpe,
    quality,
    sentence_pieces,
    simhash,
    suffix_dedup,
    token_counts,
    token_files,
    toxicity,
    whitening,
)

QUERIES = {
    "op1_hpylm": hpylm.op1_hpylm,
    "op2_prefix_bpe": prefix_bpe.op2_prefix_bpe,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_token_files": token_files.op4_token_files,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_mixing": mixing.op10_mixing,
    "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
    "op12_whitening": whitening.op12_whitening,
    "op13_lexical": lexical.op13_lexical,
}
ORACLES = {
    "op5_quality": quality.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op13_lexical": lexical.ORACLE,
}
