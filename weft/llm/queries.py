"""The text operators' queries over the whole tables, and their DuckDB oracles."""

from __future__ import annotations

from weft.llm import chat_format, exact_dedup, hmm_lm, language_id, mixing, ngram_join, pii, piece_codec, quality, warc

QUERIES: dict = {
    "op1_ngram_jaccard": ngram_join.op1,
    "op2_language_mixture": language_id.op2,
    "op3_mix_sources": mixing.op3,
    "op4_quality_rules": quality.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_piece_codec": piece_codec.op6,
    "op7_pii": pii.op7,
    "op8_chat_format": chat_format.op8,
    "op9_hmm_lm": hmm_lm.op9,
    "op10_warc_zip": warc.op10,
}
ORACLES: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op10_warc_zip": warc.OP10_SQL,
}
