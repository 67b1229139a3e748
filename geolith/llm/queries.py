"""The registered queries of the ten operators, with SQL where it can express them."""

from __future__ import annotations

from geolith.llm import bpe, chat, langid, media, packing, quality, simhash, suffixes, tokenstore, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_token_orc": tokenstore.op2_token_orc,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_suffix_array_dedup": suffixes.op4_suffix_array_dedup,
    "op5_media_copies": media.op5_media_copies,
    "op6_language_id": langid.op6_language_id,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_bpe_encode": bpe.op9_bpe_encode,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLES: dict[str, str] = {}
