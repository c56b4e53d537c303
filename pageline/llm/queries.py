"""The queries of this subpackage and their SQL counterparts, where SQL can express them."""

from __future__ import annotations

from pageline.llm import conversations, decontaminate, importance, jaccard, langid, licenses, media, mixing, pii, quality, sharding, substrings, tokens

QUERIES = {
    "op4_personal_data": pii.op4_personal_data,
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op3_quality_rules": quality.op3_quality_rules,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op5_token_ids": tokens.op5_token_ids,
    "op6_language_id": langid.op6_language_id,
    "op7_cube_mix": mixing.op7_cube_mix,
    "op8_media_tiles": media.op8_media_tiles,
    "op10_shards": sharding.op10_shards,
    "op11_licenses": licenses.op11_licenses,
    "op12_conversation_trie": conversations.op12_conversation_trie,
    "op13_importance": importance.op13_importance,
}
ORACLES: dict[str, str] = {
    "op2_substring_dedup": substrings.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op11_licenses": licenses.ORACLE,
    "op12_conversation_trie": conversations.ORACLE,
    "op13_importance": importance.ORACLE,
}
