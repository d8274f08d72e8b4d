"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, bm25, bpe, chat, langid, lmtrie, mixing, pii, prefix_trie, repetition, sharding, simhash, sql, substrings


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_repetition": repetition.op2_repetition,
        "op3_bm25": bm25.op3_bm25,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_mixing": mixing.op5_mixing,
        "op6_sharding": sharding.op6_sharding,
        "op7_langid": langid.op7_langid,
        "op8_lm_score": lmtrie.op8_lm_score,
        "op9_pii": pii.op9_pii,
        "op10_simhash": simhash.op10_simhash,
        "op11_substrings": substrings.op11_substrings,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_repetition": sql.OP2, "op3_bm25": sql.OP3}
