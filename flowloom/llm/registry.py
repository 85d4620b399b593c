"""Queries of the training-data operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from flowloom.llm import bpe, brown, chat, codes, fingerprint, jaccard, langid, mixing, packing, quality, search, secrets, suffixes


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality": quality.op2_quality,
        "op3_bpe": bpe.op3_bpe,
        "op4_chat": chat.op4_chat,
        "op5_fingerprint": fingerprint.op5_fingerprint,
        "op6_suffixes": suffixes.op6_suffixes,
        "op7_brown": brown.op7_brown,
        "op8_secrets": secrets.op8_secrets,
        "op9_langid": langid.op9_langid,
        "op10_jaccard": jaccard.op10_jaccard,
        "op11_codes": codes.op11_codes,
        "op12_packing": packing.op12_packing,
        "op13_search": search.op13_search,
    }


def oracle_sql():
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op2_quality": quality.OP2_SQL,
        "op4_chat": chat.OP4_SQL,
        "op5_fingerprint": fingerprint.OP5_SQL,
        "op8_secrets": secrets.OP8_SQL,
        "op11_codes": codes.OP11_SQL,
        "op13_search": search.OP13_SQL,
    }
