"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from stratalog.llm import chunks, decontaminate, language, near, pieces, pii, quality, secrets, suffixtree, topk


def queries() -> dict:
    return {
        "op1_chunks": chunks.query,
        "op10_topk": topk.query,
        "op2_quality": quality.query,
        "op3_pii": pii.query,
        "op4_language": language.query,
        "op5_secrets": secrets.query,
        "op6_near": near.query,
        "op7_decontaminate": decontaminate.query,
        "op8_suffixtree": suffixtree.query,
        "op9_pieces": pieces.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_topk": topk.SQL,
        "op3_pii": pii.SQL,
        "op5_secrets": secrets.SQL,
        "op7_decontaminate": decontaminate.SQL,
    }
