"""Queries of this subpackage, by name, and their check SQL."""

from __future__ import annotations

from . import chat, divergence, embedding_dedup, exact_dedup, extraction, line_dedup, minhash, mixing, packing, pieces, quality, search, sharding

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_minhash": minhash.op2_minhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_quality": quality.op5_quality,
    "op6_packing": packing.op6_packing,
    "op7_extraction": extraction.op7_extraction,
    "op8_sharding": sharding.op8_sharding,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_search": search.op11_search,
    "op12_pieces": pieces.op12_pieces,
    "op13_divergence": divergence.op13_divergence,
}
SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_minhash": minhash.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_search": search.OP11_SQL,
    "op13_divergence": divergence.OP13_SQL,
}


def callables() -> dict:
    return dict(QUERIES)


def check_sql() -> dict[str, str]:
    return dict(SQL)
