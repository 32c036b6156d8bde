"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import op01_shard, op02_token_ids, op03_chat, op04_licenses, op05_pii, op06_simhash, op07_decontaminate, op08_embeddings, op09_quality, op10_pieces

QUERIES = {
    "op1_shard": op01_shard.query,
    "op2_token_ids": op02_token_ids.query,
    "op3_chat": op03_chat.query,
    "op4_licenses": op04_licenses.query,
    "op5_pii": op05_pii.query,
    "op6_simhash": op06_simhash.query,
    "op7_decontaminate": op07_decontaminate.query,
    "op8_embeddings": op08_embeddings.query,
    "op9_quality": op09_quality.query,
    "op10_pieces": op10_pieces.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat": op03_chat.ORACLE_SQL,
    "op7_decontaminate": op07_decontaminate.ORACLE_SQL,
    "op8_embeddings": op08_embeddings.ORACLE_SQL,
}
