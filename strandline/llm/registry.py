"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bm25 import op6_bm25_decontamination
from .chat import OP2_SQL, op2_chat_prefix_target
from .minhash import op9_minhash_forest
from .mixing import op8_temperature_mix
from .oracles import OP1_SQL, OP5_SQL, OP6_SQL, OP7_SQL, OP9_SQL
from .quality import OP10_SQL, op10_quality_ledger
from .sharding import op5_minimax_shards
from .substring import op1_suffix_array_dedup, op7_suffix_tree_dedup
from .tokens import op4_token_attribution
from .toxicity import op3_attention_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_chat_prefix_target,
        op3_attention_toxicity,
        op4_token_attribution,
        op5_minimax_shards,
        op6_bm25_decontamination,
        op7_suffix_tree_dedup,
        op8_temperature_mix,
        op9_minhash_forest,
        op10_quality_ledger,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op2_chat_prefix_target": OP2_SQL,
    "op5_minimax_shards": OP5_SQL,
    "op6_bm25_decontamination": OP6_SQL,
    "op7_suffix_tree_dedup": OP7_SQL,
    "op9_minhash_forest": OP9_SQL,
    "op10_quality_ledger": OP10_SQL,
}
