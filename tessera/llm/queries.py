"""The operators' queries, and their SQL where SQL expresses them."""

from __future__ import annotations

from . import op1_substrings, op2_lines, op3_bpe, op4_quality, op5_lm, op6_minhash, op7_topk, op8_decontaminate, op9_sharding, op10_toxicity
from . import op11_repetition, op12_conversations, op13_fim

QUERIES = {
    "op1_suffix_dedup": op1_substrings.query,
    "op2_line_dedup": op2_lines.query,
    "op3_bpe": op3_bpe.query,
    "op4_quality": op4_quality.query,
    "op5_lm_scoring": op5_lm.query,
    "op6_minhash": op6_minhash.query,
    "op7_topk": op7_topk.query,
    "op8_decontaminate": op8_decontaminate.query,
    "op9_sharding": op9_sharding.query,
    "op10_toxicity": op10_toxicity.query,
    "op11_repetition": op11_repetition.query,
    "op12_conversations": op12_conversations.query,
    "op13_fim": op13_fim.query,
}

ORACLE_SQL = {
    "op7_topk": op7_topk.ORACLE,
    "op9_sharding": op9_sharding.ORACLE,
    "op11_repetition": op11_repetition.ORACLE,
    "op12_conversations": op12_conversations.ORACLE,
    "op13_fim": op13_fim.ORACLE,
}
