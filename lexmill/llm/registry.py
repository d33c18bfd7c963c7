"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from lexmill.llm import ann, hmm, linedup, mixing, neardup, packing, quality, rans, suffix, topk

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_hmm": hmm.op2_hmm,
    "op3_neardup": neardup.op3_neardup,
    "op4_line_dedup": linedup.op4_line_dedup,
    "op5_token_ids": rans.op5_token_ids,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_packing": packing.op7_packing,
    "op8_suffix_dedup": suffix.op8_suffix_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_ann": ann.op10_ann,
}

ORACLES = {
    "op3_neardup": neardup.ORACLE,
    "op4_line_dedup": linedup.ORACLE,
    "op6_exact_topk": topk.ORACLE,
    "op8_suffix_dedup": suffix.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
