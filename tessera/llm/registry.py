"""The queries of this subpackage and, where SQL can say the same, their twins."""

from __future__ import annotations

from tessera.llm import chat, exact_dedup, minhash, mixing, neighbours, packing, quality, repeats, secrets, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_chat": chat.op3_chat,
    "op4_minhash": minhash.op4_minhash,
    "op5_repeats": repeats.op5_repeats,
    "op6_packing": packing.op6_packing,
    "op10_neighbours": neighbours.op10_neighbours,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality": quality.op8_quality,
    "op9_secrets": secrets.op9_secrets,
}
ORACLES = {
    "op3_chat": chat.ORACLE_SQL,
    "op4_minhash": minhash.ORACLE_SQL,
    "op5_repeats": repeats.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
}
