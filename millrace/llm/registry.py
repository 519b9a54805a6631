"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from millrace.llm import decontaminate, exact_dedup, language, mixing, near_dedup, quality, secret_scan, sharding, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_sharding": sharding.op6_sharding,
    "op7_language_id": language.op7_language_id,
    "op8_quality": quality.op8_quality,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_secret_scan": secret_scan.OP5_SQL,
    "op6_sharding": sharding.OP6_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
}
