"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontamination, embdedup, extraction, merkle, mixing, neardup, quality, repeats, secrets, sharding, toxicity, turns, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_minhash_dedup": neardup.op2_minhash_dedup,
    "op3_decontaminate": decontamination.op3_decontaminate,
    "op4_extract_html": extraction.op4_extract_html,
    "op5_shard": sharding.op5_shard,
    "op6_warc": warc.op6_warc,
    "op7_embedding_dedup": embdedup.op7_embedding_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_suffix_dedup": repeats.op9_suffix_dedup,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_conversation_repair": turns.op11_conversation_repair,
    "op12_quality_rules": quality.op12_quality_rules,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op6_warc": warc.SQL,
    "op7_embedding_dedup": embdedup.SQL,
    "op10_secret_scan": secrets.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
