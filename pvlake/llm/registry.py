"""Queries of this subpackage and the SQL that states the same result, where SQL can."""

from __future__ import annotations

import corpus_pipeline
from pvlake.llm import (
    bpe_transducer,
    conversation_trie,
    edit_counts,
    exact_dedup,
    line_dedup,
    minhash_dedup,
    packing,
    pii,
    quality_rules,
    repeat_index,
    source_mix,
    toxicity,
    whitening,
)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_minhash_dedup": minhash_dedup.query,
    "op3_repeat_index": repeat_index.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_edit_counts": edit_counts.query,
    "op7_bpe_transducer": bpe_transducer.query,
    "op8_packing": packing.query,
    "op9_personal_data": pii.query,
    "op10_line_dedup": line_dedup.query,
    "op11_conversation_trie": conversation_trie.query,
    "op12_source_mix": source_mix.query,
    "op13_whitening": whitening.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_conversation_trie": conversation_trie.SQL,
    "op12_source_mix": source_mix.SQL,
}


def queries() -> dict:
    """Every query of the subpackage."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
