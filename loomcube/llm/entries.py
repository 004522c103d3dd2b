"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from loomcube.llm import bpe, decontam, importance, jaccard, prefix_trie, quality_rules, secrets, sequenced, sharding, suffix_dedup, toxicity, url_filters, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_importance_resampling": importance.op2_importance_resampling,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_warc": warc.op9_warc,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_secret_scan": secrets.op11_secret_scan,
    "op12_sequenced_changes": sequenced.op12_sequenced_changes,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_sharding": sharding.ORACLE_SQL,
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op4_url_filters": url_filters.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_jaccard_join": jaccard.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
