"""The registered queries of the subpackage and their SQL."""

from . import bpe, conversation_repair, embedding_dedup, jaccard_join, lm_scoring, merkle, packing, quality_classifier, quality_rules, sharding, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_quality_rules": quality_rules.query,
    "op3_toxicity": toxicity.query,
    "op4_embedding_dedup": embedding_dedup.query,
    "op5_packing": packing.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_byte_bpe": bpe.query,
    "op8_sharding": sharding.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_lm_scoring": lm_scoring.query,
    "op11_suffix_dedup": suffix_dedup.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_merkle": merkle.query,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_embedding_dedup": embedding_dedup.ORACLE,
    "op6_jaccard_join": jaccard_join.ORACLE,
    "op11_suffix_dedup": suffix_dedup.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
