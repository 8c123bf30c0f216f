"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdance.llm import (
    decontamination,
    line_dedup,
    minhash_dedup,
    ngram_jaccard,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    source_divergence,
    suffix_dedup,
    token_output,
    toxicity,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard": ngram_jaccard.op1,
        "op2_url_filter": url_filter.op2,
        "op3_packing": packing.op3,
        "op4_decontamination": decontamination.op4,
        "op5_suffix_dedup": suffix_dedup.op5,
        "op6_quality_rules": quality_rules.op6,
        "op7_toxicity": toxicity.op7,
        "op8_line_dedup": line_dedup.op8,
        "op9_quality_classifier": quality_classifier.op9,
        "op10_token_output": token_output.op10,
        "op11_source_divergence": source_divergence.op11,
        "op12_prefix_trie": prefix_trie.op12,
        "op13_minhash_dedup": minhash_dedup.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op11_source_divergence": source_divergence.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
    }
