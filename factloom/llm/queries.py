"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import oracles
from factloom.llm.classifier import op9_quality_classifier
from factloom.llm.embeddings import op5_embedding_dedup
from factloom.llm.jaccard import op10_jaccard_join
from factloom.llm.language import op2_language_id
from factloom.llm.mixing import op8_mixing
from factloom.llm.packing import op1_packing
from factloom.llm.quality import op4_quality_rules
from factloom.llm.secrets import op7_secrets
from factloom.llm.sharding import ORACLE as SHARDING_SQL
from factloom.llm.sharding import op3_sharding
from factloom.llm.substring import op6_substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_language_id": op2_language_id,
        "op3_sharding": op3_sharding,
        "op4_quality_rules": op4_quality_rules,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_secrets": op7_secrets,
        "op8_mixing": op8_mixing,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_jaccard_join": op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": SHARDING_SQL,
        "op4_quality_rules": oracles.QUALITY,
        "op5_embedding_dedup": oracles.EMBEDDINGS,
        "op6_substring_dedup": oracles.SUBSTRING,
        "op10_jaccard_join": oracles.JACCARD,
    }
