"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op7_decontamination
from .katz import op2_katz
from .ngram_join import op9_ngram_join
from .packing import instruction_packing, op4_packing
from .quality import op8_quality
from .spotsigs import op6_spotsigs
from .substring_dedup import op3_substring_dedup
from .token_counts import op5_token_counts
from .token_store import op10_token_store
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_katz": op2_katz,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_spotsigs": op6_spotsigs,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_store": op10_token_store,
    "instruction_packing": instruction_packing,
}

ORACLE_SQL: dict[str, str] = {}
