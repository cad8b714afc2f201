"""The queries of this subpackage, for the registry at the top of the repository."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_byte_bpe
from .chat_format import op7_chat_format
from .fingerprints import op3_fingerprints
from .language_id import op1_language_id
from .license_scan import op2_license_scan
from .near_dedup import op6_near_dedup
from .packing import op5_packing
from .quality_classifier import op4_quality
from .quality_rules import ORACLE as RULES_SQL
from .quality_rules import op9_quality_rules
from .token_output import op8_token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_license_scan": op2_license_scan,
        "op3_fingerprints": op3_fingerprints,
        "op4_quality": op4_quality,
        "op5_packing": op5_packing,
        "op6_near_dedup": op6_near_dedup,
        "op7_chat_format": op7_chat_format,
        "op8_token_output": op8_token_output,
        "op9_quality_rules": op9_quality_rules,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_quality_rules": RULES_SQL}
