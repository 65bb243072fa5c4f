"""The queries of this subpackage, and their SQL where SQL can say the same on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licences, warc
from .decontaminate import op8_decontamination
from .langid import op9_language_id
from .licences import op4_licence_scan
from .lm import op6_lm_scores
from .neardup import op2_minhash_dedup
from .packing import op10_best_fit_packing
from .quality import op1_quality_rules
from .substring import op3_substring_dedup
from .suffix import op5_suffix_dedup
from .warc import op7_warc_revisits

QUERIES = (op1_quality_rules, op2_minhash_dedup, op3_substring_dedup, op4_licence_scan, op5_suffix_dedup, op6_lm_scores, op7_warc_revisits, op8_decontamination, op9_language_id, op10_best_fit_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_licence_scan": licences.oracle(), "op7_warc_revisits": warc.oracle()}
