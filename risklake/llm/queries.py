"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from risklake.llm.decontaminate import OP5_SQL, op5_decontaminate
from risklake.llm.fill_middle import OP11_SQL, op11_fill_middle
from risklake.llm.language_id import op12_language_id
from risklake.llm.license_scan import OP7_SQL, op7_license_scan
from risklake.llm.line_dedup import op10_line_dedup
from risklake.llm.merkle import OP13_SQL, op13_merkle_manifest
from risklake.llm.mixing import OP3_SQL, op3_mix_sources
from risklake.llm.pii import op4_pii_surrogates
from risklake.llm.quality import op8_quality_rules
from risklake.llm.secret_scan import OP6_SQL, op6_secret_scan
from risklake.llm.simhash import op1_simhash_near_dedup
from risklake.llm.substring import op2_substring_dedup
from risklake.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_decontaminate": op5_decontaminate,
    "op6_secret_scan": op6_secret_scan,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_language_id": op12_language_id,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op3_mix_sources": OP3_SQL, "op5_decontaminate": OP5_SQL, "op6_secret_scan": OP6_SQL, "op7_license_scan": OP7_SQL, "op11_fill_middle": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
