"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over its whole table."""
    from tallyglass.llm import byte_bpe, centroid_clusters, decontaminate, hard_negatives, language_id, license_scan, line_dedup, near_dedup, nearest, passages, pseudonyms, quality, token_counts

    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_pseudonyms": pseudonyms.op2_pseudonyms,
        "op7_substring_dedup": passages.op7_substring_dedup,
        "op8_license_scan": license_scan.op8_license_scan,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op5_quality_rules": quality.op5_quality_rules,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op6_language_id": language_id.op6_language_id,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
        "op11_centroid_clusters": centroid_clusters.op11_centroid_clusters,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_nearest_neighbours": nearest.op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    from tallyglass.llm import centroid_clusters, decontaminate, hard_negatives, license_scan, line_dedup

    return {"op3_decontaminate": decontaminate.ORACLE, "op8_license_scan": license_scan.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_centroid_clusters": centroid_clusters.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
