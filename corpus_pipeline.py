"""The corpus pipeline: five stages over documents, each reread from what the last one wrote.

Language identification drops documents whose language it rejects; line deduplication takes
cross-site boilerplate out of the texts; near deduplication keeps one document of each group of
near copies; decontamination drops documents that hold a benchmark item; encoding adds ids.

Defined results: an empty table stays empty (language identification then has nothing to learn
and passes no row on); null texts are rejected by the first stage; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyglass.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dedup
from tallyglass.llm.common import table, written

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: Language identification and encoding are beyond SQL: tests hold the near-dedup and encoding stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
