"""Incremental loads: new chunk files are upserted as they land, restarting where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyglass.operators.dedup import keep_first


def load_chunks(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, key: str = "chunk_id") -> StreamingQuery:
    """Append chunks of new JSON files whose key the target doesn't have; runs until none is left.

    Each batch is anti-joined against the target, so a batch that is run again adds nothing.
    """
    stream = spark.readStream.schema(schema).json(landing)

    def add(batch: DataFrame, _: int) -> None:
        rows = keep_first(batch.where(F.col(key).isNotNull()), [key], [F.xxhash64(*batch.columns)])
        try:
            known = batch.sparkSession.read.schema(batch.schema).parquet(target).select(key)
            rows = rows.join(known, key, "left_anti").select(*batch.columns)
        except Exception as e:  # noqa: BLE001  the first batch finds no target yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
