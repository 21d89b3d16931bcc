"""A written vector index: unit vectors partitioned by their nearest coarse centroid.

Centroids are fitted on a bounded sample; every row is assigned and written to its cell's folder.
A search reads the folders of the cells nearest to the query and compares exactly within them;
without a number of cells it reads all and is exact. How many cells a recall takes depends on the
vectors: clustered ones need few, random ones in many dimensions most of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.plans.retrieval import cosine_distance, ranked

#: Rows that centroids are fitted on, rounds of fitting, centroids at most.
SAMPLE_ROWS, ROUNDS, MOST_CELLS = 4096, 8, 1024


@dataclass(frozen=True)
class Cells:
    spark: SparkSession
    path: str

    def centroids(self) -> list[tuple[int, list[float]]]:
        """MOST_CELLS rows at most."""
        return [(r["cell"], r["centroid"]) for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()]

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/vectors")
        return df if cells is None else df.where(F.col("cell").isin(cells))

    def nearest_cells(self, query: list[float], n: int) -> list[int]:
        known = self.centroids()
        q = np.array(query, float)
        order = np.argsort([-float(np.dot(q, c)) for _, c in known], kind="stable")
        return [known[k][0] for k in order[:n].tolist()]

    def search(self, query: list[float], limit: int, cells: int | None = None) -> DataFrame:
        """chunk_id, dense_distance (1 less the cosine), dense_rank; of the nearest ``cells`` cells, or of all."""
        rows = self.vectors(None if cells is None else self.nearest_cells(query, cells))
        rows = rows.select("chunk_id", cosine_distance(F.col("unit"), query).alias("dense_distance")).where("dense_distance is not null")
        best = rows.orderBy("dense_distance", "chunk_id").limit(limit)
        return ranked(best, "dense_rank", F.col("dense_distance").asc(), F.col("chunk_id").asc())


def fitted(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of ``k`` cells: spherical rounds from evenly taken rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def build(embeddings: DataFrame, path: str, size: int, cells: int | None = None) -> Cells:
    """Write the index of (chunk_id, embedding). Vectors that are null, of another size, zero or not finite aren't indexed."""
    spark = embeddings.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") == size)).select("chunk_id", v.alias("_v"))
    rows = rows.withColumn("_n", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))).where("_n > 0 and _n < double('infinity')")  # a null component makes the length null
    unit = rows.select("chunk_id", F.transform("_v", lambda x: x / F.col("_n")).alias("unit"))
    n = unit.count()
    k = max(1, min(MOST_CELLS, cells or round(n**0.5), max(n, 1)))
    sample = unit.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_ROWS).select("unit").collect()
    c = fitted(np.array([r["unit"] for r in sample]).reshape(-1, size), min(k, max(len(sample), 1))) if sample else np.zeros((1, size))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ c.T).argmax(1).astype(np.int32))], ["chunk_id", "unit", "cell"])

    kind = unit.schema["chunk_id"].dataType.simpleString()
    done = unit.mapInArrow(task, f"chunk_id {kind}, unit array<double>, cell int")
    # dealt by ranges of cell and id: a cell that a third of the rows are in is many tasks
    done.repartitionByRange("cell", "chunk_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    return Cells(spark, path)
