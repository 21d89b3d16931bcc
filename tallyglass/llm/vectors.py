"""Packed blocks of vectors and their meeting with packed queries, for the vector operators.

A block is one row: ids, labels and components of up to some thousand vectors as bytes. Blocks
and the queries that have to see them are sorted together, so a task reads a block once, keeps
it, and passes the queries by it one packed row after another; neither side is a group in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    """Partitions for work that is heavy by row: never merged by size, as the cluster sets them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def met(blocks: DataFrame, asks: DataFrame, on: list[str], task: Callable[[dict, dict], Iterator[dict]], schema: str, rows: int = 8) -> DataFrame:
    """The rows of ``task(block, ask)`` for every ask with a block of the same key.

    Both sides are packed rows and a key has one block, so a task holds one block and one Arrow
    batch of ``rows`` rows. A key with many asks passes them in turn.
    """
    both = blocks.select(*on, F.lit(0).alias("_kind"), F.struct("*").alias("_block"), F.lit(None).cast(asks.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_ask"))
    both = both.unionByName(asks.select(*on, F.lit(1).alias("_kind"), F.struct("*").alias("_ask")), allowMissingColumns=True)
    both = both.repartition(partitions(blocks.sparkSession), *on).sortWithinPartitions(*on, "_kind")
    target = pa_schema(blocks.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for b in batches:
            for start in range(0, b.num_rows, rows):
                for r in b.slice(start, rows).to_pylist():
                    own = tuple(r[c] for c in on)
                    if r["_kind"] == 0:
                        key, block = own, r["_block"]
                    elif own == key:
                        for out in task(block, r["_ask"]):
                            yield pa.RecordBatch.from_pydict(out, schema=target)

    return both.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, as longs."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_by_row(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each row: higher scores, then smaller ids."""
    order = np.lexsort((ident, -score, row))
    r = row[order]
    start = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    at = np.arange(len(r)) - np.maximum.accumulate(np.where(start, np.arange(len(r)), 0)) if len(r) else np.zeros(0, int)
    return order[at < k]
