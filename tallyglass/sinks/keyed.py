"""Tables kept by key hash: a change reads and rewrites only the partitions that hold its keys.

A table is a Parquet folder partitioned by ``_bucket``, the hash of its keys modulo a fixed number
of buckets. A change is any function of the old rows and the incoming rows of the touched buckets
(the upserts of ``operators.upsert`` are such functions). Buckets whose rows stay what they were
aren't written, so a change that is run again rewrites nothing. Files of several writers at once
aren't guarded: one change at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass(frozen=True)
class Keyed:
    """A table of ``buckets`` partitions by the hash of ``keys``. Keep keys and buckets for its life."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def bucket(self, *keys: Column | str) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        return self._folder(self.path)[0].exists(self._folder(self.path)[1])

    def _folder(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def create(self, df: DataFrame, dealt: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write all rows anew; ``dealt`` makes them of rows that were dealt to their buckets, which it keeps."""
        self._write(df.withColumn("_bucket", self.bucket()), "overwrite", dealt)

    def _write(self, rows: DataFrame, mode: str, made: Callable[[DataFrame], DataFrame] | None = None) -> None:
        dealt = rows.repartition("_bucket").sortWithinPartitions("_bucket", *self.keys)
        dealt = made(dealt) if made else dealt
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic" if mode == "overwrite" and self.exists() else "static").partitionBy("_bucket").parquet(self.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of some buckets only if given: the other folders aren't listed for the scan."""
        df = self.spark.read.parquet(self.path)
        return df.where(F.col("_bucket").isin(buckets)) if buckets is not None else df

    def touched(self, incoming: DataFrame) -> list[int]:
        """The buckets of the incoming keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in incoming.select(self.bucket().alias("b")).distinct().collect())

    def change(self, incoming: DataFrame, by: Callable[[DataFrame, DataFrame], DataFrame], touched: list[int] | None = None, dealt: Callable[[DataFrame], DataFrame] | None = None) -> list[int]:
        """Make the rows of the touched buckets what ``by(old, incoming)`` says; the buckets rewritten.

        ``by`` may add and remove rows, but only ones of the touched buckets. ``dealt`` is as in ``create``.
        """
        if not self.exists():
            empty = incoming.limit(0)
            self.create(by(empty, incoming), dealt)
            return self.touched(self.read())
        touched = self.touched(incoming) if touched is None else touched
        if not touched:
            return []
        old = self.read(touched)
        columns = [c for c in old.columns if c != "_bucket"]
        # written once beside the table: neither the comparison nor the change works out the new rows again
        staged = Keyed(self.spark, f"{self.path}-staged-{uuid.uuid4().hex}", self.keys, self.buckets)
        new = by(old.select(*columns), incoming)
        staged.create(new if dealt else new.select(*columns), dealt)
        try:
            changed = self._differing(old.select(*columns, "_bucket"), self.spark.read.schema(old.schema).parquet(staged.path))
            for b, n in changed.items():
                fs, p = self._folder(f"{self.path}/_bucket={b}")
                fs.delete(p, True)
                if n and not fs.rename(self._folder(f"{staged.path}/_bucket={b}")[1], p):
                    raise OSError(f"{p} could not be replaced")
        finally:
            fs, p = self._folder(staged.path)
            fs.delete(p, True)
        return sorted(changed)

    def _differing(self, old: DataFrame, new: DataFrame) -> dict[int, int]:
        """Buckets whose rows differ, with their new number of rows: by counts and two sums of row hashes."""
        columns = [c for c in old.columns if c != "_bucket"]
        kinds = dict(old.dtypes)

        def print_of(df: DataFrame, name: str) -> DataFrame:
            row = [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`").cast(kinds[c]) for c in columns]).cast("decimal(20,0)") for seed in (1, 2)]
            return df.groupBy("_bucket").agg(F.struct(F.count("*").alias("n"), F.sum(row[0]).alias("a"), F.sum(row[1]).alias("b")).alias(name))

        both = print_of(old, "_old").join(print_of(new, "_new"), "_bucket", "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
        return {r["_bucket"]: r["_new"]["n"] if r["_new"] else 0 for r in both.collect()}  # at most ``buckets`` rows

    def upsert(self, incoming: DataFrame, order: str | None = None) -> list[int]:
        """Incoming rows replace rows of the same keys, or are added."""
        from tallyglass.operators.upsert import upsert

        return self.change(incoming, lambda old, new: upsert(old, new, list(self.keys), order))

    def insert_absent(self, incoming: DataFrame, order: str | None = None) -> list[int]:
        """Add the incoming rows whose keys the table doesn't have."""
        from tallyglass.operators.upsert import insert_if_absent

        return self.change(incoming, lambda old, new: insert_if_absent(old, new, list(self.keys), order)[0])

    def replace_children(self, parents: DataFrame, incoming: DataFrame, key: str) -> list[int]:
        """All rows of the given parents give way to the incoming ones. The table is kept by ``key`` alone."""
        if self.keys != (key,):
            raise ValueError(f"rows of a parent share a bucket only if the table is kept by {key}")
        from tallyglass.operators.upsert import replace_children

        both = self.touched(parents.select(key).unionByName(incoming.select(key)))
        return self.change(incoming, lambda old, new: replace_children(old, parents, new, key), both)
