"""Database tables over JDBC: scans by key range, batched writes, copies of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Database:
    """Where tables are: a JDBC address, and options of its driver (user, password, driver, ...).

    The address must be reachable from all executors: every partition opens its own connection.
    """

    url: str
    options: dict[str, str] = field(default_factory=dict)

    def _reader(self, spark: SparkSession, table: str) -> DataFrameReader:
        return spark.read.format("jdbc").options(**self.options).option("url", self.url).option("dbtable", table).option("fetchsize", 10_000)

    def scan(self, spark: SparkSession, table: str, key: str | None = None, partitions: int = 8) -> DataFrame:
        """A table as a DataFrame; filters and column selection reach the database.

        With a ``key`` column that is a whole number, date or timestamp, the scan has up to
        ``partitions`` tasks, one for each stride between the key's least and greatest value. The
        two are asked of the database as one aggregate, so an index on the key answers them. Rows
        with a null key are in the first stride, and keys that came in since are in the outer ones.
        Strides are even in the key, not in rows: for keys in lumps take more partitions.

        Defined results: an empty table, and one whose keys are all null or equal, is one task. A
        key of another type is refused. Names come as the database tells them, in its letter case.
        """
        whole = self._reader(spark, table).load()
        if not key or partitions < 2:
            return whole
        named = {c.lower(): c for c in whole.columns}
        if key.lower() not in named:
            raise ValueError(f"{table} has no column {key}")
        name = named[key.lower()]
        kind = whole.schema[name].dataType
        whole_number = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)
        if not whole_number and not isinstance(kind, (T.DateType, T.TimestampType)):
            raise ValueError(f"{table}.{name} is {kind.simpleString()}: a key is a whole number, a date or a timestamp")
        quote = "`" if self.url.startswith(("jdbc:mysql", "jdbc:mariadb")) else '"'
        k = f"{quote}{name}{quote}"
        bounds = self._reader(spark, f"(select min({k}) as least_key, max({k}) as most_key from {table}) bounds").load()
        least, most = bounds.select(*[F.col(c).cast("string") for c in bounds.columns]).first()
        if least is None or least == most:
            return whole
        return self._reader(spark, table).options(partitionColumn=name, lowerBound=least, upperBound=most, numPartitions=partitions).load()

    def write(self, df: DataFrame, table: str, append: bool = False, batch: int = 400, connections: int = 8, types: str | None = None) -> None:
        """Rows into a table by batched inserts, at most ``connections`` at once.

        The table is created if it is absent. Unless rows are appended, an existing one is emptied
        by TRUNCATE, so that its types, keys and indexes stay; the schema must then be its own.
        ``types`` gives the types of columns of a new table. A task that is retried is a new
        transaction: each partition's rows come in whole or not at all, but partitions that ended
        before a job failed stay, so a failed write is run again without ``append``.
        """
        writer = df.write.format("jdbc").options(**self.options).option("url", self.url).option("dbtable", table)
        writer = writer.option("batchsize", batch).option("numPartitions", connections)
        writer = writer.option("createTableColumnTypes", types) if types else writer
        (writer.mode("append") if append else writer.mode("overwrite").option("truncate", True)).save()


def copy_tables(spark: SparkSession, source: Database, target: Database, tables: dict[str, str | None], append: bool = False, partitions: int = 8, batch: int = 400) -> None:
    """Tables of one database into another: name -> key column to read it by (None: one task).

    All are emptied unless rows are appended. Each is read and written in parts, none passes through
    the driver.
    """
    for name, key in tables.items():
        target.write(source.scan(spark, name, key, partitions), name, append, batch, partitions)
