"""Tables in a database over JDBC; Derby, which comes with Spark, stands for it."""

import pytest
from pyspark.sql import functions as F

from tallyglass.sources.database import Database, copy_tables

TABLES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}


@pytest.fixture
def database(tmp_path):
    return Database(f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})


def lower(df):
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


def test_tables_come_back_whole_in_parts(spark, sf, database, tmp_path):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in TABLES}
    for name, df in tables.items():
        database.write(df, name)
    other = Database(f"jdbc:derby:{tmp_path}/other;create=true", database.options)
    copy_tables(spark, database, other, TABLES, partitions=4)
    copy_tables(spark, database, other, TABLES, partitions=4)  # emptied first: rows aren't doubled
    for name, df in tables.items():
        back = lower(other.scan(spark, name, TABLES[name], 4))
        assert back.rdd.getNumPartitions() == 4
        assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect())), name


def test_filters_and_columns_reach_the_database(spark, sf, database):
    database.write(spark.read.parquet(f"{sf}/customer.parquet"), "customer")
    rows = database.scan(spark, "customer", "c_custkey", 3).where(F.col("c_custkey") > 10).select("c_custkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_custkey,10)" in plan.replace("`", "").replace('"', "") and "c_name" not in plan


def test_append_truncate_and_keys(spark, database):
    rows = spark.createDataFrame([(1, "a", "2024-01-01"), (None, None, None), (9, "é'\"", "2024-03-05")], "k long, s string, d string").withColumn("d", F.col("d").cast("date"))
    database.write(rows, "t")
    database.write(rows, "t", append=True)
    for key in ("k", "d", None):
        assert sorted(map(str, database.scan(spark, "t", key, 5).collect())) == sorted(map(str, rows.unionAll(rows).collect()))
    database.write(rows.where("k = 1"), "typed", types="s varchar(50)")
    assert lower(database.scan(spark, "typed", "k")).select("s").first().s == "a"
    database.write(rows.limit(0), "t")
    empty = database.scan(spark, "t", "k")
    assert empty.count() == 0 and empty.rdd.getNumPartitions() == 1
    with pytest.raises(ValueError, match="no column"):
        database.scan(spark, "t", "absent")
    with pytest.raises(ValueError, match="whole number"):
        database.scan(spark, "t", "s")
