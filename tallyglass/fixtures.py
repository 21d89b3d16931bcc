"""Domain views over the test tables: accounts, plans, outcomes, chunks, directory.

The engine's plans take DataFrames with the domain's columns; these functions make them from the
star schema, so that every query runs on any scale of it. All are narrow projections or joins on
keys; column pruning and filters reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, where a table has fewer files than there are cores.

    A file of one row group is one task however many cores there are, and expressions on texts cost
    far more than moving their rows once. Filters would move such expressions back to the one task,
    so they stop at a condition that isn't deterministic. A table of many files is left as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n).where(F.monotonically_increasing_id() >= 0) if len(df.inputFiles()) < n else df


def districts(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("cds_code"), F.col("n_name").alias("county"), F.col("c_name").alias("district"))


def documents(spark: SparkSession, d: str, copies: bool = False) -> DataFrame:
    """Plan documents with their name-match flag; with ``copies`` every fifth account has two."""
    match = F.when(F.col("c_custkey") % 10 == 0, 0).when(F.col("c_custkey") % 7 != 0, 1)
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("cds_code"), F.col("c_name").alias("district"), match.alias("district_name_match"))
    return docs.unionByName(docs.where(F.col("cds_code") % 5 == 0)) if copies else docs


def actions(spark: SparkSession, d: str) -> DataFrame:
    li, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return rows.select(
        F.col("o_custkey").alias("cds_code"),
        key.alias("action_id"),
        F.col("l_orderkey").cast("string").alias("goal_id"),
        F.col("l_linenumber").cast("string").alias("action_number"),
        F.col("p_name").alias("title"),
        F.concat(F.lower("p_type"), F.lit(" "), F.lower("p_brand")).alias("description"),
        F.col("l_extendedprice").alias("total_funds"),
    )


def goals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("cds_code"), F.col("o_orderkey").alias("goal_id"), F.col("o_orderkey").cast("string").alias("goal_number"), F.col("o_orderstatus").alias("goal_type"), F.col("o_orderpriority").alias("description"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics with raw measurement texts made from line items."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = spread(li.join(o, li.l_orderkey == o.o_orderkey))
    whole = lambda c: F.floor(c).cast("int").cast("string")
    q = F.col("l_quantity")
    return rows.select(
        F.col("o_custkey").alias("cds_code"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":m:"), F.col("l_linenumber").cast("string")).alias("metric_id"),
        F.col("l_orderkey").cast("string").alias("goal_number"),
        F.col("l_linenumber").cast("string").alias("metric_number"),
        F.concat(F.when(F.col("l_returnflag") == "R", "Chronic absenteeism rate").otherwise("Graduation rate"), F.lit(" "), F.col("l_linestatus")).alias("metric_name"),
        F.concat(F.lit("All: "), whole(q), F.lit("%")).alias("baseline_raw"),
        F.concat(F.lit("All: "), whole(q + F.col("l_tax") * 100 - 4), F.lit("%")).alias("year_1_outcome_raw"),
        F.lit("").alias("year_2_outcome_raw"),
        F.concat(F.lit("All: "), whole(q + F.when(F.col("l_returnflag") == "R", -3).otherwise(3)), F.lit("%")).alias("year_3_target_raw"),
        F.concat(F.lit("All: "), whole(F.col("l_tax") * 100 - 4), F.lit("%")).alias("current_difference_from_baseline_raw"),
    )


def exact_mean(value: Column) -> Column:
    """The mean of amounts in cents: summed as decimals, so it doesn't depend on the order of rows."""
    return F.try_divide(F.sum(value.cast("decimal(18,2)")).cast("double"), F.count(value))


def indicators(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes: per account and event type the mean, and its change between two halves."""
    late = F.col("ts") >= F.expr(f"timestamp_ntz'{SPLIT}'")
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("cds_code"), F.col("event_type").alias("indicator_name")).agg(
        exact_mean(F.col("value")).alias("status"),
        (exact_mean(F.when(late, F.col("value"))) - exact_mean(F.when(~late, F.col("value")))).alias("change"),
        F.count("*").alias("count"),
        F.sum(F.when(F.col("value") >= 10, 1).otherwise(0)).alias("chronic_count"),
    ).withColumn("student_group", F.lit("ALL"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Narrative chunks: the text table, with its source as section type and language as district."""
    t = spread(table(spark, d, "documents"))
    return t.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("district"), F.col("source").alias("section_type"), F.col("text").alias("search_text"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in sections: conversations and their turns."""
    t = table(spark, d, "conversations")
    return t.select(
        F.col("conv_id").cast("string").alias("section_id"),
        F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 10, F.lit("0")), F.lpad(F.col("turn").cast("string"), 6, F.lit("0"))).alias("chunk_id"),
        F.col("turn").alias("page_start"),
        F.col("turn").alias("page_end"),
        F.col("turn").alias("chunk_index"),
        F.col("role").alias("section_type"),
        F.col("text").alias("body_text"),
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Directory profiles of suppliers; every fourth was parsed well, every sixth lacks all fields."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey)
    blank = F.col("s_suppkey") % 6 == 0
    return rows.select(
        F.col("s_suppkey").alias("cds_code"),
        F.when(~blank, F.col("s_name")).alias("district"),
        F.when(~blank, F.col("n_name")).alias("county"),
        F.lit(None).cast("string").alias("phone"),
        F.lit(None).cast("string").alias("website"),
        F.when(F.col("s_suppkey") % 4 == 0, "ok").otherwise("error").alias("parse_status"),
    )


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of suppliers: one to four roles each, one of them unknown to the order of roles."""
    roles = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("role")) for k, r in enumerate(("administrator", "cds_coordinator", "chief_business_official", "superintendent"))])
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(roles).alias("r")).where((F.col("s_suppkey") + F.col("r.k")) % 3 != 0)
    return s.select(F.col("s_suppkey").alias("cds_code"), F.col("r.role").alias("role"), F.concat_ws(" ", F.col("r.role"), F.col("s_suppkey").cast("string")).alias("name"))
