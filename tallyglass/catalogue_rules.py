"""Registered queries of single rules over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass import fixtures as fx
from tallyglass.catalogue import query
from tallyglass.functions import classify, numeric, text
from tallyglass.operators import flatten


@query(
    "page_ranges",
    """select o_orderkey, case o_orderkey % 3 when 0 then o_custkey % 40 + 1 when 1 then o_custkey % 40 + 1 else 0 end::int first_page,
    case o_orderkey % 3 when 0 then o_custkey % 40 + 4 when 1 then o_custkey % 40 + 3 else 0 end::int last_page from orders""",
)
def _page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a JSON array out of order, as a range in words, and as a text without number."""
    k, p = F.col("o_orderkey") % 3, F.col("o_custkey") % 40
    n = lambda i: (p + i).cast("string")
    pages = F.when(k == 0, F.concat(F.lit("["), n(4), F.lit(", "), n(1), F.lit("]"))).when(k == 1, F.concat(F.lit("pp. "), n(1), F.lit("-"), n(3))).otherwise("none")
    found = text.let(pages, numeric.page_range)
    return fx.table(spark, d, "orders").select("o_orderkey", found["first"].cast("int").alias("first_page"), found["last"].cast("int").alias("last_page"))


@query(
    "relative_targets",
    """with t as (select l_orderkey, l_linenumber, l_partkey, floor(l_quantity) q, l_linenumber % 6 k, l_returnflag = 'R' lower from lineitem)
    select l_orderkey, l_linenumber, l_partkey, (case k when 0 then -q when 1 then 0 when 2 then case when lower then -q else q end when 3 then case when lower then q else -q end when 4 then q end)::double change from t""",
)
def _relative_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets against the baseline: less, kept, more, reduced, plus, and one that names none."""
    q, k = F.floor("l_quantity").cast("string"), F.col("l_linenumber") % 6
    said = [("Baseline - ", q), ("Maintain", F.lit("")), ("Increase by ", q), ("Reduce by ", q), ("baseline +", q)]
    target = F.lit("To be set")
    for i, (words, amount) in enumerate(said):
        target = F.when(k == i, F.concat(F.lit(words), amount)).otherwise(target)
    rows = fx.spread(fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", target.alias("t"), (F.col("l_returnflag") == "R").alias("lower")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", numeric.relative_target("t", F.col("lower")).alias("change"))


@query(
    "progress_labels",
    """with s as (select o_custkey, count(*) n, count(*) filter (l_returnflag <> 'R') / count(*) p, count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') / count(*) a from lineitem join orders on o_orderkey = l_orderkey group by 1)
    select o_custkey, case when n < 10 then 'Limited evidence' when p >= 0.75 and a <= 0.1 then 'Strong early trajectory' when p >= 0.6 then 'Mostly on track' when p >= 0.45 then 'Mixed trajectory' else 'Needs acceleration' end progress_label from s""",
)
def _progress_labels(spark: SparkSession, d: str) -> DataFrame:
    li, o = fx.table(spark, d, "lineitem"), fx.table(spark, d, "orders")
    share = lambda hit: F.sum(F.when(hit, 1).otherwise(0)) / F.count("*")
    returned = F.col("l_returnflag") == "R"
    by = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(share(~returned).alias("p"), share(returned & (F.col("l_linestatus") == "O")).alias("a"), F.count("*").alias("n"))
    return by.select("o_custkey", numeric.progress_label(F.col("p"), F.col("a"), F.col("n")).alias("progress_label"))


@query(
    "negative_pressures",
    """select l_orderkey, l_linenumber, l_partkey, l_returnflag in ('R', 'A') or l_discount > 0.05 or l_tax >= 0.05 pressed from lineitem""",
)
def _pressures(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "moving_away").when(F.col("l_returnflag") == "A", "off_track")
    pace, moved = F.when(F.col("l_discount") > 0.05, F.col("l_discount")), F.when(F.col("l_tax") >= 0.05, 0.5).otherwise(0.25)
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", classify.negative_pressure(status, pace, moved).alias("pressed"))


@query(
    "nested_indicator_ids",
    """select o_orderkey, case when o_orderkey % 4 = 0 then [1, 2, 3, 4, 5, 6, 7, 8] else list_sort(list_distinct([o_custkey % 9, o_custkey % 5 + 20])) end::int[] ids from orders""",
)
def _nested_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids as number and as text, in nested arrays, beside texts that quote a key; every fourth has none."""
    a, b = (F.col("o_custkey") % 9).cast("string"), (F.col("o_custkey") % 5 + 20).cast("string")
    held = F.concat(F.lit('{"note": "\\"indicatorId\\": 99", "x": [[{"indicatorID": "'), a, F.lit('"}], {"y": {"indicatorId": '), b, F.lit("}}]}"))
    none = F.lit('{"note": "indicatorId", "x": ["indicatorId", 7]}')
    rows = fx.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, none).otherwise(held).alias("body"))
    return rows.select("o_orderkey", flatten.indicator_ids("body").alias("ids"))
