"""Keep-first, merging and stratified picks, always by an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.text import normal_lines


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. A grouped minimum, so equal keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    named = [(c if isinstance(c, Column) else F.col(c)).alias(f"_o{k}") for k, c in enumerate(order)]
    simple = all(t.simpleString() not in ("variant",) and not t.simpleString().startswith("map") for t in (df.schema[c].dataType for c in rest))
    if simple:
        firsts = df.groupBy(*keys).agg(F.min(F.struct(*named, *rest)).alias("_f"))
        return firsts.select(*keys, *[F.col(f"_f.`{c}`").alias(c) for c in rest]).select(*df.columns)
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r")


def first_of_each(df: DataFrame, groups: list[str], k: int, order: list[Column | str]) -> DataFrame:
    """The first k rows of each group (a stratified sample by order)."""
    return df.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("sample_rank") <= k)


def merged_text(existing: Column, incoming: Column) -> Column:
    """Two texts as one: the one that holds the other, else both on two lines."""
    a, b = normal_lines(existing, zero_width=False), normal_lines(incoming, zero_width=False)
    return F.when(b == "", a).when(a == "", b).when(F.contains(a, b), a).when(F.contains(b, a), b).otherwise(F.concat(a, F.lit("\n"), b))


def merge_records(df: DataFrame, keys: list[str], order: str = "ord", pages: str = "source_pages") -> DataFrame:
    """Rows of a key as one: page sets united, every other column its first value that isn't empty."""
    rest = [c for c in df.columns if c not in (*keys, order, pages)]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order)))
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages))))
    return df.groupBy(*keys).agg(F.min(order).alias(order), *[first(c).alias(c) for c in rest], united.alias(pages))


def merge_actions(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Action rows of a key as one: descriptions merged in order, first funds, pages united."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("description", F.lit("")).alias("d")))), lambda x: x["d"])
    funds = F.min_by("total_funds", F.when(F.col("total_funds").isNotNull(), F.col(order)))
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_pages"))))
    out = df.groupBy(*keys).agg(F.min(order).alias(order), texts.alias("_t"), funds.alias("total_funds"), pages.alias("source_pages"))
    return out.withColumn("description", F.aggregate("_t", F.lit(""), merged_text)).drop("_t")
