"""Upserts as joins: each returns the new state of the target as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETAIL_SOURCE = "school_directory_detail"


def _last(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key: the last by an order column, else any of equal ones."""
    if order is None:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_l")).select(*keys, *[F.col(f"_l.`{c}`").alias(c) for c in rest]).select(*df.columns)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Incoming rows replace target rows of the same key; the last incoming row of a key wins."""
    new = _last(incoming, keys, order).select(*target.columns)
    return target.join(new.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new)


def replace_children(target: DataFrame, parents: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All children of the given parents go; the incoming children are what there is of them."""
    return target.join(parents.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(incoming.select(*target.columns))


def guarded_upsert(target: DataFrame, incoming: DataFrame, keys: list[str], blocked: Column, untouched: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Upsert where rows of the target that are ``blocked`` stay, and ``untouched`` columns always do.

    ``blocked`` is an expression over the target's columns; null counts as not blocked.
    """
    new = _last(incoming, keys, order)
    t = target.withColumn("_blocked", F.coalesce(blocked, F.lit(False))).withColumn("_old", F.lit(True))
    rest = [c for c in target.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest if c in new.columns], F.lit(True).alias("_new"))
    both = t.join(n, keys, "full")
    take = F.col("_new").isNotNull() & ~F.coalesce("_blocked", F.lit(False))

    def value(c: str) -> Column:
        fresh = F.col(f"_n_{c}") if c in new.columns else F.lit(None).cast(target.schema[c].dataType)
        if c in untouched:
            return F.when(F.col("_old").isNull(), fresh).otherwise(F.col(c))
        return F.when(take, fresh).otherwise(F.col(c))

    return both.select(*[F.col(k) for k in keys], *[value(c).alias(c) for c in rest]).select(*target.columns)


def directory_upsert(target: DataFrame, incoming: DataFrame, detail: str = DETAIL_SOURCE) -> DataFrame:
    """Profiles from a coarser source: a good detail row stays, and finer fields are never touched."""
    good = (F.col("source") == detail) & (F.col("parse_status") == "ok")
    finer = tuple(c for c in ("email", "website", "low_grade", "high_grade", "nces_district_id") if c in target.columns)
    return guarded_upsert(target, incoming, ["cds_code"], good, finer)


def contacts_upsert(target: DataFrame, incoming: DataFrame, detail: str = DETAIL_SOURCE) -> DataFrame:
    """Contacts replace all but those of the detail source (a null source counts as another one)."""
    return guarded_upsert(target, incoming, ["cds_code", "role"], F.col("source").eqNullSafe(detail))


def failure_upsert(target: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures (cds_code, message) marked on profiles that aren't ok: blocked on a captcha, else error."""
    rows = failures.select("cds_code", F.when(F.lower("message").contains("captcha"), "blocked").otherwise("error").alias("parse_status"), F.left("message", F.lit(500)).alias("parse_error"))
    changed = ("parse_status", "parse_error")
    kept = tuple(c for c in target.columns if c not in ("cds_code", *changed))
    return guarded_upsert(target, rows, ["cds_code"], F.col("parse_status").eqNullSafe("ok"), kept)


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The new state, and the incoming keys with ``created``: whether they were new."""
    new = _last(incoming, keys, order)
    absent = new.join(target.select(*keys), keys, "left_anti").select(*target.columns)
    known = target.select(*keys).distinct().withColumn("_k", F.lit(True))
    told = new.join(known, keys, "left").select(*keys, F.col("_k").isNull().alias("created"))
    return target.unionByName(absent), told


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str, dimensions: int, limit: int | None = None, text: str = "search_text") -> DataFrame:
    """Chunks with a text that have no embedding of the model and size, in order of their ids."""
    own = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_dimensions") == dimensions))
    rows = chunks.where(F.trim(F.coalesce(text, F.lit(""))) != "").join(own.select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id")
    return rows.limit(limit) if limit else rows


def embedding_progress(chunks: DataFrame, embeddings: DataFrame, model: str, dimensions: int) -> DataFrame:
    own = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_dimensions") == dimensions))
    return chunks.agg(F.count("*").alias("chunks")).join(own.agg(F.count("*").alias("embeddings")), F.lit(True))


def cache_probe(chunks: DataFrame, cache: DataFrame, model: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Chunks whose vector is cached under model, size and text hash, and those that aren't."""
    key = F.concat_ws(":", F.lit(model), F.lit(str(dimensions)), F.col("text_hash"))
    rows = chunks.withColumn("cache_key", key)
    return rows.join(cache.select("cache_key", "embedding"), "cache_key"), rows.join(cache.select("cache_key"), "cache_key", "left_anti")


def missing_details(districts: DataFrame, profiles: DataFrame, detail: str = DETAIL_SOURCE) -> DataFrame:
    """Accounts without a good detail page, by three-valued logic: those without any profile drop out.

    The condition is ``not (source = detail and status = 'ok')`` over a left join; it is null, and so
    not true, where there is no profile.
    """
    p = profiles.select("cds_code", "source", "parse_status")
    good = (F.col("source") == detail) & (F.col("parse_status") == "ok")
    return districts.select("cds_code").join(p, "cds_code", "left").where(~good).select("cds_code").distinct()


def active_codes(districts: DataFrame, limit: int, start_after: str | None = None) -> DataFrame:
    """Codes of active district offices with a plan or a dashboard, after a code, in order."""
    on = F.col("cds_code").like("%0000000") & (F.coalesce("status_type", F.lit("Active")) == "Active")
    used = (F.coalesce("has_lcap", F.lit(0)) == 1) | (F.coalesce("has_dashboard", F.lit(0)) == 1)
    rows = districts.where(on & used)
    if start_after:
        rows = rows.where(F.col("cds_code") > start_after)
    return rows.select("cds_code").distinct().orderBy("cds_code").limit(limit)
