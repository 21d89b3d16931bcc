"""Look-ups of documents, directory profiles and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.config import CONTACT_ROLES
from tallyglass.functions.text import like_pattern
from tallyglass.plans.opportunities import clamped, valid_documents


def shown(profiles: DataFrame) -> DataFrame:
    """Profiles that parsed well or have one of district, county, phone, website."""
    some = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("district", "county", "phone", "website")]
    return profiles.where((F.coalesce("parse_status", F.lit("")) == "ok") | some[0] | some[1] | some[2] | some[3])


def nested_contacts(contacts: DataFrame) -> DataFrame:
    """cds_code, contacts: an array in order of roles, other roles last by name."""
    place = F.nullif(F.array_position(F.array(*[F.lit(r) for r in CONTACT_ROLES]), F.col("role")), F.lit(0))
    item = F.struct(F.coalesce(place, F.lit(99)).alias("p"), *[c for c in ("role", "name", "title", "phone", "email", "source") if c in contacts.columns])
    sorted_ = F.array_sort(F.collect_list(item))
    return contacts.groupBy("cds_code").agg(F.transform(sorted_, lambda x: x.dropFields("p")).alias("contacts"))


def profiles_or_districts(profiles: DataFrame, districts: DataFrame) -> DataFrame:
    """The profiles that can be shown; if there is none at all, the districts in their place."""
    good = shown(profiles).select("cds_code", "county", "district")
    empty = good.limit(1).agg((F.count("*") == 0).alias("_none"))
    fallback = districts.select("cds_code", "county", "district").join(F.broadcast(empty), F.lit(True)).where("_none").drop("_none")
    return good.unionByName(fallback)


def directory_contacts(profiles: DataFrame, contacts: DataFrame, districts: DataFrame, cds_code: object = None, district: str | None = None, county: str | None = None, limit: int = 10) -> DataFrame:
    """Profiles (or districts, if none is found) with their contacts, by code, district or county."""
    if cds_code is None and not district and not county:
        raise ValueError("Provide cds_code, district or county.")

    def of(df: DataFrame) -> DataFrame:
        if cds_code is not None:
            df = df.where(F.col("cds_code") == cds_code)
        if district:
            df = df.where(like_pattern("district", district))
        return df.where(F.col("county") == county) if county else df

    rows = profiles_or_districts(of(profiles), of(districts)).orderBy("district", "cds_code").limit(clamped(limit, 1, 25))
    return rows.join(nested_contacts(contacts), "cds_code", "left").orderBy("district", "cds_code")


def document_order() -> list[Column]:
    """Documents with a file first, then by year (latest first, none last) and district."""
    return [F.when(F.coalesce("pdf_url", F.lit("")) != "", 0).otherwise(1).asc(), F.col("school_year").desc_nulls_last(), F.col("district").asc()]


def plan_documents(documents: DataFrame, cds_code: object = None, district: str | None = None, county: str | None = None, school_year: object = None, limit: int = 10) -> DataFrame:
    if cds_code is None and not district:
        raise ValueError("Provide cds_code or district.")
    rows = valid_documents(documents)
    if cds_code is not None:
        rows = rows.where(F.col("cds_code") == cds_code)
    if district:
        rows = rows.where(like_pattern("district", district))
    if county:
        rows = rows.where(F.col("county") == county)
    if school_year is not None:
        rows = rows.where(F.col("school_year") == school_year)
    return rows.orderBy(*document_order()).limit(clamped(limit, 1, 25))


def district_context(actions: DataFrame, chunks: DataFrame, cds_code: object) -> tuple[DataFrame, DataFrame]:
    """Action count and rounded funds of an account, and its chunks by section."""
    at = F.col("cds_code") == cds_code
    funds = F.round(F.sum(F.coalesce(F.col("total_funds"), F.lit(0)).cast("decimal(18,2)")), 0).cast("double")
    spent = actions.where(at).agg(F.count("*").alias("action_count"), funds.alias("action_funds"))
    return spent, chunks.where(at).groupBy("section_type").agg(F.count("*").alias("chunks")).orderBy(F.col("chunks").desc(), "section_type")
