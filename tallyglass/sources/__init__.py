"""Readers of landed files: directory TSV, JSON of two shapes, JSON lines, CSV, page texts, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.text import blocked_page, clean, code_of, field, html_fields, html_lines
from tallyglass.operators.flatten import PLAN, directory_rows, packages


def directory_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Districts of a directory export (tab separated, with header)."""
    return directory_rows(spark.read.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))


def plans_json(spark: SparkSession, path: str) -> DataFrame:
    """Parsed plans from a list or ``{"districts": [...]}``, with the ordinal ``ord``."""
    return _listed(spark, path, "districts", PLAN)


MANIFEST = "cds_code string, cd_code string, county string, district string, doc string, doc_type string, status_type string, has_lcap boolean, pdf_url string, output_path string, cds_index_path string"


def manifest_json(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Manifest records from a list or ``{"records": [...]}``, with the ordinal ``ord``."""
    return _listed(spark, path, "records", schema)


def _listed(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Elements of a JSON array, or of the array under a key, of each file; files are whole texts."""
    texts = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", f"array<struct<{schema}>>")
    under = F.from_json("value", f"struct<{key}:array<struct<{schema}>>>")[key]
    rows = texts.select(F.input_file_name().alias("_file"), F.posexplode(F.when(F.ltrim("value").startswith("["), plain).otherwise(under)).alias("ord", "x"))
    return rows.where("x is not null").select("ord", "x.*")


def dashboard_json(spark: SparkSession, path: str) -> DataFrame:
    """Outcome packages, one JSON file each; a package without code takes its file's stem."""
    texts = spark.read.text(path, wholetext=True).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))
    return packages(texts, "value", "stem")


def chunks_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, limit: int | None = None) -> DataFrame:
    """Chunks of JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema).alias("x")).select("x.*")
    return rows.limit(limit) if limit else rows


def table_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header, all columns text unless a schema is given; quotes may span lines."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def pages_of(texts: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Page texts as (doc, page_number, text); failed pages are empty texts."""
    return texts.select(F.col(doc).alias("doc"), F.col(page).cast("int").alias("page_number"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def landed_files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """Binary files (path, length, content) below a folder, for an extractor of one's own."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)


def public_districts(rows: DataFrame, county: str | None = None, district: str | None = None, codes: list[str] | None = None, active: bool = True, limit: int | None = None) -> DataFrame:
    """Directory rows by county (case ignored), part of the district's name, codes and status."""
    if county:
        rows = rows.where(F.lower("county") == county.strip().lower())
    if district:
        rows = rows.where(F.lower("district").contains(district.strip().lower()))
    if codes:
        rows = rows.where(F.col("cds_code").isin(*codes))
    if active:
        rows = rows.where(F.lower("status_type") == "active")
    return rows.orderBy("cds_code").limit(limit) if limit else rows


# Labels of a directory page and the columns they fill.
DETAIL_LABELS = {
    "county": "county",
    "district": "district",
    "district_address": "district address",
    "mailing_address": "mailing address",
    "phone": "phone number",
    "fax": "fax number",
    "email": "email",
    "website": "web address",
    "status": "status",
    "district_type": "district type",
    "low_grade": "low grade",
    "high_grade": "high grade",
    "nces_district_id": "nces/federal district id",
    "last_updated": "last updated",
}
# Labels of contacts and their roles.
CONTACT_LABELS = {"superintendent": "superintendent", "chief_business_official": "chief business official", "cds_coordinator": "cds coordinator"}


def directory_pages(pages: DataFrame, html: str = "html", source: str = "school_directory_detail") -> DataFrame:
    """Directory pages to profiles, with parse_status: ok, blocked (a captcha), or error (no code)."""
    fields = html_fields(html)
    rows = pages.withColumns({"_f": fields, "_blocked": blocked_page(html)})
    digits = F.regexp_replace(field("_f", "cds code"), r"\D", "")
    code = F.coalesce(F.nullif(code_of(digits), F.lit("")), code_of(F.array_join(html_lines(html), " ")))
    status = F.when(F.col("_blocked"), "blocked").when(code == "", "error").otherwise("ok")
    one = lambda label: F.translate(field("_f", label), "\n", " ")
    return rows.select(*pages.columns, code.alias("cds_code"), *[one(label).alias(out) for out, label in DETAIL_LABELS.items()], status.alias("parse_status"), F.lit(source).alias("source"), F.col("_f").alias("fields"))


def directory_contacts(profiles: DataFrame) -> DataFrame:
    """Contacts of parsed pages, one per role with a name: lines are name, title, phone, email."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), field("fields", label).alias("text")) for r, label in CONTACT_LABELS.items()])
    rows = profiles.where("parse_status = 'ok'").select("cds_code", "source", F.explode(roles).alias("c"))
    lines = F.filter(F.split("c.text", "\n"), lambda x: x != "")
    is_mail, is_phone = (lambda x: x.rlike(r"\S+@\S+\.\S+")), (lambda x: x.rlike(r"\(?\d{3}\)?[ .-]?\d{3}[.-]\d{4}"))
    words = F.filter(lines, lambda x: ~is_mail(x) & ~is_phone(x))
    pick = lambda xs, k: F.coalesce(F.try_element_at(xs, F.lit(k)), F.lit(""))
    out = rows.select("cds_code", F.col("c.role").alias("role"), pick(words, 1).alias("name"), pick(words, 2).alias("title"), pick(F.filter(lines, is_phone), 1).alias("phone"), pick(F.filter(lines, is_mail), 1).alias("email"), "source")
    return out.where("name <> ''")


def administrator_contacts(rows: DataFrame, source: str = "public_directory") -> DataFrame:
    """One administrator per public directory row that has a name or a phone number."""
    name = F.concat_ws(" ", F.nullif(clean("admin_first_name"), F.lit("")), F.nullif(clean("admin_last_name"), F.lit("")))
    phone = F.concat_ws(" ext. ", F.nullif(clean("phone"), F.lit("")), F.nullif(clean("extension"), F.lit("")) if "extension" in rows.columns else F.lit(None).cast("string"))
    out = rows.select("cds_code", F.lit("administrator").alias("role"), name.alias("name"), F.lit("Administrator").alias("title"), phone.alias("phone"), F.lit("").alias("email"), F.lit(source).alias("source"))
    return out.where("name <> '' or phone <> ''")
