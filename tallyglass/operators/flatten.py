"""Nested plans and outcome packages to flat tables, with explicit ordinals for every "first" and "last"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.classify import indicator_name
from tallyglass.functions.documents import json_values
from tallyglass.functions.numeric import as_flag
from tallyglass.functions.text import clean, code_of, filled, first_filled, names_match

PLAN = """source_file string, source_path string, district_name string, school_year string,
 goal_count int, metric_count int, action_count int, extraction_warnings array<string>, extraction_errors array<string>,
 goals array<struct<goal_number:string, description:string, goal_type:string, source_pages:array<int>,
  actions:array<struct<action_number:string,title:string,description:string,total_funds_raw:string,contributing_raw:string,total_funds:double,contributing:boolean,source_pages:array<int>>>,
  metrics:array<struct<metric_number:string,metric_name:string,baseline_raw:string,year_1_outcome_raw:string,year_2_outcome_raw:string,year_3_target_raw:string,current_difference_from_baseline_raw:string,source_pages:array<int>>>>>"""


def last_by_key(records: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """One record per key, the last by the ordinal; blank keys go."""
    rows = records.withColumn("_key", key).where("_key <> ''")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def manifest_by_code(records: DataFrame) -> DataFrame:
    return last_by_key(records, clean("cds_code"))


def manifest_by_path(records: DataFrame) -> DataFrame:
    """Records under each of their two paths; the last record wins a path."""
    both = records.select("*", F.explode(F.array(clean("output_path"), clean("cds_index_path"))).alias("_path"))
    return last_by_key(both, F.regexp_replace("_path", "/+$", "")).drop("_path")


def resolved(plans: DataFrame, records: DataFrame, fields: tuple[str, ...] = ("cd_code", "county", "district", "pdf_url")) -> DataFrame:
    """Plans with their manifest record: by path, else by the 14-digit code in path, file or name."""
    rows = plans.withColumns({"_path": clean("source_path"), "_code": code_of("source_path", "source_file", "district_name")})
    pick = lambda df, p: df.select("_key", F.struct("cds_code", *fields).alias(p))
    rows = rows.join(pick(manifest_by_path(records), "_p").withColumnRenamed("_key", "_path"), "_path", "left")
    rows = rows.join(pick(manifest_by_code(records), "_c").withColumnRenamed("_key", "_code"), "_code", "left")
    rows = rows.withColumn("_m", F.coalesce("_p", "_c"))
    code = first_filled(F.col("_m.cds_code"), F.col("_code"))
    return rows.withColumns({"cds_code": code, **{f: clean(F.col(f"_m.{f}")) for f in fields}}).drop("_p", "_c", "_m", "_path", "_code")


def plan_documents(rows: DataFrame) -> DataFrame:
    """One row per resolved plan."""
    name = clean("district_name")
    district = F.coalesce(filled("district"), name)
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rows.select(
        "cds_code",
        "cd_code",
        "county",
        district.alias("district"),
        name.alias("parsed_district_name"),
        names_match(district, name).alias("district_name_match"),
        *[clean(c).alias(c) for c in ("school_year", "source_file", "source_path", "pdf_url")],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("goal_count", "metric_count", "action_count")],
        count("extraction_warnings").alias("extraction_warning_count"),
        count("extraction_errors").alias("extraction_error_count"),
        "extraction_warnings",
        "extraction_errors",
    )


def _head() -> list[Column]:
    return [F.col("cds_code"), F.col("county"), F.coalesce(filled("district"), clean("district_name")).alias("district"), clean("school_year").alias("school_year")]


def _numbered(number: Column, place: Column) -> Column:
    return F.coalesce(filled(number), (place + 1).cast("string"))


def _goals(rows: DataFrame) -> DataFrame:
    own = rows.select(*_head(), F.posexplode("goals").alias("_g", "goal"))
    own = own.withColumn("goal_number", _numbered(F.col("goal.goal_number"), F.col("_g")))
    return own.withColumn("goal_id", F.concat_ws(":", "cds_code", F.lit("goal"), "goal_number", (F.col("_g") + 1).cast("string")))


def plan_goals(rows: DataFrame) -> DataFrame:
    pages = F.coalesce("goal.source_pages", F.array().cast("array<int>")).alias("source_pages")
    return _goals(rows).select("goal_id", "cds_code", "county", "district", "school_year", "goal_number", clean("goal.goal_type").alias("goal_type"), clean("goal.description").alias("description"), pages)


def _items(rows: DataFrame, kind: str) -> DataFrame:
    own = _goals(rows).select("goal_id", "cds_code", "county", "district", "school_year", "goal_number", F.posexplode(f"goal.{kind}s").alias("_i", "x"))
    own = own.withColumn(f"{kind}_number", _numbered(F.col(f"x.{kind}_number"), F.col("_i")))
    return own.withColumn(f"{kind}_id", F.concat_ws(":", "goal_id", F.lit(kind), f"{kind}_number", (F.col("_i") + 1).cast("string")))


def plan_actions(rows: DataFrame) -> DataFrame:
    text = lambda c: clean(f"x.{c}").alias(c)
    return _items(rows, "action").select(
        "action_id", "goal_id", "cds_code", "county", "district", "school_year", "goal_number", "action_number", text("title"), text("description"),
        "x.total_funds", text("total_funds_raw"), as_flag("x.contributing").alias("contributing"), text("contributing_raw"), F.coalesce("x.source_pages", F.array().cast("array<int>")).alias("source_pages"),
    )


def plan_metrics(rows: DataFrame) -> DataFrame:
    text = lambda c: clean(f"x.{c}").alias(c)
    return _items(rows, "metric").select(
        "metric_id", "goal_id", "cds_code", "county", "district", "school_year", "goal_number", "metric_number",
        *[text(c) for c in ("metric_name", "baseline_raw", "year_1_outcome_raw", "year_2_outcome_raw", "year_3_target_raw", "current_difference_from_baseline_raw")],
        F.coalesce("x.source_pages", F.array().cast("array<int>")).alias("source_pages"),
    )


# Outcome packages are read as one JSON text each: their payloads have several shapes.


def _v(c: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(c) if isinstance(c, str) else c, path, kind)


def packages(texts: DataFrame, text: str = "value", stem: str | None = None) -> DataFrame:
    """``texts`` as variants with cds_code (the file's stem if the package has none), county, district."""
    rows = texts.withColumn("package", F.try_parse_json(text)).where("package is not null")
    code = clean(_v("package", "$.metadata.district.cds_code", "string"))
    return rows.select(
        "package",
        code.alias("_code"),
        first_filled(code, F.col(stem) if stem else F.lit("")).alias("cds_code"),
        clean(_v("package", "$.metadata.district.county", "string")).alias("county"),
        clean(_v("package", "$.metadata.district.district", "string")).alias("district"),
        _v("package", "$.metadata.school_year_id", "int").alias("_year"),
    )


def _measures(own: str) -> list[Column]:
    get = lambda name, kind, out: _v(own, f"$.{name}", kind).alias(out)
    ints = (("statusId", "status_id"), ("changeId", "change_id"), ("performance", "performance"), ("count", "count"), ("chronicCount", "chronic_count"), ("red", "red"), ("orange", "orange"), ("yellow", "yellow"), ("green", "green"), ("blue", "blue"))
    return [
        F.coalesce(F.nullif(_v(own, "$.schoolYearId", "int"), F.lit(0)), F.col("_year")).alias("school_year_id"),
        clean(_v(own, "$.studentGroup", "string")).alias("student_group"),
        get("status", "double", "status"),
        get("change", "double", "change"),
        *[get(n, "int", o) for n, o in ints],
        as_flag(_v(own, "$.isPrivateData", "boolean")).alias("is_private_data"),
    ]


def _named(key: Column) -> list[Column]:
    return [clean(key).alias("indicator_id"), indicator_name(key).alias("indicator_name")]


def _each(c: Column) -> Column:
    """array<variant>: the elements of an array, a scalar or object as the only one, none of null."""
    return F.coalesce(F.try_variant_get(c, "$", "array<variant>"), F.when(c.isNotNull() & ~F.is_variant_null(c), F.array(c)), F.array().cast("array<variant>"))


def dashboard_indicators(rows: DataFrame) -> DataFrame:
    """Summary cards that are objects with an object under ``primary``."""
    cards = F.coalesce(_v("package", "$.summary.summary_cards", "array<variant>"), F.array().cast("array<variant>"))
    own = rows.select("_code", "county", "district", "_year", F.explode(cards).alias("card"))
    own = own.withColumn("own", _v("card", "$.primary", "variant")).where(F.schema_of_variant("own").startswith("OBJECT"))
    key = first_filled(_v("card", "$.indicatorId", "string"), _v("own", "$.indicatorId", "string"))
    return own.select(_own_code(), "county", "district", *_named(key), *_measures("own"))


def _own_code() -> Column:
    """The package's code, else the row's; the file's stem counts for trends and flags only."""
    return first_filled("_code", _v("own", "$.cdsCode", "string")).alias("cds_code")


def dashboard_student_groups(rows: DataFrame) -> DataFrame:
    """Items under each indicator in three shapes: primary.list, primary as one row, or list."""
    groups = F.coalesce(_v("package", "$.student_groups", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    own = rows.select("_code", "county", "district", "_year", F.explode(groups).alias("key", "payload"))
    own = own.select("_code", "county", "district", "_year", "key", F.explode(_each(F.col("payload"))).alias("item"))
    primary = _v("item", "$.primary", "variant")
    is_object = F.coalesce(F.schema_of_variant(primary).startswith("OBJECT"), F.lit(False))
    found = F.when(is_object, F.coalesce(_v("item", "$.primary.list", "array<variant>"), F.array(primary))).otherwise(_v("item", "$.list", "array<variant>"))
    own = own.select("_code", "county", "district", "_year", "key", F.explode(found).alias("own")).where(F.schema_of_variant("own").startswith("OBJECT"))
    return own.select(_own_code(), "county", "district", *_named(F.col("key")), *_measures("own"))


def dashboard_trends(rows: DataFrame) -> DataFrame:
    charts = F.coalesce(_v("package", "$.charts", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    own = rows.select("cds_code", "county", "district", "_year", F.explode(charts).alias("key", "payload"))
    own = own.select("cds_code", "county", "district", "_year", "key", F.explode(_each(F.col("payload"))).alias("own")).where(F.schema_of_variant("own").startswith("OBJECT"))
    years = (("currentYear", "current_year"), ("oneYearAgo", "one_year_ago"), ("twoYearsAgo", "two_years_ago"), ("threeYearsAgo", "three_years_ago"), ("fourYearsAgo", "four_years_ago"))
    year = F.coalesce(F.nullif(_v("own", "$.schoolYearId", "int"), F.lit(0)), F.col("_year")).alias("school_year_id")
    return own.select("cds_code", "county", "district", year, *_named(F.col("key")), clean(_v("own", "$.grade", "string")).alias("grade"), *[_v("own", f"$.{n}", "double").alias(o) for n, o in years])


def indicator_ids(c: Column | str) -> Column:
    """array<int>: the distinct indicator ids anywhere in a JSON text, sorted; 1 to 8 if there are none."""
    whole = lambda x: F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x)).otherwise(F.regexp_extract(x, r"^([+-]?\d+)\.\d*$", 1)).try_cast("int")
    found = F.filter(F.transform(F.coalesce(json_values(c, "indicatorId", "indicatorID"), F.array().cast("array<string>")), whole), lambda x: x.isNotNull())
    ids = F.array_sort(F.array_distinct(found))
    return F.when(F.size(ids) > 0, ids).otherwise(F.sequence(F.lit(1), F.lit(8)))


def year_id(years: Column | str, year: str) -> Column:
    """The id of the first entry (id, name) of an array whose name is the year."""
    return F.get(F.filter(F.col(years) if isinstance(years, str) else years, lambda e: e["name"] == year), F.lit(0))["id"]


def district_rows(records: DataFrame, with_dashboard: DataFrame) -> DataFrame:
    """Manifest records as districts: own fields first, nested source second; the flag is set membership.

    Accounts that only the dashboard has follow as rows with nothing but their code and flags.
    """
    names = ("cds_code", "cd_code", "county", "district", "doc", "doc_type", "status_type", "street", "city", "zip", "state", "phone", "admin_first_name", "admin_last_name", "latitude", "longitude")
    nested = "cde_public_district" in records.columns
    own = lambda n: first_filled(*([F.col(n)] if n in records.columns else []), *([F.col(f"cde_public_district.{n}")] if nested and n in records.schema["cde_public_district"].dataType.names else []))
    rows = records.select(*[own(n).alias(n) for n in names], as_flag("has_lcap").alias("has_lcap") if "has_lcap" in records.columns else F.lit(None).cast("int").alias("has_lcap"))
    codes = with_dashboard.select("cds_code").distinct().withColumn("_d", F.lit(1))
    known = rows.join(codes, "cds_code", "left").withColumn("has_dashboard", F.coalesce("_d", F.lit(0))).drop("_d")
    only = codes.join(rows.select("cds_code"), "cds_code", "left_anti")
    only = only.select("cds_code", *[F.lit("").alias(n) for n in names[1:]], F.lit(0).alias("has_lcap"), F.col("_d").alias("has_dashboard"))
    return known.unionByName(only.select(*known.columns))


def directory_rows(raw: DataFrame) -> DataFrame:
    """Directory TSV rows with a seven-digit code; two spellings of headers; "No Data" is empty."""
    pick = lambda *names: first_filled(*[clean(f"`{n}`", no_data=True) for n in names if n in raw.columns])
    code = pick("CD Code", "CDCode")
    rows = raw.where(code.rlike(r"^\d{7}$"))
    first = (("county", ("County",)), ("district", ("District",)), ("doc", ("DOC",)), ("doc_type", ("DOCType", "DOC Type")), ("status_type", ("StatusType", "Status Type")), ("street", ("Street",)), ("city", ("City",)), ("zip", ("Zip",)), ("state", ("State",)), ("phone", ("Phone",)), ("extension", ("Ext  ", "Ext")), ("admin_first_name", ("AdmFName",)), ("admin_last_name", ("AdmLName",)), ("latitude", ("Latitude",)), ("longitude", ("Longitude",)), ("last_update", ("LastUpDate", "LastUpdate")))
    return rows.select(F.concat(code, F.lit("0000000")).alias("cds_code"), code.alias("cd_code"), *[pick(*names).alias(out) for out, names in first])
