"""Registered queries of text functions, sources, sinks, plan tables and the engine object, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass import api, catalogue, sinks, sources, streaming
from tallyglass import fixtures as fx
from tallyglass.catalogue import query
from tallyglass.functions import numeric, text
from tallyglass.operators import chunking, flatten, quality, tables
from tallyglass.plans import opportunities


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="landed-")
    return f"{root}/landed-{uuid.uuid4().hex}"


# Text functions on a text of every kind of space, dash and bullet

_RAW = "'  A' || chr(8211) || 'B' || chr(160) || c_name || ' ' || chr(9) || ' ' || chr(10) || chr(10) || chr(10) || chr(10) || chr(8226) || chr(173) || 'z  '"


def _raw() -> list:
    return [F.lit("  A–B "), F.col("c_name"), F.lit(" \t \n\n\n\n•­z  ")]


@query(
    "text_normalised",
    f"""select c_custkey, 'A-B ' || c_name || ' ' || chr(8226) || chr(173) || 'z' spaced, 'A-B ' || c_name || ' ' || chr(10) || chr(10) || '*z' lined, 'A-B ' || c_name || ' *z' compacted,
    rtrim(left('A-B ' || c_name || ' *z', 17)) || '...' cut, left(replace({_RAW}, chr(10), ' '), 30) one_line from customer""",
)
def _normalised(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(*_raw())
    out = {"spaced": text.normal_space(raw), "lined": text.normal_lines(raw), "compacted": text.compact(raw), "cut": text.snippet(raw, 20), "one_line": text.one_line(raw, 30)}
    return fx.table(spark, d, "customer").select("c_custkey", *[v.alias(k) for k, v in out.items()])


@query("text_clean", "select c_custkey, case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then 'No Data' else c_mktsegment end cleaned, case when c_custkey % 3 < 2 then '' else c_mktsegment end without_no_data, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then 'No Data' else c_mktsegment end first from customer")
def _clean(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    raw = F.when(k == 1, " No Data ").when(k == 2, F.concat(F.lit(" \t"), "c_mktsegment", F.lit("\n")))
    return fx.table(spark, d, "customer").select("c_custkey", text.clean(raw).alias("cleaned"), text.clean(raw, no_data=True).alias("without_no_data"), text.first_filled(raw, "c_name").alias("first"))


@query("text_hashes", r"""select doc_id, left(sha1(text), 16) h16, left(sha1(text), 24) h24, greatest(1, length(text) // 4) tokens, left(sha256(text), 16) query_hash, length(text) query_length,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) query_words from documents""")
def _hashes(spark: SparkSession, d: str) -> DataFrame:
    facts = text.query_facts("text")
    longs = ("query_length", "query_words")
    return fx.table(spark, d, "documents").select("doc_id", text.short_hash("text", 16).alias("h16"), text.short_hash("text", 24).alias("h24"), text.token_estimate("text").cast("long").alias("tokens"), facts["query_hash"].alias("query_hash"), *[facts[c].cast("long").alias(c) for c in longs])


@query("text_formats", "select o_orderkey, '$' || format('{:,}', cast(floor(o_totalprice) as bigint)) dollars, printf('%.1f', (o_orderkey % 1000) / 10.0e0) || '%' percent, printf('%.1f', (o_orderkey % 1000) / 10.0e0) || ' pts' points, '' none, 'a / b ' || o_orderstatus cell from orders")
def _formats(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_orderkey") % 1000 / 10
    out = {"dollars": text.dollars(F.floor("o_totalprice")), "percent": text.percent(x), "points": text.points(x), "none": text.percent(F.lit(None)), "cell": text.markdown_cell(F.concat(F.lit("a | b\n"), "o_orderstatus"))}
    return fx.table(spark, d, "orders").select("o_orderkey", *[v.alias(k) for k, v in out.items()])


@query("text_paths", "select page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 140) safe from pages")
def _paths(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", text.safe_path("url").alias("safe"))


@query("text_emails", "select s_suppkey, lower(m) email, s_suppkey % 4 < 2 valid from (select s_suppkey, case s_suppkey % 4 when 0 then 'Info@' || replace(s_name, '#', '-') || '.org' when 1 then 'a.b@c.example' when 2 then 'a@b' else 'no at sign.org' end m from supplier)")
def _emails(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" Info@"), F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(".org "))).when(k == 1, "a.b@c.example").when(k == 2, "a@b").otherwise("no at sign.org")
    return fx.table(spark, d, "supplier").select("s_suppkey", text.normal_email(raw).alias("email"), text.valid_email(raw).alias("valid"))


@query("text_labels", """select o_orderkey, case o_orderkey % 4 when 3 then null else 'English Learners' end "label", case o_orderkey % 4 when 3 then 'no label here' else o_orderpriority end "value", case o_orderkey % 4 when 3 then null else 'el' end alias, o_orderstatus || ' group' other from orders""".replace("o_orderstatus || ' group'", "lower(o_orderstatus) || ' group'"))
def _labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    line = F.when(k == 3, "no label here").otherwise(F.concat(F.lit("English Learners"), F.element_at(F.array(F.lit(" : "), F.lit(": "), F.lit(" — "), F.lit("")), k.cast("int") + 1), "o_orderpriority"))
    parted = text.label_and_value(line)
    return fx.table(spark, d, "orders").select("o_orderkey", parted["label"].alias("label"), parted["value"].alias("value"), F.when(k != 3, numeric.label_alias(parted["label"])).alias("alias"), numeric.label_alias(F.concat(F.lit(" "), "o_orderstatus", F.lit(" Group. "))).alias("other"))


@query("text_composed", "select c_custkey, c_mktsegment || ', ' || c_name address, case when c_custkey % 2 = 0 then '2024-25' else '2023-2024' end school_year, case when c_custkey % 5 = 0 then '' else lpad(cast(c_custkey as varchar), 14, '0') end code from customer")
def _composed(spark: SparkSession, d: str) -> DataFrame:
    year = F.when(F.col("c_custkey") % 2 == 0, "Plan (2024-25) v2").otherwise("for 2023-2024, and 2024-25")
    code = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("code "), F.lpad(F.col("c_custkey").cast("string"), 14, F.lit("0")), F.lit(".pdf")))
    return fx.table(spark, d, "customer").select("c_custkey", text.composed(", ", "c_mktsegment", F.lit("  "), F.lit(None).cast("string"), "c_name").alias("address"), text.school_year(year).alias("school_year"), text.code_of(F.lit("123"), code).alias("code"))


@query("array_sanitised", "select o_custkey, list_transform(list_sort(list(o_orderkey))[1:3], lambda x: left('order ' || x, 7)) kept from orders group by 1")
def _sanitised(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    some = F.flatten(F.array(F.array(F.lit(None).cast("string")), F.transform("k", lambda x: F.concat(F.lit("order "), x.cast("string")))))
    return rows.select("o_custkey", text.sanitised(some, 3, 7).alias("kept"))


@query("html_fields", "select s_suppkey, s_name district, 'Main St' || chr(10) || 'Room 1' address, '' fax, s_suppkey % 5 = 0 blocked from supplier")
def _fields(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<table><tr><th>District:</th><td><b>"), "s_name", F.lit("</b></td></tr><tr>\n<th>District&nbsp;Address *</th><td>Main St<br/>Room 1</td></tr><tr><th>District</th><td>second</td></tr></table>"), F.when(F.col("s_suppkey") % 5 == 0, "<p>Are you a robot?</p>").otherwise(""))
    rows = fx.table(spark, d, "supplier").select("s_suppkey", text.html_fields(page).alias("f"), text.blocked_page(page).alias("blocked"))
    return rows.select("s_suppkey", text.field("f", "district").alias("district"), text.field("f", "district addr").alias("address"), text.field("f", "fax number").alias("fax"), "blocked")


#: The page texts of the tables: scripts and styles go, block ends break lines, references are decoded.
_HTML = r"""with a as (select page_id, html, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|tr|td|th|li|h[1-6]|table|ul|ol|section)>', chr(10), 'g') x from pages),
  b as (select page_id, html, replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') x from a)
  select page_id, list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(regexp_replace(l, '[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}\x0B\x1C-\x1F]+', ' ', 'g'))), lambda l: l <> '') lines,
  regexp_matches(lower(coalesce(html, '')), 'captcha|are you a robot|access denied|unusual traffic') blocked from b"""
catalogue._ORACLES["html_lines"] = _HTML


# Sources and sinks: what is written comes back


@query("csv_round_trip", "select cast(c_custkey as varchar) c_custkey, c_name, c_mktsegment || ' \"q\", ' || chr(10) || 'x' note, case when c_custkey % 2 = 0 then '1' else '0' end even, '[\"a\",\"' || c_mktsegment || '\"]' list from customer")
def _csv(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit(' "q", \nx')).alias("note"), (F.col("c_custkey") % 2 == 0).alias("even"), F.array(F.lit("a"), "c_mktsegment").alias("list"), F.lit(1).alias("left_out"))
    path = _folder(spark)
    sinks.write_csv(rows, path, ["c_custkey", "c_name", "note", "even", "list"])
    return sources.table_csv(spark, path)


@query("jsonl_round_trip", "select doc_id chunk_id, text body_text, n_chars from documents where text is not null")
def _jsonl(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body_text"), "n_chars")
    path = _folder(spark)
    sinks.write_json_lines(rows, path)
    spark.range(1).select(F.lit(" ").alias("value")).write.mode("append").text(path)  # a blank line is skipped
    return sources.chunks_jsonl(spark, path, rows.schema)


@query("tables_refreshed", "select 'customer' table_name, count(*) as rows from customer union all select 'supplier', 2 * count(*) from supplier")
def _refreshed(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    c, s = fx.table(spark, d, "customer"), fx.table(spark, d, "supplier")
    sinks.write_tables({"customer": c.where("c_custkey < 3"), "supplier": s}, path)
    sinks.write_tables({"customer": c}, path)
    sinks.write_tables({"supplier": s}, path, append=True)
    return sinks.row_counts({t: spark.read.parquet(f"{path}/{t}") for t in ("customer", "supplier")})


@query("per_document_files", "select replace('dir/' || c_mktsegment || '.pdf', '/', '__') document_file, count(*) n from customer group by 1")
def _per_document(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_per_document(fx.table(spark, d, "customer").withColumn("doc", F.concat(F.lit("dir/"), "c_mktsegment", F.lit(".pdf"))), path, "doc")
    return spark.read.json(path).groupBy("document_file").agg(F.count("*").alias("n"))


@query("manifest_counts", "select o_orderstatus, count(*) n from orders group by 1")
def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest(fx.table(spark, d, "orders"), "o_orderstatus")


@query("run_log", "select 2 runs, cast(count(*) as bigint) embedded from (select 1 from customer union all select 1 from supplier)")
def _run_log(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    for t in ("customer", "supplier"):
        sinks.append_run(fx.table(spark, d, t).agg(F.count("*").alias("embedded")), path)
    return spark.read.parquet(path).where("logged_at is not null").agg(F.count("*").cast("int").alias("runs"), F.sum("embedded").alias("embedded"))


@query("vector_rows", "select vec_id id, label, 'm' model, '64' dimensions, coalesce(source, '') source from embeddings join documents on doc_id = vec_id")
def _vector_rows(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    out = sinks.vector_rows(fx.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), e, ["source"], "m", 64)
    return out.join(e, F.col("id") == F.col("chunk_id")).select("id", "label", F.col("metadata.embedding_model").alias("model"), F.col("metadata.embedding_dimensions").alias("dimensions"), F.col("metadata.source").alias("source"))


@query("directory_scan", "select lpad(cast(c_custkey as varchar), 7, '0') cd_code, c_name district, case when c_custkey % 4 = 0 then '' else c_mktsegment end county from customer where c_custkey % 3 > 0")
def _directory(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, F.lit("No Data")).otherwise(F.lpad(k.cast("string"), 7, F.lit("0")))
    rows = fx.table(spark, d, "customer").select(code.alias("CD Code"), F.when(k % 4 == 0, "No Data").otherwise(F.col("c_mktsegment")).alias("County"), F.concat(F.lit(" "), "c_name").alias("District"))
    path = _folder(spark)
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return sources.directory_tsv(spark, path).select("cd_code", "district", "county")


@query("manifest_scan", "select n_name county, cast(n_nationkey as varchar) cd_code, shape, cast(row_number() over (partition by shape order by n_nationkey) - 1 as int) ord from nation, (values ('list'), ('records')) s(shape)")
def _manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    records = F.array_sort(F.collect_list(F.struct("n_nationkey", F.struct(F.col("n_name").alias("county"), F.col("n_nationkey").cast("string").alias("cd_code")).alias("x"))))
    every = fx.table(spark, d, "nation").agg(F.transform(records, lambda r: r["x"]).alias("records"))
    out = None
    for shape, body in (("list", F.to_json("records")), ("records", F.to_json(F.struct("records")))):
        path = _folder(spark)
        every.select(body.alias("value")).coalesce(1).write.text(path)
        part = sources.manifest_json(spark, path).select("county", "cd_code", F.lit(shape).alias("shape"), "ord")
        out = part if out is None else out.unionByName(part)
    return out


@query("page_texts", "select cast(conv_id as varchar) doc, cast(turn as int) page_number, coalesce(case when turn % 3 = 0 then null else text end, '') text from conversations")
def _page_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("d"), "turn", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("t"))
    return sources.pages_of(rows, "d", "turn", "t")


@query("file_scan", "select count(*) files, cast(sum(octet_length(encode(s_name))) as bigint) bytes from supplier")
def _file_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    spark.range(1).select(F.lit("x").alias("value")).write.text(path)  # another kind of file beside
    rows = fx.table(spark, d, "supplier")
    # a file for each row, in a bounded number of folders; tasks move their own files, not the driver all of them.
    # A task for each folder: the rows are few bytes but each is a file, and by bytes they would all go to one task.
    named = rows.select(F.col("s_name").alias("value"), F.coalesce(F.pmod("s_suppkey", F.lit(64)), F.lit(0)).cast("int").alias("s_part")).repartitionById(64, "s_part")
    named.write.mode("append").option("lineSep", "|").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_part").text(path)
    found = sources.landed_files(spark, path, "part-*").where(F.col("path").contains("s_part="))
    return found.agg(F.count("*").alias("files"), F.sum(F.col("length") - 1).alias("bytes"))


@query("public_directory", "select s_suppkey cds_code, n_name county from supplier join nation on n_nationkey = s_nationkey where n_name = 'NATION_3' and s_suppkey % 2 = 0 and contains(lower(s_name), '00')")
def _public(spark: SparkSession, d: str) -> DataFrame:
    s, n = fx.table(spark, d, "supplier"), fx.table(spark, d, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("cds_code"), F.col("n_name").alias("county"), F.col("s_name").alias("district"), F.when(F.col("s_suppkey") % 2 == 0, "Active").otherwise("Closed").alias("status_type"))
    return sources.public_districts(rows, county=" nation_3 ", district="00").select("cds_code", "county")


@query("administrator_contacts", "select s_suppkey cds_code, case when s_suppkey % 3 = 0 then '' else 'Ann ' || s_name end name, case when s_suppkey % 2 = 0 then '555 ext. 7' else '' end phone from supplier where s_suppkey % 3 > 0 or s_suppkey % 2 = 0")
def _administrators(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = fx.table(spark, d, "supplier").select(k.alias("cds_code"), F.when(k % 3 != 0, " Ann ").alias("admin_first_name"), F.when(k % 3 != 0, F.col("s_name")).alias("admin_last_name"), F.when(k % 2 == 0, "555").alias("phone"), F.when(k % 2 == 0, "7").alias("extension"))
    return sources.administrator_contacts(rows).select("cds_code", "name", "phone")


@query("streamed_chunks", "select doc_id chunk_id, n_chars from documents")
def _streamed(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    root = _folder(spark)
    for part in (rows.where("chunk_id % 2 = 0"), rows):  # the second landing repeats the first
        part.write.mode("append").json(f"{root}/in")
        streaming.load_chunks(spark, f"{root}/in", rows.schema, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out")


# Plan tables


def _cells(spark: SparkSession, d: str, head: tuple[str, ...], body: list) -> DataFrame:
    """One table per order: a header row and a row per line item (its number: row_no), short by a cell where it says nothing."""
    by = Window.partitionBy("doc").orderBy(*catalogue.IN_ORDER)
    li = fx.table(spark, d, "lineitem").withColumn("doc", F.col("l_orderkey").cast("string"))
    li = li.withColumn("row_no", F.row_number().over(by)).select("doc", "row_no", F.array(*body).alias("cells"))
    own, heads = F.struct("row_no", "cells"), F.struct(F.lit(0).alias("row_no"), F.array(*[F.lit(h) for h in head]).alias("cells"))
    rows = li.select("doc", F.lit(1).alias("page"), F.lit(0).alias("table_no"), F.inline(F.when(F.col("row_no") == 1, F.array(heads, own)).otherwise(F.array(own))))
    return tables.padded(rows, dealt=True)


_ROW = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice, l_quantity)"


@query("plan_table_goals", f"select cast(l_orderkey as varchar) doc, cast({_ROW} as varchar) goal_number, 'Goal text ' || l_returnflag description, case when l_linestatus = 'O' then 'Broad' else '' end goal_type from lineitem")
def _plan_goals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("row_no").cast("string")
    body = [F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Focus Goal "), n)).otherwise(n), F.concat(F.lit("Goal text "), "l_returnflag"), F.when(F.col("l_linestatus") == "O", "Broad").otherwise("")]
    return tables.goals(_cells(spark, d, ("Goal #", "Description", "Type of Goal"), body)).select("doc", "goal_number", "description", "goal_type")


@query("plan_table_actions", f"select cast(l_orderkey as varchar) doc, '1.' || {_ROW} action_number, 'Title ' || l_returnflag title, 'Text' description, cast(floor(l_extendedprice) as double) total_funds, l_linestatus = 'O' contributing from lineitem")
def _plan_actions(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.lit("1."), F.col("row_no").cast("string"))
    money = F.concat(F.lit("$"), F.format_number(F.floor("l_extendedprice"), 0))
    body = [n, F.concat(F.lit("Title "), "l_returnflag", F.lit(" (continued)")), F.lit("Text"), money, F.when(F.col("l_linestatus") == "O", "Yes [X]").otherwise("No")]
    return tables.actions(_cells(spark, d, ("Action #", "Title", "Description", "Total Funds", "Contributing"), body)).select("doc", "action_number", "title", "description", "total_funds", "contributing")


@query("plan_table_metrics", f"select cast(l_orderkey as varchar) doc, '1.' || {_ROW} metric_number, 'Rate ' || l_returnflag metric_name, cast(floor(l_quantity) as double) baseline, cast(floor(l_tax * 100) as double) target from lineitem")
def _plan_metrics(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.lit("1."), F.col("row_no").cast("string"))
    percent = lambda c: F.concat(F.lit("All: "), F.floor(c).cast("string"), F.lit("%"))
    body = [n, F.concat(F.lit("Rate "), "l_returnflag"), percent("l_quantity"), F.lit(""), F.lit(""), percent(F.col("l_tax") * 100)]
    out = tables.metrics(_cells(spark, d, ("Metric #", "Metric", "Baseline", "Year 1 Outcome", "Year 2 Outcome", "Target for Year 3 Outcome"), body))
    value = lambda c: F.get(F.get(F.col(c)["entries"], F.lit(0))["numeric_values"], F.lit(0))
    return out.select("doc", "metric_number", "metric_name", value("baseline").alias("baseline"), value("year_3_target").alias("target"))


@query("plan_metadata", "select cast(conv_id as varchar) doc, 'District ' || conv_id district_name, '2024-25' school_year from conversations group by conv_id having min(turn) <= 3")
def _plan_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc"), (F.col("turn") + 1).cast("int").alias("page_number"), F.concat(F.lit("Local Educational Agency (LEA) Name: District "), F.col("conv_id").cast("string"), F.lit("\nCDS Code: 1\nSchool Year: 2024-25\n")).alias("text"))
    return tables.plan_metadata(rows)


@query("candidate_pages", """with p as (select conv_id, turn, conv_id % 2 = 0 and turn = 1 hit from conversations), n as (select *, bool_or(hit) over (partition by conv_id order by turn rows between 1 preceding and 1 following) near, bool_or(hit) over (partition by conv_id) found from p)
  select cast(conv_id as varchar) doc, cast(turn as int) page_number from n where near or not found""")
def _candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("conv_id") % 2 == 0) & (F.col("turn") == 1)
    rows = fx.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("page_number"), F.when(hit, "Goal # | Description").otherwise("nothing").alias("text"))
    return tables.candidate_pages(rows).select("doc", "page_number")


@query("resolved_documents", "select c_custkey, case when c_custkey % 3 = 0 then 'by path' when c_custkey % 3 = 1 then 'by code' else '' end county from customer")
def _resolved(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.lpad(k.cast("string"), 14, F.lit("0"))
    c = fx.table(spark, d, "customer")
    records = c.where("c_custkey % 3 = 0").select(F.lit(1).alias("ord"), F.lit("").alias("cds_code"), F.concat(F.lit("p/"), k.cast("string")).alias("output_path"), F.lit("by path").alias("county"))
    records = records.unionByName(c.where("c_custkey % 3 = 1").select(F.lit(2).alias("ord"), code.alias("cds_code"), F.lit("").alias("output_path"), F.lit("by code").alias("county")))
    blank = lambda *names: [F.lit("").alias(n) for n in names]
    records = records.select("*", *blank("cd_code", "district", "pdf_url", "cds_index_path"))
    plans = c.select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit("p/"), k.cast("string"))).otherwise(F.concat(F.lit("x/"), code, F.lit(".pdf"))).alias("source_path"), *blank("source_file", "district_name"))
    return flatten.resolved(plans, records).select("c_custkey", "county")


@query("documents_without_chunks", "select doc_id cds_code from documents where doc_id % 3 > 0")
def _without(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").select(F.col("doc_id").alias("cds_code"))
    return quality.without_chunks(rows, rows.where("cds_code % 3 = 0")).select("cds_code")


@query("chunk_export", "select doc_id chunk_id, 'f' || doc_id || '.pdf' source_document_id, 'd:f' || doc_id || '.pdf' district_doc_id from documents where regexp_matches(coalesce(text, ''), '\\S')")
def _export(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("c"), F.lit("").alias("search_text"), F.col("text").alias("body_text"), F.lit("d").alias("cds_code"), F.concat(F.lit("a/f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_path"))
    out = chunking.exported(rows.withColumnRenamed("c", "chunk_id"))
    return out.select(F.col("chunk_id").cast("long").alias("chunk_id"), "source_document_id", "district_doc_id")


# The engine object gives what the plans give


def _engine(spark: SparkSession, d: str) -> api.Engine:
    """Opened on a folder of written tables."""
    path = _folder(spark)
    sinks.write_tables(catalogue._tables(spark, d) | {"chunks": fx.chunks(spark, d), "profiles": fx.profiles(spark, d), "contacts": fx.contacts(spark, d)}, path)
    return api.Engine.open(spark, path)


@query("api_opportunities", catalogue.oracle_sql()["opportunities_worsening"])
def _api_opportunities(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark, d)
    del engine.tables["metrics"]
    return engine.find_opportunities(catalogue.TOPIC).drop("indicator_name", "student_group")


@query("api_stats", catalogue.oracle_sql()["chunk_stats"])
def _api_stats(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).stats()


@query("api_account_goals", catalogue.oracle_sql()["account_goals"])
def _api_brief(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).account_brief(1, catalogue.TOPIC)["topic_goals"].limit(5)


@query("api_search", "select chunk_id from (" + catalogue.oracle_sql()["bm25_topk"] + ")")
def _api_search(spark: SparkSession, d: str) -> DataFrame:
    engine = _engine(spark, d)
    engine.tables["embeddings"] = catalogue._embeddings(spark, d)
    return engine.search(catalogue.SEARCH, 20).select("chunk_id")


@query("opportunity_order_without_district", catalogue.oracle_sql()["opportunities_any_by_score"])
def _without_tie_break(spark: SparkSession, d: str) -> DataFrame:
    found = catalogue._tables(spark, d)
    del found["metrics"]
    return opportunities.find_opportunities(found, catalogue.TOPIC, "any", "opportunity_score", limit=200, tie_break=False).drop("indicator_name", "student_group")
