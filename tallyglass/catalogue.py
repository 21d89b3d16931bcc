"""All queries of the library over the test tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyglass import fixtures as fx
from tallyglass import oracles as sql
from tallyglass.config import Topic
from tallyglass.functions import classify, numeric, text
from tallyglass.operators import chunking, dedup, flatten, quality, upsert
from tallyglass.plans import directory, opportunities, reports, retrieval

Query = Callable[[SparkSession, str], DataFrame]

#: The topic of the test tables: products by words of their names.
TOPIC = Topic("error", "ALL", True, ("widget", "promo", "urgent"), ("widget",))
TERMS = ("widget", "promo", "steel")
SEARCH = "the onre thand"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


#: The order of an order's line items.
IN_ORDER = ("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def by_order() -> WindowSpec:
    """Line items of an order, in an order that ties can't change."""
    return Window.partitionBy("l_orderkey").orderBy(*IN_ORDER)


def queries() -> dict[str, Query]:
    import tallyglass.catalogue_index
    import tallyglass.catalogue_rules
    import tallyglass.catalogue_texts  # noqa: F401  these register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _tables(spark: SparkSession, d: str, copies: bool = False) -> dict[str, DataFrame]:
    return {"indicators": fx.indicators(spark, d), "districts": fx.districts(spark, d), "documents": fx.documents(spark, d, copies), "actions": fx.actions(spark, d), "goals": fx.goals(spark, d), "metrics": fx.metrics(spark, d)}


def _rounded(df: DataFrame, columns: tuple[str, ...], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Opportunities

_ORDERS = {
    "strict_action_funds": "strict_action_funds desc, district desc",
    "broad_action_funds": "broad_action_funds desc, district desc",
    "affected_student_count": "affected_student_count desc, district desc",
    "current_status": "current_status desc, district desc",
    "outcome_change": "abs(outcome_change) desc, district desc",
    "opportunity_score": "opportunity_score desc, district",
}
_TRENDS = {"worsening": "and change > 0", "improving": "and change < 0", "decreasing_rate": "and change < 0", "increasing_rate": "and change > 0", "any": ""}


def _opportunities(name: str, trend: str, rank: str, limit: int = 25, extra: str = "", **options: object) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = _tables(spark, d)
        del tables["metrics"]
        rows = opportunities.find_opportunities(tables, TOPIC, trend, rank, limit=limit, **options)
        return rows.drop("indicator_name", "student_group")

    query(name, sql.opportunities(_TRENDS[trend], _ORDERS[rank], TOPIC.terms, TOPIC.strict, TOPIC.indicator, limit, extra))(run)


_opportunities("opportunities_worsening", "worsening", "strict_action_funds")
_opportunities("opportunities_improving", "improving", "broad_action_funds")
_opportunities("opportunities_decreasing_rate", "decreasing_rate", "affected_student_count")
_opportunities("opportunities_increasing_rate", "increasing_rate", "outcome_change")
_opportunities("opportunities_any_by_score", "any", "opportunity_score", 200)
_opportunities("opportunities_any_by_status", "any", "current_status", 100)
_opportunities("opportunities_wildcard_county", "any", "strict_action_funds", 100, "and d.county = 'NATION_3' and lower(d.district) like '%00%'", county="NATION_3", district="*00*")


@query(
    "opportunities_with_metrics",
    f"""{sql.WITH}, li as (select o_custkey cds_code, l_orderkey || ':m:' || l_linenumber metric_id, l_returnflag f from lineitem join orders on o_orderkey = l_orderkey)
    select cds_code, count(distinct metric_id) topic_metric_count from li where f = 'R' group by cds_code""",
)
def _metrics_matched(spark: SparkSession, d: str) -> DataFrame:
    of = Topic("chronic_absenteeism", "ALL", True, ("absenteeism",), ("absenteeism",))
    return opportunities.matching_metrics(fx.metrics(spark, d), of).groupBy("cds_code").agg(F.countDistinct("metric_id").alias("topic_metric_count"))


def _top(scope: str) -> None:
    hit = sql.any_of(sql.TEXT, TOPIC.terms) if scope == "broad" else sql.any_of("lower(coalesce(title, ''))", TOPIC.strict)

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = opportunities.matching_actions(fx.actions(spark, d), fx.documents(spark, d), TOPIC, scope)
        return opportunities.top_actions(found, 3).drop("actionability_confidence", "sales_read")

    query(f"top_actions_{scope}", sql.top_actions(hit, 3))(run)


_top("broad")
_top("strict")


@query("opportunity_top_actions_nested", f"""with r as ({sql.opportunities("and change > 0", _ORDERS["strict_action_funds"], TOPIC.terms, TOPIC.strict, TOPIC.indicator, 25)}),
  t as ({sql.top_actions(sql.any_of("lower(coalesce(title, ''))", TOPIC.strict), 3)})
  select cds_code, count(t.rank) n_actions, min(case when t.rank = 1 then t.action_id end) best_action from r left join t using (cds_code) group by cds_code""")
def _nested(spark: SparkSession, d: str) -> DataFrame:
    rows = opportunities.find_opportunities(_tables(spark, d), TOPIC, "worsening", "strict_action_funds", include_actions=True)
    return rows.select("cds_code", F.coalesce(F.size("top_actions"), F.lit(0)).cast("long").alias("n_actions"), F.get("top_actions", F.lit(0))["action_id"].alias("best_action"))


@query("account_goals", f"{sql.WITH} select goal_id, goal_number, goal_type, description description_snippet from goals where cds_code = 1 and contains(lower(description), 'urgent') order by goal_number, goal_id limit 5")
def _account_goals(spark: SparkSession, d: str) -> DataFrame:
    return opportunities.fetch_topic_goals(_tables(spark, d), 1, TOPIC)


@query(
    "account_metrics",
    """select l_orderkey || ':m:' || l_linenumber metric_id, cast(l_orderkey as varchar) goal_number, cast(l_linenumber as varchar) metric_number,
    'Chronic absenteeism rate ' || l_linestatus metric_name, 'All: ' || cast(floor(l_quantity) as int) || '%' baseline_raw
    from lineitem join orders on o_orderkey = l_orderkey where o_custkey = 1 and l_returnflag = 'R' order by goal_number, metric_number, metric_id, baseline_raw limit 5""",
)
def _account_metrics(spark: SparkSession, d: str) -> DataFrame:
    of = Topic("chronic_absenteeism", "ALL", True, ("absenteeism",), ("absenteeism",))
    rows = opportunities.matching_metrics(fx.metrics(spark, d).where("cds_code = 1"), of)
    return rows.select("metric_id", "goal_number", "metric_number", "metric_name", "baseline_raw").orderBy("goal_number", "metric_number", "metric_id", "baseline_raw").limit(5)


# Declining rates


@query("declining_summary", sql.summary(TERMS, "error"))
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.declining_summary(_tables(spark, d, True), TERMS, "error")


@query("declining_candidates", sql.candidates(TERMS, "error"))
def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return reports.declining_candidates(_tables(spark, d, True), TERMS, "error")


@query("declining_evidence", sql.evidence(TERMS, 3))
def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return reports.declining_evidence(_tables(spark, d, True), 3, TERMS)


@query("grouped_outcomes", sql.grouped(TERMS))
def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return reports.grouped_outcomes(_tables(spark, d, True), TERMS)


@query("declining_cohort", f"{sql.WITH} select distinct cds_code from ind where indicator_name = 'error' and change < 0")
def _cohort(spark: SparkSession, d: str) -> DataFrame:
    return reports.declining(fx.indicators(spark, d), "error").select("cds_code").distinct()


# Directory and documents

_PROFILES = """select s_suppkey cds_code, case when s_suppkey % 6 <> 0 then s_name end district, case when s_suppkey % 6 <> 0 then n_name end county,
  case when s_suppkey % 4 = 0 then 'ok' else 'error' end parse_status from supplier join nation on s_nationkey = n_nationkey"""
_CONTACTS = """select s_suppkey cds_code, r role, r || ' ' || s_suppkey name from supplier, (values (0, 'administrator'), (1, 'cds_coordinator'), (2, 'chief_business_official'), (3, 'superintendent')) v(k, r)
  where (s_suppkey + k) % 3 <> 0"""


@query("profiles_shown", f"select * from ({_PROFILES}) where parse_status = 'ok' or district is not null or county is not null")
def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return directory.shown(fx.profiles(spark, d)).select("cds_code", "district", "county", "parse_status")


@query(
    "contacts_ranked",
    f"""with c as ({_CONTACTS}) select cds_code, role, name, row_number() over (partition by cds_code order by case role when 'superintendent' then 1 when 'chief_business_official' then 2 when 'cds_coordinator' then 3 else 9 end, role) place from c""",
)
def _contacts(spark: SparkSession, d: str) -> DataFrame:
    nested = directory.nested_contacts(fx.contacts(spark, d))
    return nested.select("cds_code", F.posexplode("contacts").alias("p", "c")).select("cds_code", "c.role", "c.name", (F.col("p") + 1).cast("long").alias("place"))


@query("contacts_fallback", f"{sql.WITH} select cds_code, county, district from districts where county = 'NATION_5'")
def _fallback(spark: SparkSession, d: str) -> DataFrame:
    none = fx.profiles(spark, d).where("cds_code < 0")
    return directory.profiles_or_districts(none, fx.districts(spark, d).where("county = 'NATION_5'")).select("cds_code", "county", "district")


@query("documents_lookup", f"{sql.WITH} select cds_code, district, district_name_match, rank from (select *, cast(row_number() over (order by case when cds_code % 3 = 0 then 0 else 1 end, case when cds_code % 4 = 0 then null else 2020 + cds_code % 4 end desc nulls last, district) as int) rank from docs where {sql.VALID} and lower(district) like '%1%') where rank <= 25")
def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.documents(spark, d).withColumns({"pdf_url": F.when(F.col("cds_code") % 3 == 0, "u"), "school_year": F.when(F.col("cds_code") % 4 != 0, 2020 + F.col("cds_code") % 4)})
    rows = directory.plan_documents(docs, district="*1*", limit=25)
    return retrieval.ranked(rows, "rank", *directory.document_order()).select("cds_code", "district", "district_name_match", "rank")


@query("missing_detail_3vl", f"with p as (select *, case when district is not null then 'detail' else 'other' end source from ({_PROFILES})), d as (select distinct cast(s_nationkey + 1 as bigint) cds_code from supplier) select distinct d.cds_code from d left join p using (cds_code) where not (p.source = 'detail' and p.parse_status = 'ok')")
def _missing(spark: SparkSession, d: str) -> DataFrame:
    p = fx.profiles(spark, d).withColumn("source", F.when(F.col("district").isNotNull(), upsert.DETAIL_SOURCE).otherwise("other"))
    codes = fx.table(spark, d, "supplier").select((F.col("s_nationkey") + 1).cast("long").alias("cds_code")).distinct()
    return upsert.missing_details(codes, p)


# Flattening


@query("dashboard_only_districts", "select distinct user_id cds_code from events where user_id not in (select c_custkey from customer where c_custkey % 2 = 0)")
def _only(spark: SparkSession, d: str) -> DataFrame:
    known = fx.districts(spark, d).where("cds_code % 2 = 0")
    return fx.table(spark, d, "events").select(F.col("user_id").alias("cds_code")).distinct().join(known.select("cds_code"), "cds_code", "left_anti")


@query("district_flags", "select cast(c_custkey as varchar) cds_code, c_name district, case when c_custkey in (select user_id from events) then 1 else 0 end has_dashboard from customer union all select distinct cast(user_id as varchar), '', 1 from events where user_id not in (select c_custkey from customer)")
def _flags(spark: SparkSession, d: str) -> DataFrame:
    records = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cds_code"), F.col("c_name").alias("district"))
    seen = fx.table(spark, d, "events").select(F.col("user_id").cast("string").alias("cds_code"))
    return flatten.district_rows(records, seen).select("cds_code", "district", "has_dashboard")


@query("indicator_names", "select distinct event_type, user_id % 12 id, case user_id % 12 when 1 then 'chronic_absenteeism' when 2 then 'suspension_rate' when 3 then 'english_learner_progress' when 4 then 'graduation_rate' when 5 then 'college_career' when 6 then 'ela' when 7 then 'math' when 8 then 'science' else 'indicator_' || (user_id % 12) end indicator_name from events")
def _indicators(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "events").select("event_type", (F.col("user_id") % 12).alias("id")).distinct()
    return rows.select("event_type", "id", classify.indicator_name("id").alias("indicator_name"))


def _buckets() -> list[tuple[str, int]]:
    return [("four_years_ago", 0), ("three_years_ago", 6), ("two_years_ago", 12), ("one_year_ago", 18), ("current_year", 24)]


@query("trends_wide", "select user_id cds_code, event_type indicator_name, " + ", ".join(sql.mean(f"case when date_part('day', ts) - 1 >= {lo} and date_part('day', ts) - 1 < {lo + 6 if lo < 24 else 99} then value end") + f" {n}" for n, lo in _buckets()) + " from events group by 1, 2")
def _trends(spark: SparkSession, d: str) -> DataFrame:
    day = F.dayofmonth("ts") - 1
    means = [fx.exact_mean(F.when((day >= lo) & (day < (lo + 6 if lo < 24 else 99)), F.col("value"))).alias(n) for n, lo in _buckets()]
    return fx.table(spark, d, "events").groupBy(F.col("user_id").alias("cds_code"), F.col("event_type").alias("indicator_name")).agg(*means)


@query(
    "district_name_match",
    """with n as (select c_custkey, n_name || ' Unified School District' a, case c_custkey % 4 when 0 then upper(n_name) when 1 then n_name || ' (Joint) Union High' when 2 then (select max(n_name) from nation) else 'LCAP 2025 - 1' end b, n_name x, (select max(n_name) from nation) y, c_custkey % 4 k from customer join nation on n_nationkey = c_nationkey),
    w as (select *, list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda t: t <> '' and t not in ('united', '')) tx from n)
    select c_custkey, a, b, case when k = 3 then null when k in (0, 1) then 1
      when lower(x) = lower(y) then 1 when len(list_intersect(string_split(lower(x), ' '), string_split(lower(y), ' '))) * 4 >= 3 * greatest(len(list_distinct(string_split(lower(x), ' '))), len(list_distinct(string_split(lower(y), ' ')))) then 1 
      when len(list_intersect(string_split(lower(x), ' '), string_split(lower(y), ' '))) >= 2 and 2 * len(list_intersect(string_split(lower(x), ' '), string_split(lower(y), ' '))) >= greatest(len(list_distinct(string_split(lower(x), ' '))), len(list_distinct(string_split(lower(y), ' ')))) then 1 else 0 end matches from w""",
)
def _names(spark: SparkSession, d: str) -> DataFrame:
    n = fx.table(spark, d, "nation")
    most = n.agg(F.max("n_name").alias("y"))
    rows = fx.table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(most), F.lit(True))
    k = F.col("c_custkey") % 4
    b = F.when(k == 0, F.upper("n_name")).when(k == 1, F.concat("n_name", F.lit(" (Joint) Union High"))).when(k == 2, F.col("y")).otherwise(F.lit("LCAP 2025 - 1"))
    rows = rows.select("c_custkey", F.concat("n_name", F.lit(" Unified School District")).alias("a"), b.alias("b"))
    return rows.withColumn("matches", text.names_match("a", "b"))


@query("code_extract", r"select page_id, regexp_extract(url || ' ' || lpad(cast(page_id as varchar), 14, '0'), '\b(\d{14})\b', 1) code from pages")
def _codes(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", text.code_of(F.concat("url", F.lit(" "), F.lpad(F.col("page_id").cast("string"), 14, F.lit("0")))).alias("code"))


@query(
    "flatten_goals_actions_all",
    """with o as (select o_orderkey, o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) g from orders),
    a as (select o.*, l_extendedprice, row_number() over (partition by o_orderkey order by l_linenumber, l_extendedprice, l_partkey, l_quantity) i, l_linenumber from o join lineitem on l_orderkey = o_orderkey)
    select lpad(cast(o_custkey as varchar), 14, '0') || ':goal:' || o_orderkey || ':' || g goal_id, lpad(cast(o_custkey as varchar), 14, '0') || ':goal:' || o_orderkey || ':' || g || ':action:' || l_linenumber || ':' || i action_id,
    cast(o_orderkey as varchar) goal_number, l_extendedprice total_funds from a""",
)
def _flatten_all(spark: SparkSession, d: str) -> DataFrame:
    return _flattened(spark, d, fx.table(spark, d, "orders"))


def _flattened(spark: SparkSession, d: str, o: DataFrame) -> DataFrame:
    li = fx.table(spark, d, "lineitem")
    item = F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_quantity")
    acts = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey", "o_orderkey", "o_orderpriority").agg(F.array_sort(F.collect_list(item)).alias("x"))
    act = F.transform("x", lambda a: F.struct(a["l_linenumber"].cast("string").alias("action_number"), F.lit("t").alias("title"), F.lit("").alias("description"), F.lit("").alias("total_funds_raw"), F.lit("").alias("contributing_raw"), a["l_extendedprice"].alias("total_funds"), F.lit(True).alias("contributing"), F.array(F.lit(1)).alias("source_pages")))
    goal = F.struct("o_orderkey", F.col("o_orderpriority").alias("p"), act.alias("actions"))
    # orders without items are goals without actions: they count for the goals' ordinals
    every = o.join(acts.select("o_orderkey", goal.alias("g")), "o_orderkey", "left").select("o_custkey", "o_orderkey", F.coalesce("g.actions", F.array().cast(acts.select(act.alias("a")).schema["a"].dataType)).alias("actions"))
    plans = every.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "actions"))).alias("gs"))
    goals = F.transform("gs", lambda g: F.struct(g["o_orderkey"].cast("string").alias("goal_number"), F.lit("").alias("description"), F.lit("").alias("goal_type"), F.array(F.lit(1)).alias("source_pages"), g["actions"].alias("actions")))
    code = F.lpad(F.col("o_custkey").cast("string"), 14, F.lit("0"))
    rows = plans.select(code.alias("cds_code"), F.lit("").alias("county"), F.lit("").alias("district"), F.lit("D").alias("district_name"), F.lit("").alias("school_year"), goals.alias("goals"))
    return flatten.plan_actions(rows).select("goal_id", "action_id", "goal_number", "total_funds")


# Chunks


@query("chunk_stats", "select count(*) chunks, count(distinct lang) districts, count(distinct source) section_types from documents")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.collection_stats(fx.chunks(spark, d))


@query("chunks_per_section", "select source section_type, count(*) n from documents group by 1")
def _per_section(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.counts_by(fx.chunks(spark, d), "section_type")


_CHUNK = "lpad(cast(conv_id as varchar), 10, '0') || '-' || lpad(cast(turn as varchar), 6, '0')"


@query("chunk_neighbors", f"with c as (select cast(conv_id as varchar) section_id, turn, {_CHUNK} chunk_id from conversations) select section_id, chunk_id, coalesce(lag(chunk_id) over w, '') prev_chunk_id, coalesce(lead(chunk_id) over w, '') next_chunk_id from c window w as (partition by section_id order by turn, chunk_id)")
def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.neighbours(fx.sections(spark, d)).select("section_id", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query("section_rollup", f"with c as (select cast(conv_id as varchar) section_id, turn, role, {_CHUNK} chunk_id from conversations) select section_id, arg_min(role, chunk_id) section_type, min(turn) page_start, max(turn) page_end, count(*) chunk_count from c group by 1")
def _sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.section_rollup(fx.sections(spark, d), ["section_type"])


@query("dedupe_keep_first", "select min(doc_id) doc_id, md5(text) text_hash from documents group by text")
def _dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_hash"))
    return dedup.keep_first(rows, ["text_hash"], ["doc_id"])


@query("stratified_sample", "select doc_id, sample_rank from (select doc_id, cast(row_number() over (partition by lang, source order by doc_id) as int) sample_rank from documents) where sample_rank <= 3")
def _sample(spark: SparkSession, d: str) -> DataFrame:
    return quality.review_sample(fx.chunks(spark, d), 3).select(F.col("chunk_id").alias("doc_id"), "sample_rank")


# Search


@query("bm25_topk", f"select chunk_id, round(bm25_score, 6) bm25_score, bm25_rank from ({sql.bm25(('onre', 'thand'), 20)})")
def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.bm25(fx.chunks(spark, d), SEARCH, 20), ("bm25_score",), 6)


@query("bm25_filtered", f"select chunk_id, round(bm25_score, 6) bm25_score, bm25_rank from ({sql.bm25(('onre', 'thand'), 20, chr(34) + 'lang' + chr(34) + " = 'en' and source = 'src0'")})")
def _bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.bm25(fx.chunks(spark, d), SEARCH, 20, values={"district": "en", "section_type": "src0"}), ("bm25_score",), 6)


@query("bm25_cohort", f"select chunk_id, round(bm25_score, 6) bm25_score, bm25_rank from ({sql.bm25(('onre', 'thand'), 20, 'true', 'chunk_id in (select doc_id from labels where quality = 1)')})")
def _bm25_cohort(spark: SparkSession, d: str) -> DataFrame:
    chunks = fx.chunks(spark, d).withColumn("cds_code", F.col("chunk_id"))
    cohort = fx.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("cds_code"))
    return _rounded(retrieval.bm25(chunks, SEARCH, 20, cohort=cohort), ("bm25_score",), 6)


def _vector(spark: SparkSession, d: str, i: int) -> list[float]:
    return [float(x) for x in fx.table(spark, d, "embeddings").where(F.col("vec_id") == i).first().embedding]


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@query("dense_topk", f"select chunk_id, round(dense_distance, 5) dense_distance, dense_rank from ({sql.dense(7, 20)})")
def _dense(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.dense(_embeddings(spark, d), _vector(spark, d, 7), 20), ("dense_distance",), 5)


_LISTS = f"b as ({sql.bm25(('onre', 'thand'), 80)}), v as ({sql.dense(7, 80)})"


@query("hybrid_rrf", f"with {_LISTS} select chunk_id, bm25_rank, dense_rank, round(coalesce(1.0e0 / (60 + bm25_rank), 0) + coalesce(1.0e0 / (60 + dense_rank), 0), 8) rrf_score from b full join v using (chunk_id)")
def _rrf(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.rrf_joined(retrieval.bm25(fx.chunks(spark, d), SEARCH, 80), retrieval.dense(_embeddings(spark, d), _vector(spark, d, 7), 80))
    return rows.select("chunk_id", "bm25_rank", "dense_rank", F.round("rrf_score", 8).alias("rrf_score"))


@query("weighted_rrf", f"with {_LISTS}, u as (select chunk_id, 0.58e0 / (60 + dense_rank) s from v union all select chunk_id, 0.42e0 / (60 + bm25_rank) from b) select chunk_id, round(sum(s), 8) rrf_score from u group by 1")
def _weighted(spark: SparkSession, d: str) -> DataFrame:
    lists = [(retrieval.dense(_embeddings(spark, d), _vector(spark, d, 7), 80), "dense_rank"), (retrieval.bm25(fx.chunks(spark, d), SEARCH, 80), "bm25_rank")]
    return _rounded(retrieval.rrf(lists, weights=[0.58, 0.42]), ("rrf_score",), 8)


@query("rrf_group_cap", f"""with b as ({sql.bm25(('onre', 'thand'), 80)}), v as ({sql.dense(7, 80, 'vec_id in (select doc_id from documents)')}), u as (select chunk_id, 0.58e0 / (60 + dense_rank) s from v union all select chunk_id, 0.42e0 / (60 + bm25_rank) from b), r as (select chunk_id, sum(s) s from u group by 1),
  j as (select chunk_id, lang district, s, row_number() over (partition by lang order by s desc, chunk_id) group_rank from r join documents on doc_id = chunk_id) select chunk_id, district, round(s, 8) rrf_score, group_rank from j where group_rank <= 2""")
def _capped(spark: SparkSession, d: str) -> DataFrame:
    rows = retrieval.search_by_district(fx.chunks(spark, d), _embeddings(spark, d), _vector(spark, d, 7), SEARCH, limit=50, candidates=80, keyword=True)
    return _rounded(rows.select("chunk_id", "district", "rrf_score", F.col("group_rank").cast("long").alias("group_rank")), ("rrf_score",), 8)


@query("missing_embeddings", "select doc_id chunk_id from documents where trim(text) <> '' and doc_id not in (select vec_id from embeddings) order by 1 limit 300")
def _missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    have = _embeddings(spark, d).withColumns({"embedding_model": F.lit("m"), "embedding_dimensions": F.lit(64)})
    return upsert.missing_embeddings(fx.chunks(spark, d), have, "m", 64, 300).select("chunk_id")


@query("embedding_progress", "select (select count(*) from documents) chunks, (select count(*) from embeddings) embeddings")
def _progress(spark: SparkSession, d: str) -> DataFrame:
    have = _embeddings(spark, d).withColumns({"embedding_model": F.lit("m"), "embedding_dimensions": F.lit(64)})
    return upsert.embedding_progress(fx.chunks(spark, d), have, "m", 64)


# Texts and numbers


@query("currency_parse", "select o_orderkey, o_totalprice amount, cast(floor(o_totalprice) as double) % 7 rest from orders")
def _currency(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("($"), F.format_number("o_totalprice", 2), F.lit(")"))
    rest = F.concat(F.lit("x "), (F.floor("o_totalprice") % 7).cast("string"), F.lit("% y"))
    return fx.table(spark, d, "orders").select("o_orderkey", numeric.currency(raw).alias("amount"), numeric.first_number(rest).alias("rest"))


@query("numeric_tokens_all", "select o_orderkey, [cast(o_orderkey as double), -(o_orderkey % 10 + 0.5e0)] tokens, 2 n from orders")
def _numbers_all(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(fx.table(spark, d, "orders"))


def _numbered(orders: DataFrame) -> DataFrame:
    raw = F.format_string("a1b %,d, (%d.5%%) q", F.col("o_orderkey"), F.col("o_orderkey") % 10)
    rows = orders.select("o_orderkey", numeric.numbers(raw).alias("tokens"))
    return rows.withColumn("n", F.size("tokens"))


_METRICS = """select l_orderkey, l_linenumber, l_returnflag = 'R' low, cast(floor(l_quantity) as double) b, cast(floor(l_quantity + l_tax * 100 - 4) as double) y,
  cast(floor(l_quantity + case when l_returnflag = 'R' then -3 else 3 end) as double) t, cast(floor(l_tax * 100 - 4) as double) m from lineitem"""


@query("metric_pace", f"""with x as ({_METRICS}), r as (select *, case when low then (b - y) / (b - t) else (y - b) / (t - b) end ratio from x)
  select case when ratio >= 1 then 'at_or_above_target' when ratio >= 1 / 3.0e0 then 'on_track' when ratio >= 0 then 'off_track' else 'moving_away' end status, count(*) n, round(sum(ratio), 3) total from r where b <> t group by 1""")
def _pace(spark: SparkSession, d: str) -> DataFrame:
    texts = ["metric_name", "baseline_raw", "year_1_outcome_raw", "year_3_target_raw"]
    rows = reports.distinct_texts(fx.metrics(spark, d), texts).select(numeric.pace(*texts).alias("p"), "copies")
    return rows.where("p is not null").groupBy("p.status").agg(F.sum("copies").alias("n"), F.round(F.sum(F.col("p.ratio") * F.col("copies")), 3).alias("total"))


@query("metric_movement", f"with x as ({_METRICS}) select case when m = 0 then 'flat' when low = (m < 0) then 'improving' else 'worsening' end movement, count(*) n from x group by 1")
def _movement(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.metrics(spark, d).select(F.explode(numeric.movements("metric_name", "current_difference_from_baseline_raw")).alias("m"))
    return rows.groupBy("m.movement").agg(F.count("*").alias("n"))


# Rollups: every account is a district, every order a goal


def _named(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return df.join(fx.districts(spark, d).select("cds_code", F.col("county").alias("district_name")), "cds_code")


def _theme_rows(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("Math science", "Parent outreach", "Career pathway", "Data platform", "Nothing here")]), F.col("_k") + 1)
    goals = _named(fx.goals(spark, d).withColumn("_k", (F.col("goal_id") % 5).cast("int")).withColumn("description", word), spark, d)
    actions = _named(fx.actions(spark, d).withColumn("_k", (F.col("action_number").cast("int") % 5)).withColumns({"title": word, "description": F.lit("")}), spark, d)
    metrics = _named(fx.metrics(spark, d).withColumn("goal_description", F.lit("")), spark, d)
    return reports.themed(goals, actions, metrics)


_THEMES = "case {} when 0 then 'academic_instruction' when 1 then 'family_community' when 2 then 'college_career' when 3 then 'technology_data' else 'other' end"


@query("theme_rollup", f"""{sql.WITH}, li as (select o_custkey cds_code, l_returnflag f from lineitem join orders on l_orderkey = o_orderkey),
  u as (select cds_code, {_THEMES.format('goal_id % 5')} theme_key, 'g' k, 0 x from goals union all select cds_code, {_THEMES.format('cast(action_number as int) % 5')}, 'a', total_funds from actions
    union all select cds_code, case when f = 'R' then 'attendance_climate' else 'college_career' end, 'm', 0 from li),
  v as (select u.*, county from u join districts using (cds_code))
  select theme_key, count(distinct county) districts_with_theme, count(*) filter (where k = 'g') goal_count, count(*) filter (where k = 'a') action_count, count(*) filter (where k = 'm') metric_count,
  round(cast(sum(cast(x as decimal(18,2))) as double), 2) total_action_dollars from v group by 1""")
def _themes(spark: SparkSession, d: str) -> DataFrame:
    return reports.theme_summary(_theme_rows(spark, d)).drop("theme_label", "dollar_share")


_SCORED = f"""with x as (select o_custkey, m.* from ({_METRICS}) m join orders on o_orderkey = m.l_orderkey), s as (select n_name district_name, case when low then (b - y) / (b - t) else (y - b) / (t - b) end ratio from x
  join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where b <> t)"""


@query("district_progress", f"""{_SCORED} select district_name, count(*) scorable_metrics, count(*) filter (where ratio >= 1) at_or_above_target, count(*) filter (where ratio >= 1/3.0e0 and ratio < 1) on_track,
  count(*) filter (where ratio >= 0 and ratio < 1/3.0e0) off_track, count(*) filter (where ratio < 0) moving_away, round(count(*) filter (where ratio >= 1/3.0e0) / count(*), 4) positive_share from s group by 1""")
def _district_progress(spark: SparkSession, d: str) -> DataFrame:
    return reports.district_progress(_theme_rows(spark, d)).select("district_name", "scorable_metrics", *reports.STATUSES, "positive_share")


@query("overall_progress", f"{_SCORED} select count(*) scorable_metrics, count(*) filter (where ratio >= 1/3.0e0) positive from s")
def _overall(spark: SparkSession, d: str) -> DataFrame:
    return reports.overall_progress(_theme_rows(spark, d)).select("scorable_metrics", (F.col("at_or_above_target") + F.col("on_track")).alias("positive"))


def _area_rows(spark: SparkSession, d: str, examples: int = 0) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("Algebra teacher", "Home visit outreach", "Wifi", "Nothing")]), F.col("_k") + 1)
    goals = _named(fx.goals(spark, d).withColumn("description", F.lit("")), spark, d)
    actions = _named(fx.actions(spark, d).withColumn("_k", F.col("action_number").cast("int") % 4).withColumns({"title": word, "description": F.lit("")}), spark, d)
    return reports.area_rows(goals, actions, _named(fx.metrics(spark, d), spark, d), examples)


@query("area_rollup", f"""{sql.WITH}, w as (select county, cast(action_number as int) % 4 k, total_funds x from actions join districts using (cds_code)),
  a as (select 'math_proficiency' area_key, county, x, 0.20 v from w where k = 0 union all select 'chronic_absenteeism', county, x, 0.60 from w where k = 1 union all select 'family_community_engagement', county, x, 0.60 from w where k = 1 union all select 'data_technology', county, x, 0.40 from w where k = 2),
  m as (select case when l_returnflag = 'R' then 'chronic_absenteeism' else 'graduation_credit_recovery' end area_key, n_name county from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
  u as (select area_key, county, 1 a, 0 m, x, v from a union all select area_key, county, 0, 1, 0, 0 from m)
  select area_key, count(distinct county) districts_with_area, cast(sum(a) as bigint) action_count, cast(sum(m) as bigint) metric_count, round(cast(sum(cast(x as decimal(24,4))) as double), 0) action_dollars, round(cast(sum(cast(x * v as decimal(24,4))) as double), 0) externalizable_dollars from u group by 1""")
def _areas(spark: SparkSession, d: str) -> DataFrame:
    out = reports.area_rollup(_area_rows(spark, d), 25).select("area_key", "districts_with_area", "action_count", "metric_count", "action_dollars", "externalizable_dollars")
    return _rounded(out, ("action_dollars", "externalizable_dollars"), 0)


@query("area_score")
def _area_score(spark: SparkSession, d: str) -> DataFrame:
    return reports.area_rollup(_area_rows(spark, d), 25)


@query("district_area_examples")
def _examples(spark: SparkSession, d: str) -> DataFrame:
    return reports.area_examples(reports.district_areas(_area_rows(spark, d, 3)))


def _explicit(spark: SparkSession, d: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("SARB outreach (pilot)", "Home visit", "Attendance team", "Library")]), F.col("_k") + 1)
    rows = fx.actions(spark, d).withColumn("_k", F.col("action_number").cast("int") % 4).withColumns({"title": word, "description": F.lit("")})
    # the ordinal: rows of one key are equal but for funds and order number
    return reports.explicit_actions(fx.spread(_named(rows, spark, d)).withColumns({"goal_number": F.col("goal_id"), "action_number": F.concat_ws("/", "goal_id", "action_number"), "ord": F.struct("action_id", "total_funds")}))


@query("tactic_rollup", f"""{sql.WITH}, e as (select county, cast(action_number as int) % 4 k, goal_id || '/' || action_number key, min(total_funds) f from (select a.*, county, row_number() over (partition by county, goal_id, action_number order by total_funds) r from actions a join districts using (cds_code)) where cast(action_number as int) % 4 < 3 and r = 1 group by 1, 2, 3),
  t as (select 'SART / SARB' tactic, * from e where k = 0 union all select 'Messaging / Outreach', * from e where k = 0 union all select 'Home Visits', * from e where k = 1 union all select 'Attendance Teams / Protocols', * from e where k = 2)
  select tactic, count(distinct county) district_count, count(*) action_count, cast(sum(cast(f as decimal(18,2))) as double) matched_action_dollars from t group by 1""")
def _tactics(spark: SparkSession, d: str) -> DataFrame:
    return reports.tactic_rollup(_explicit(spark, d)).drop("examples")


# Quality gate

_QA = r"""with t as (select doc_id, text, regexp_replace(text, '\s+', ' ', 'g') b from documents), l as (select doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) x from documents),
  s as (select doc_id, count(*) n, sum(case when length(regexp_replace(x, '\D', '', 'g')) / length(x)::double > 0.22 or ((contains(x, '$') or contains(x, '%')) and len(string_split(x, ' ')) <= 14) then 1 else 0 end) hit,
    sum(case when length(regexp_replace(x, '\D', '', 'g')) / length(x)::double > 0.22 or ((contains(x, '$') or contains(x, '%')) and len(string_split(x, ' ')) <= 14) or len(string_split(x, ' ')) <= 3 then 1 else 0 end) hit5 from l where x <> '' group by 1)"""


@query("line_table_score", f"{_QA} select doc_id, round(case when n >= 5 then hit5 else hit end / n::double, 6) table_score from s")
def _table_score(spark: SparkSession, d: str) -> DataFrame:
    return fx.spread(fx.table(spark, d, "documents")).select("doc_id", F.round(quality.line_table_score(F.col("text")), 6).alias("table_score"))


def _qa_chunks(spark: SparkSession, d: str) -> DataFrame:
    low = F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(0.9)
    return fx.spread(fx.table(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("district"), F.col("source").alias("section_type"), F.col("source").alias("section_path"), (F.col("doc_id") % 5).alias("page_start"), F.col("text").alias("body_text"), low.alias("authored_confidence"))


@query("qa_issues", "select issue, count(*) n from (select case when greatest(1, length(text) // 4) < 45 then 'too_short' end issue from documents union all select case when greatest(1, length(text) // 4) > 1100 then 'too_long' end from documents union all select case when doc_id % 5 = 0 then 'missing_citation_metadata' end from documents union all select case when doc_id % 3 = 0 then 'low_confidence' end from documents) where issue is not null group by 1")
def _qa_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.issue_counts(_qa_chunks(spark, d))


@query("qa_summary", "select count(*) chunks, count(distinct lang) districts, count(*) filter (where doc_id % 5 = 0) hard_issue_chunk_count, count(*) filter (where doc_id % 5 = 0) / count(*) <= 0.03 pass from documents")
def _qa_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.summary(_qa_chunks(spark, d)).select("chunks", "districts", "hard_issue_chunk_count", "pass")


@query("authored_confidence")
def _confidence(spark: SparkSession, d: str) -> DataFrame:
    return fx.spread(fx.table(spark, d, "documents")).select("doc_id", chunking.authored_confidence("text", F.when(F.col("doc_id") % 2 == 0, 0)).alias("confidence"), F.round(chunking.table_like_score("text"), 6).alias("score"))


@query("html_lines")
def _html(spark: SparkSession, d: str) -> DataFrame:
    return fx.spread(fx.table(spark, d, "pages")).select("page_id", text.html_lines("html").alias("lines"), text.blocked_page("html").alias("blocked"))


@query("chunk_pack")
def _pack(spark: SparkSession, d: str) -> DataFrame:
    return fx.spread(fx.table(spark, d, "documents")).select("doc_id", F.posexplode(chunking.packed(chunking.text_units("text"))).alias("chunk_index", "body_text"))


@query("segment_lines")
def _segments(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).cast("int").alias("page_number"), F.concat(F.lit("Plan Summary\n"), "text").alias("text"))
    return chunking.segments(pages)


@query("student_groups_shapes")
def _shapes(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('{"status": '), F.round("value", 2).cast("string"), F.lit(', "studentGroup": "G", "count": 3}'))
    k = F.col("event_id") % 3
    shape = F.when(k == 0, F.concat(F.lit('{"primary": {"list": ['), body, F.lit("]}}"))).when(k == 1, F.concat(F.lit('{"primary": '), body, F.lit("}"))).otherwise(F.concat(F.lit('{"list": ['), body, F.lit(", "), body, F.lit("]}")))
    package = F.concat(F.lit('{"metadata": {"school_year_id": 7, "district": {"cds_code": "'), F.col("user_id").cast("string"), F.lit('"}}, "student_groups": {"4": '), shape, F.lit("}}"))
    rows = flatten.dashboard_student_groups(flatten.packages(fx.table(spark, d, "events").select(package.alias("value"))))
    return rows.groupBy("cds_code", "indicator_name", "student_group", "school_year_id").agg(F.count("*").alias("n"), F.round(F.sum("status"), 2).alias("total"))


_ORACLES["student_groups_shapes"] = "select cast(user_id as varchar) cds_code, 'graduation_rate' indicator_name, 'G' student_group, 7 school_year_id, cast(sum(case when event_id % 3 = 2 then 2 else 1 end) as bigint) n, round(sum(round(value, 2) * case when event_id % 3 = 2 then 2 else 1 end), 2) total from events group by 1"

# Upserts


@query("guarded_upsert", """with t as (select s_suppkey k, s_name v, s_suppkey % 4 = 0 good from supplier where s_suppkey % 2 = 0), i as (select s_suppkey k, upper(s_name) v from supplier where s_suppkey % 3 = 0)
  select k cds_code, case when t.k is not null and good then t.v when i.k is not null then i.v else t.v end district, case when t.k is null then 'new' else 'old' end email from t full join i using (k)""")
def _guarded(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "supplier")
    detail = F.when(F.col("s_suppkey") % 4 == 0, upsert.DETAIL_SOURCE).otherwise("x").alias("source")
    target = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("cds_code"), F.col("s_name").alias("district"), F.lit("old").alias("email"), detail, F.lit("ok").alias("parse_status"))
    new = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("cds_code"), F.upper("s_name").alias("district"), F.lit("new").alias("email"), F.lit("public").alias("source"), F.lit("ok").alias("parse_status"))
    return upsert.directory_upsert(target, new).select("cds_code", "district", "email")


@query("insert_if_absent", "select c_custkey k, c_custkey not in (select c_custkey from customer where c_custkey % 2 = 0) created from customer where c_custkey % 3 = 0")
def _insert(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return upsert.insert_if_absent(c.where("k % 2 = 0"), c.where("k % 3 = 0"), ["k"])[1]


@query("failure_upsert", """with t as (select s_suppkey k, case when s_suppkey % 2 = 0 then 'ok' else 'error' end s from supplier), f as (select s_suppkey k, case when s_suppkey % 3 = 0 then 'Captcha seen' else 'timeout' end m from supplier where s_suppkey % 5 = 0)
  select t.k cds_code, case when t.s = 'ok' or f.k is null then t.s when contains(lower(m), 'captcha') then 'blocked' else 'error' end parse_status, case when t.s = 'ok' or f.k is null then '' else m end parse_error from t left join f using (k)""")
def _failure(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "supplier")
    target = s.select(F.col("s_suppkey").alias("cds_code"), F.when(F.col("s_suppkey") % 2 == 0, "ok").otherwise("error").alias("parse_status"), F.lit("").alias("parse_error"))
    failed = s.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("cds_code"), F.when(F.col("s_suppkey") % 3 == 0, "Captcha seen").otherwise("timeout").alias("message"))
    return upsert.failure_upsert(target, failed)
