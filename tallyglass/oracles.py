"""DuckDB SQL of the catalogue's queries over the same Parquet tables: independent of the Spark plans."""

from __future__ import annotations

DISTRICTS = "select c_custkey cds_code, n_name county, c_name district from customer join nation on n_nationkey = c_nationkey"
DOCS = "select c_custkey cds_code, c_name district, case when c_custkey % 10 = 0 then 0 when c_custkey % 7 <> 0 then 1 end district_name_match from customer"
DOCS2 = f"{DOCS} union all select * from ({DOCS}) where cds_code % 5 = 0"
ACTIONS = """select o_custkey cds_code, l_orderkey || ':' || l_linenumber action_id, cast(l_orderkey as varchar) goal_id, cast(l_linenumber as varchar) action_number,
  p_name title, lower(p_type) || ' ' || lower(p_brand) description, l_extendedprice total_funds
  from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey"""
GOALS = "select o_custkey cds_code, o_orderkey goal_id, cast(o_orderkey as varchar) goal_number, o_orderstatus goal_type, o_orderpriority description from orders"
def mean(value: str) -> str:
    return f"cast(sum(cast({value} as decimal(18,2))) as double) / count({value})"


IND = f"""select user_id cds_code, event_type indicator_name, 'ALL' student_group, {mean('value')} status,
  {mean("case when ts >= timestamp '2024-01-16 00:00:00' then value end")} - {mean("case when ts < timestamp '2024-01-16 00:00:00' then value end")} change,
  count(*) cnt, sum(case when value >= 10 then 1 else 0 end) chronic_count from events group by user_id, event_type"""
WITH = f"with districts as ({DISTRICTS}), docs as ({DOCS}), docs2 as ({DOCS2}), actions as ({ACTIONS}), goals as ({GOALS}), ind as ({IND})"
VALID = "coalesce(district_name_match, 1) <> 0"
TEXT = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"


def any_of(expression: str, terms: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({expression}, '{t}')" for t in terms) + ")"


def opportunities(trend: str, order: str, terms: tuple[str, ...], strict: tuple[str, ...], indicator: str, limit: int, extra: str = "") -> str:
    broad, title, goal = any_of(TEXT, terms), any_of("lower(coalesce(title, ''))", strict), any_of("lower(coalesce(description, ''))", terms)
    spent = lambda hit, name: f"""{name} as (select cds_code, count(distinct action_id) n, cast(round(sum(cast(coalesce(total_funds, 0) as decimal(18,2))), 0) as double) f
      from actions where {hit} and cds_code in (select cds_code from docs where {VALID}) group by cds_code)"""  # noqa: E731
    return f"""{WITH}, o as (select * from ind where indicator_name = '{indicator}' {trend}),
    {spent(broad, 'ba')}, {spent(title, 'sa')},
    gm as (select cds_code, count(distinct goal_id) n from goals where {goal} group by cds_code),
    r as (select d.cds_code, d.county, d.district, o.status current_status, o.change outcome_change, o.cnt enrollment_count,
      cast(o.chronic_count as bigint) affected_student_count, coalesce(ba.n, 0) broad_action_count, coalesce(ba.f, 0) broad_action_funds,
      coalesce(sa.n, 0) strict_action_count, coalesce(sa.f, 0) strict_action_funds, coalesce(gm.n, 0) topic_goal_count,
      case when coalesce(ba.f, 0) > 0 then 100.0::double * coalesce(sa.f, 0) / ba.f else 0 end strict_share_pct,
      round(2.0 * log10((case when coalesce(sa.f, 0) > 0 then sa.f else 0.15::double * coalesce(ba.f, 0) end) + 1) + 1.5::double * log10(o.chronic_count + 1)
        + coalesce(o.status, 0) / 10.0::double + abs(coalesce(o.change, 0)), 3) opportunity_score,
      case when coalesce(o.change, 0) = 0 then 'flat' when o.change < 0 then 'improving' else 'worsening' end outcome_read
      from o join districts d using (cds_code) left join ba using (cds_code) left join sa using (cds_code) left join gm using (cds_code)
      where (coalesce(ba.n, 0) > 0 or coalesce(sa.n, 0) > 0 or coalesce(gm.n, 0) > 0) {extra})
    select * from r order by {order} limit {limit}"""


def top_actions(hit: str, n: int) -> str:
    return f"""{WITH}, m as (select * from actions where {hit} and cds_code in (select cds_code from docs where {VALID})),
    r as (select *, cast(row_number() over (partition by cds_code order by coalesce(total_funds, 0) desc, action_id, title) as int) as rank from m)
    select cds_code, rank, action_id, goal_id, title, total_funds, description description_snippet, case
      when {any_of("lower(title || ' ' || description)", ('software', 'platform', 'system', 'dashboard', 'data', 'analytics', 'monitor'))} then 'software_or_data_system'
      when {any_of("lower(title || ' ' || description)", ('outreach', 'message', 'messaging', 'communication', 'notify', 'phone', 'text', 'family engagement'))} then 'outreach_workflow'
      when {any_of("lower(title || ' ' || description)", ('base:', 'base ', 'instruction', 'teacher', 'staffing'))} then 'bundled_or_staffing'
      when total_funds >= 5000000 then 'large_unclear_bundle' else 'unclear' end actionability
    from r where rank <= {n}"""


def declining(terms: tuple[str, ...], indicator: str) -> str:
    text, title = any_of("lower(title || ' ' || description)", terms), any_of("lower(title)", terms)
    return f"""{WITH}, dec as (select * from ind where indicator_name = '{indicator}' and change < 0),
    v as (select cds_code from docs2 where {VALID}),
    broad as (select cds_code, sum(cast(coalesce(total_funds, 0) as decimal(18,2))) f, count(action_id) n from actions join dec using (cds_code) join v using (cds_code) where {text} group by cds_code),
    strict as (select cds_code, sum(cast(coalesce(total_funds, 0) as decimal(18,2))) f, count(action_id) n from actions join dec using (cds_code) join v using (cds_code) where {title} group by cds_code)"""


def summary(terms: tuple[str, ...], indicator: str) -> str:
    return f"""{declining(terms, indicator)} select (select count(*) from dec) declining_count, (select count(*) from broad) broad_count,
    (select cast(round(sum(f), 0) as double) from broad) broad_funds, (select count(*) from strict) strict_count,
    (select cast(round(sum(f), 0) as double) from strict) strict_funds, (select count(*) from docs2 where district_name_match = 0) excluded_mismatch_count"""


def candidates(terms: tuple[str, ...], indicator: str) -> str:
    return f"""{declining(terms, indicator)} select d.cds_code, d.county, d.district, status rate, change rate_change, cnt enrolled_count, cast(chronic_count as bigint) chronic_count,
    cast(coalesce(b.f, 0) as double) broad_funds, coalesce(b.n, 0) broad_actions, cast(coalesce(s.f, 0) as double) strict_funds, coalesce(s.n, 0) strict_actions,
    case when coalesce(b.f, 0) > 0 then 100.0::double * cast(coalesce(s.f, 0) as double) / cast(b.f as double) else 0 end actionable_share_pct,
    case when status >= 25 then 'very high residual need' when status >= 20 then 'high residual need' when status >= 15 then 'moderate residual need' else 'lower residual need' end residual_need_band
    from dec join districts d using (cds_code) left join broad b using (cds_code) left join strict s using (cds_code)"""


def evidence(terms: tuple[str, ...], n: int) -> str:
    text = any_of("lower(title || ' ' || description)", terms)
    return f"""{WITH}, m as (select a.* from actions a join (select cds_code from docs2 where {VALID}) using (cds_code) where {text}),
    r as (select *, cast(row_number() over (partition by cds_code order by coalesce(total_funds, 0) desc, action_id, title) as int) as rank from m)
    select cds_code, rank, action_id, title, total_funds, left(replace(description, chr(10), ' '), 260) description from r where rank <= {n}"""


def grouped(terms: tuple[str, ...]) -> str:
    return f"""{WITH} select county, d.district, indicator_name, status, cast(round(sum(cast(coalesce(total_funds, 0) as decimal(18,2))), 0) as double) funds, count(*) actions
    from ind join districts d using (cds_code) join actions a using (cds_code) join (select cds_code from docs2 where {VALID}) using (cds_code)
    where {any_of(TEXT, terms)} group by county, d.district, indicator_name, ind.status"""


TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}\p{{Mn}}]+'), lambda x: x <> '')"


def bm25(terms: tuple[str, ...], limit: int, where: str = "true", cohort: str = "true") -> str:
    words = TOKENS.format("coalesce(text, '') || ' ' || coalesce(lang, '') || ' ' || coalesce(source, '')")
    f = lambda k, t: f"len(list_filter(w, lambda x: x = '{t}')) f{k}"
    counted = ", ".join(f(k, t) for k, t in enumerate(terms))
    df = ", ".join(f"sum(case when f{k} > 0 then 1 else 0 end) d{k}" for k in range(len(terms)))
    idf = lambda k: f"(case when ln((ndocs - d{k} + 0.5e0) / (d{k} + 0.5e0)) <= 0 then 1e-6 else ln((ndocs - d{k} + 0.5e0) / (d{k} + 0.5e0)) end)"
    score = " ".join(f"- {idf(k)} * f{k} * 2.2e0 / (f{k} + 1.2e0 * (0.25e0 + 0.75e0 * n / av))" for k in range(len(terms)))
    return f"""with t as (select doc_id chunk_id, lang, source, {words} w from documents), c as (select chunk_id, lang, source, len(w) n, {counted} from t),
    s as (select cast(count(*) as double) ndocs, avg(n) av, {df} from c),
    r as (select chunk_id, 0.0e0 {score} bm25_score from c, s where ({' or '.join(f'f{k} > 0' for k in range(len(terms)))}) and {where} and {cohort}),
    b as (select chunk_id, bm25_score, cast(row_number() over (order by bm25_score, chunk_id) as int) bm25_rank from r)
    select chunk_id, bm25_score, bm25_rank from b where bm25_rank <= {limit}"""


def dense(query: int, limit: int, where: str = "true") -> str:
    q = f"(select [x::double for x in embedding] from embeddings where vec_id = {query})"
    return f"""with q as (select {q} v), r as (select vec_id chunk_id, 1 - list_cosine_similarity([x::double for x in embedding], v) d from embeddings, q where {where}),
    b as (select chunk_id, d dense_distance, cast(row_number() over (order by d, chunk_id) as int) dense_rank from r) select * from b where dense_rank <= {limit}"""
