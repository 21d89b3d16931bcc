"""Accounts ranked by joining outcome trends to topic-matched spend, and what explains them.

All plans aggregate each side by account before joining, so facts never fan out; the aggregates
are as small as the number of accounts and Spark picks the join by their measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.config import Topic, normal_name, topic
from tallyglass.functions.classify import actionability
from tallyglass.functions.numeric import opportunity_score, outcome_read, share_percent
from tallyglass.functions.text import contains_any, joined_text, like_pattern, normal_space

RANKINGS = ("broad_action_funds", "strict_action_funds", "affected_student_count", "current_status", "outcome_change", "opportunity_score")
METRIC_TEXTS = ("metric_name", "baseline_raw", "year_1_outcome_raw", "year_2_outcome_raw", "year_3_target_raw", "current_difference_from_baseline_raw")


def as_topic(name: str | Topic) -> Topic:
    return topic(name) if isinstance(name, str) else name


def clamped(n: int, least: int, most: int) -> int:
    return max(least, min(n, most))


def trend_filter(change: Column, trend: str, lower_is_better: bool) -> Column | None:
    """The predicate of a named trend, or None for any trend; a null change fits none of the others."""
    name = normal_name(trend)
    down, up = change < 0, change > 0
    if name in ("any", "all", ""):
        return None
    if name == "improving":
        return down if lower_is_better else up
    if name == "worsening":
        return up if lower_is_better else down
    if name in ("decreasing_rate", "declining_rate", "rate_declining"):
        return down
    if name in ("increasing_rate", "rising_rate", "rate_increasing"):
        return up
    raise ValueError("Unsupported outcome_trend. Use improving, worsening, decreasing_rate, increasing_rate, or any.")


def valid_documents(documents: DataFrame) -> DataFrame:
    """Documents whose district matches or can't be told (null counts as valid)."""
    return documents.where(F.coalesce("district_name_match", F.lit(1)) != 0)


def matching_actions(actions: DataFrame, documents: DataFrame, of: Topic, scope: str) -> DataFrame:
    """Actions on a topic (by title and description, or strictly by title) of accounts with a valid document."""
    hit = contains_any(F.coalesce("title", F.lit("")), of.strict) if scope == "strict" else contains_any(joined_text("title", "description"), of.terms)
    return actions.where(hit).join(valid_documents(documents).select("cds_code"), "cds_code", "left_semi")


def matching_goals(goals: DataFrame, of: Topic) -> DataFrame:
    return goals.where(contains_any(F.coalesce("description", F.lit("")), of.terms))


def matching_metrics(metrics: DataFrame, of: Topic) -> DataFrame:
    return metrics.where(contains_any(joined_text(*METRIC_TEXTS), of.terms))


def topic_spend(actions: DataFrame, documents: DataFrame, of: Topic) -> DataFrame:
    """Broad and strict spend per account in one pass over the actions."""
    broad = contains_any(joined_text("title", "description"), of.terms)
    strict = contains_any(F.coalesce("title", F.lit("")), of.strict)
    hits = actions.withColumns({"_broad": broad, "_strict": strict}).where("_broad or _strict")
    hits = hits.join(valid_documents(documents).select("cds_code"), "cds_code", "left_semi")
    funds = F.coalesce(F.col("total_funds"), F.lit(0)).cast("decimal(18,2)")
    out = []
    for name in ("broad", "strict"):
        own = F.col(f"_{name}")
        out += [F.countDistinct(F.when(own, F.col("action_id"))).alias(f"{name}_action_count"), F.round(F.sum(F.when(own, funds)), 0).cast("double").alias(f"{name}_action_funds")]
    return hits.groupBy("cds_code").agg(*out)


def find_opportunities(
    tables: dict[str, DataFrame],
    topic: str | Topic = "chronic_absenteeism",
    outcome_trend: str = "worsening",
    rank_by: str = "strict_action_funds",
    county: str | None = None,
    district: str | None = None,
    limit: int = 25,
    include_actions: bool = False,
    action_limit: int = 3,
    tie_break: bool = True,
) -> DataFrame:
    """``tables``: indicators, districts, documents, actions, goals and optionally metrics."""
    of = as_topic(topic)
    key = normal_name(rank_by)
    if key not in RANKINGS:
        raise ValueError(f"Unsupported rank_by. Use one of {', '.join(RANKINGS)}.")
    outcomes = tables["indicators"].where((F.col("indicator_name") == of.indicator) & (F.col("student_group") == of.group))
    trend = trend_filter(F.col("change"), outcome_trend, of.lower_is_better)
    outcomes = outcomes if trend is None else outcomes.where(trend)
    accounts = tables["districts"]
    if county:
        accounts = accounts.where(F.col("county") == county)
    if district:
        accounts = accounts.where(like_pattern("district", district))
    counted = [
        topic_spend(tables["actions"], tables["documents"], of),
        matching_goals(tables["goals"], of).groupBy("cds_code").agg(F.countDistinct("goal_id").alias("topic_goal_count")),
    ]
    if "metrics" in tables:
        counted.append(matching_metrics(tables["metrics"], of).groupBy("cds_code").agg(F.countDistinct("metric_id").alias("topic_metric_count")))
    rows = outcomes.join(accounts.select("cds_code", "county", "district"), "cds_code")
    rows = reduce(lambda left, right: left.join(right, "cds_code", "left"), counted, rows)
    counts = ["broad_action_count", "strict_action_count", "topic_goal_count"] + ["topic_metric_count"] * ("metrics" in tables)
    rows = rows.fillna(0, [*counts, "broad_action_funds", "strict_action_funds"])
    rows = rows.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counts]))
    rows = rows.select(
        "cds_code",
        "county",
        "district",
        "indicator_name",
        "student_group",
        F.col("status").alias("current_status"),
        F.col("change").alias("outcome_change"),
        F.col("count").alias("enrollment_count"),
        F.col("chronic_count").cast("long").alias("affected_student_count"),
        *counts,
        "broad_action_funds",
        "strict_action_funds",
        share_percent(F.col("strict_action_funds"), F.col("broad_action_funds")).alias("strict_share_pct"),
    )
    score = opportunity_score(*[F.col(c) for c in ("strict_action_funds", "broad_action_funds", "affected_student_count", "current_status", "outcome_change")])
    rows = rows.withColumns({"opportunity_score": F.round(score, 3), "outcome_read": outcome_read("outcome_change", of.lower_is_better)})
    rows = rows.orderBy(*ranking(key, tie_break)).limit(limit)
    if not include_actions:
        return rows
    scope = "strict" if key == "strict_action_funds" else "broad"
    best = top_actions(matching_actions(tables["actions"], tables["documents"], of, scope).join(rows.select("cds_code"), "cds_code", "left_semi"), action_limit)
    nested = best.groupBy("cds_code").agg(F.sort_array(F.collect_list(F.struct("rank", "action_id", "title", "total_funds", "description_snippet", "actionability"))).alias("top_actions"))
    return rows.join(nested, "cds_code", "left").orderBy(*ranking(key, tie_break))


def ranking(key: str, tie_break: bool = True) -> list[Column]:
    """Highest first with the district descending on ties; the score has it ascending.

    Without tie-break the district counts for the score only, as in the served form of the ranking.
    """
    if not tie_break and key != "opportunity_score":
        return ranking(key)[:1]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    if key == "opportunity_score":
        return [F.col(key).desc(), F.col("district").asc()]
    if key == "outcome_change":
        return [F.abs(zero(key)).desc(), F.col("district").desc()]
    return [zero(key).desc(), F.col("district").desc()]


def top_actions(actions: DataFrame, n: int, snippet_chars: int = 360) -> DataFrame:
    """The n best funded actions of each account, classified; ties go to the smaller action id."""
    order = Window.partitionBy("cds_code").orderBy(F.coalesce("total_funds", F.lit(0.0)).desc(), "action_id", "title")
    rows = actions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    rows = rows.withColumn("description_snippet", F.left(normal_space("description"), F.lit(snippet_chars)))
    rows = rows.withColumn("_read", actionability("title", "description_snippet", "total_funds"))
    return rows.select("cds_code", "rank", "action_id", "goal_id", "title", "total_funds", "description_snippet", "_read.*")


def fetch_topic_actions(tables: dict[str, DataFrame], cds_code: object, topic: str | Topic = "chronic_absenteeism", scope: str = "broad", limit: int = 5) -> DataFrame:
    own = tables["actions"].where(F.col("cds_code") == cds_code)
    docs = tables["documents"].where(F.col("cds_code") == cds_code)
    return top_actions(matching_actions(own, docs, as_topic(topic), scope), limit).orderBy("rank")


def fetch_topic_goals(tables: dict[str, DataFrame], cds_code: object, topic: str | Topic = "chronic_absenteeism", limit: int = 5) -> DataFrame:
    rows = matching_goals(tables["goals"].where(F.col("cds_code") == cds_code), as_topic(topic))
    out = rows.select("goal_id", "goal_number", "goal_type", F.left(normal_space("description"), F.lit(420)).alias("description_snippet"))
    return out.orderBy("goal_number", "goal_id").limit(limit)


def fetch_topic_metrics(tables: dict[str, DataFrame], cds_code: object, topic: str | Topic = "chronic_absenteeism", limit: int = 5) -> DataFrame:
    rows = matching_metrics(tables["metrics"].where(F.col("cds_code") == cds_code), as_topic(topic))
    return rows.select("metric_id", "goal_number", "metric_number", *METRIC_TEXTS).orderBy("goal_number", "metric_number", "metric_id").limit(limit)


def account_brief(tables: dict[str, DataFrame], cds_code: object, topic: str | Topic = "chronic_absenteeism", action_limit: int = 6) -> dict[str, DataFrame]:
    """All that is known of one account on a topic, as a bundle of lazy point lookups."""
    of = as_topic(topic)
    at = F.col("cds_code") == cds_code
    return {
        "district": tables["districts"].where(at),
        "dashboard_outcome": tables["indicators"].where(at & (F.col("indicator_name") == of.indicator) & (F.col("student_group") == of.group)).limit(1),
        "topic_goals": fetch_topic_goals(tables, cds_code, of),
        "topic_metrics": fetch_topic_metrics(tables, cds_code, of),
        "broad_topic_actions": fetch_topic_actions(tables, cds_code, of, "broad", action_limit),
        "strict_topic_actions": fetch_topic_actions(tables, cds_code, of, "strict", action_limit),
    }
