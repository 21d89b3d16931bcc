"""Reports: declining rates with their spend, themes, opportunity areas, attendance titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass import config
from tallyglass.functions import classify, numeric
from tallyglass.functions.text import compact, contains_any, joined_text, one_line
from tallyglass.plans.opportunities import valid_documents

STATUSES = ("at_or_above_target", "on_track", "off_track", "moving_away")
MOVEMENTS = ("improving", "flat", "worsening")


# Declining rates. Unlike the opportunities, actions are joined to documents plainly: an account
# with two valid documents counts its funds and actions twice, as the report is defined.


def declining(indicators: DataFrame, indicator: str = "chronic_absenteeism", group: str = "ALL") -> DataFrame:
    return indicators.where((F.col("indicator_name") == indicator) & (F.col("student_group") == group) & (F.col("change") < 0))


def report_hits(terms: tuple[str, ...], strict: bool) -> Column:
    """The report's own terms; a null description makes the broad text null, which matches nothing."""
    text = F.col("title") if strict else F.concat(F.col("title"), F.lit(" "), F.col("description"))
    return contains_any(text, terms)


def declining_spend(tables: dict[str, DataFrame], which: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Broad and strict funds and actions of the given accounts in one pass over the actions.

    An account without a hit of a kind has null for it. A null broad text can still be a strict hit.
    """
    hits = tables["actions"].withColumns({"_broad": report_hits(terms, False), "_strict": report_hits(terms, True)}).where("_broad or _strict")
    hits = hits.join(which.select("cds_code"), "cds_code").join(valid_documents(tables["documents"]).select("cds_code"), "cds_code")
    funds = F.coalesce(F.col("total_funds"), F.lit(0)).cast("decimal(18,2)")
    out = []
    for name in ("broad", "strict"):
        own = F.col(f"_{name}")
        out += [F.sum(F.when(own, funds)).alias(f"{name}_funds"), F.nullif(F.count(F.when(own, F.col("action_id"))), F.lit(0)).alias(f"{name}_actions")]
    return hits.groupBy("cds_code").agg(*out)


def declining_summary(tables: dict[str, DataFrame], terms: tuple[str, ...] = config.REPORT_TERMS, indicator: str = "chronic_absenteeism") -> DataFrame:
    """One row: accounts that decline, those with broad and strict spend, funds, excluded documents."""
    which = declining(tables["indicators"], indicator)
    money = lambda k: F.round(F.sum(f"{k}_funds"), 0).cast("double").alias(f"{k}_funds")
    spent = declining_spend(tables, which, terms).agg(*[x for k in ("broad", "strict") for x in (F.count(f"{k}_funds").alias(f"{k}_count"), money(k))])
    parts = [which.agg(F.count("*").alias("declining_count")), spent]
    parts.append(tables["documents"].where("district_name_match = 0").agg(F.count("*").alias("excluded_mismatch_count")))
    return reduce(lambda a, b: a.join(b, F.lit(True)), parts)  # rows of one row each


def declining_candidates(tables: dict[str, DataFrame], terms: tuple[str, ...] = config.REPORT_TERMS, indicator: str = "chronic_absenteeism") -> DataFrame:
    which = declining(tables["indicators"], indicator)
    rows = which.join(tables["districts"].select("cds_code", "county", "district"), "cds_code")
    rows = rows.join(declining_spend(tables, which, terms), "cds_code", "left")
    money = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return rows.select(
        "cds_code",
        "county",
        "district",
        F.col("status").alias("rate"),
        F.col("change").alias("rate_change"),
        F.col("count").alias("enrolled_count"),
        F.col("chronic_count").cast("long").alias("chronic_count"),
        money("broad_funds").alias("broad_funds"),
        F.coalesce("broad_actions", F.lit(0)).alias("broad_actions"),
        money("strict_funds").alias("strict_funds"),
        F.coalesce("strict_actions", F.lit(0)).alias("strict_actions"),
        numeric.share_percent(money("strict_funds"), money("broad_funds")).alias("actionable_share_pct"),
        numeric.residual_band("status").alias("residual_need_band"),
    ).orderBy(F.col("broad_funds").desc(), F.col("chronic_count").desc(), "cds_code")


def declining_evidence(tables: dict[str, DataFrame], n: int, terms: tuple[str, ...] = config.REPORT_TERMS) -> DataFrame:
    """The n best funded matching actions of each account, on the plain join to its documents."""
    rows = tables["actions"].where(report_hits(terms, strict=False)).join(valid_documents(tables["documents"]).select("cds_code"), "cds_code")
    order = Window.partitionBy("cds_code").orderBy(F.coalesce("total_funds", F.lit(0.0)).desc(), "action_id", "title")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return rows.select("cds_code", "rank", "action_id", "title", "total_funds", one_line("description").alias("description"))


def grouped_outcomes(tables: dict[str, DataFrame], terms: tuple[str, ...]) -> DataFrame:
    """Outcomes joined to matching actions of valid documents, by account: funds and actions."""
    hits = tables["actions"].where(contains_any(joined_text("title", "description"), terms))
    rows = tables["indicators"].join(tables["districts"].select("cds_code", "county", "district"), "cds_code").join(hits, "cds_code")
    rows = rows.join(valid_documents(tables["documents"]).select("cds_code"), "cds_code")
    funds = F.sum(F.coalesce(F.col("total_funds"), F.lit(0)).cast("decimal(18,2)"))
    return rows.groupBy("county", "district", "indicator_name", "status").agg(F.round(funds, 0).cast("double").alias("funds"), F.count("*").alias("actions"))


# Themes


def _statuses(prefix: str = "") -> list[Column]:
    return [_copies(F.col("status") == s).alias(f"{prefix}{s}") for s in STATUSES]


def _copies(hit: Column) -> Column:
    return F.sum(F.when(hit, F.col("copies")).otherwise(0))


def _scorable() -> Column:
    return F.coalesce(_copies(F.col("status").isNotNull()), F.lit(0)).alias("scorable_metrics")


def distinct_texts(rows: DataFrame, texts: list[str], *sums: Column) -> DataFrame:
    """Rows of equal texts as one, with their number as ``copies``: what is read out of texts costs far
    more than to bring equal ones together. The result is dealt to all cores; filters don't pass that."""
    by = rows.groupBy(*texts).agg(F.count("*").alias("copies"), *sums)
    return by.repartition(rows.sparkSession.sparkContext.defaultParallelism).where(F.monotonically_increasing_id() >= 0)


def _share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), digits)


def themed(goals: DataFrame, actions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Goals, actions and metrics: district, theme, kind, copies, dollars, status.

    A row stands for all of a district's that have the same texts: ``copies`` is their number, and
    dollars are their exact sum. ``metrics`` carries its goal's description as goal_description,
    which counts for its theme.
    """
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("decimal(28,2)")
    goals = distinct_texts(goals, ["district_name", "description"])
    actions = distinct_texts(actions, ["district_name", "title", "description"], F.sum(F.coalesce(F.col("total_funds"), F.lit(0.0)).cast("decimal(18,2)")).alias("dollars"))
    metrics = distinct_texts(metrics, ["district_name", "metric_name", "goal_description", "baseline_raw", "year_1_outcome_raw", "year_3_target_raw"])
    score = numeric.trajectory("metric_name", "baseline_raw", "year_1_outcome_raw", "year_3_target_raw")
    parts = [
        goals.select("district_name", classify.primary_theme(F.coalesce("description", F.lit(""))).alias("theme_key"), F.lit("goal").alias("kind"), "copies", zero.alias("dollars"), none.alias("status")),
        actions.select("district_name", classify.primary_theme(joined_text("title", "description")).alias("theme_key"), F.lit("action").alias("kind"), "copies", "dollars", none.alias("status")),
        metrics.select("district_name", classify.primary_theme(joined_text("metric_name", "goal_description")).alias("theme_key"), F.lit("metric").alias("kind"), "copies", zero.alias("dollars"), score["status"].alias("status")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _kinds() -> list[Column]:
    return [_copies(F.col("kind") == k).alias(f"{k}_count") for k in ("goal", "action", "metric")]


def theme_summary(rows: DataFrame) -> DataFrame:
    """Per theme: districts, counts by kind, dollars and their share of all."""
    dollars = F.sum("dollars")
    by = rows.groupBy("theme_key").agg(F.countDistinct("district_name").alias("districts_with_theme"), *_kinds(), dollars.alias("_d"))
    whole = F.sum("_d").over(Window.partitionBy())  # themes are ten rows
    by = by.withColumn("dollar_share", F.round(F.when(whole > 0, F.col("_d").cast("double") / whole.cast("double")).otherwise(0.0), 6))
    out = by.select("theme_key", classify.theme_label("theme_key").alias("theme_label"), "districts_with_theme", "goal_count", "action_count", "metric_count", F.round("_d", 2).cast("double").alias("total_action_dollars"), "dollar_share")
    return out.orderBy(F.col("districts_with_theme").desc(), F.col("action_count").desc(), F.col("metric_count").desc(), "theme_key")


def theme_progress(rows: DataFrame) -> DataFrame:
    by = rows.groupBy("theme_key").agg(_scorable(), *_statuses())
    share = _share(F.col("at_or_above_target") + F.col("on_track"), F.col("scorable_metrics"))
    return by.select("theme_key", classify.theme_label("theme_key").alias("theme_label"), "scorable_metrics", *STATUSES, share.alias("positive_share")).orderBy(F.col("positive_share").desc(), F.col("scorable_metrics").desc(), "theme_key")


def overall_progress(rows: DataFrame) -> DataFrame:
    by = rows.agg(_scorable(), *_statuses())
    return by.withColumn("positive_share", _share(F.col("at_or_above_target") + F.col("on_track"), F.col("scorable_metrics")))


def district_progress(rows: DataFrame) -> DataFrame:
    """Per district: counts, shares, a label, and the theme with most dollars (first in order on ties)."""
    place = F.array(*[F.lit(t.key) for t in config.THEMES])
    spent = rows.where("kind = 'action'").groupBy("district_name", "theme_key").agg(F.sum("dollars").alias("_d"))
    first = F.when(F.array_position(place, F.col("theme_key")) == 0, 99).otherwise(F.array_position(place, F.col("theme_key")))
    best = spent.groupBy("district_name").agg(F.max(F.struct("_d", (-first).alias("p"), "theme_key")).alias("_b"), F.sum("_d").alias("_all"))
    by = rows.groupBy("district_name").agg(*_kinds(), _scorable(), *_statuses()).join(best, "district_name", "left")
    n = F.col("scorable_metrics")
    positive = F.when(n > 0, (F.col("at_or_above_target") + F.col("on_track")) / n).otherwise(0.0)
    away = F.when(n > 0, F.col("moving_away") / n).otherwise(0.0)
    return by.select(
        "district_name",
        "goal_count",
        "metric_count",
        "action_count",
        F.round(F.coalesce(F.col("_all").cast("double"), F.lit(0.0)), 2).alias("total_action_dollars"),
        "scorable_metrics",
        *STATUSES,
        F.round(positive, 4).alias("positive_share"),
        F.round(away, 4).alias("moving_away_share"),
        numeric.progress_label(positive, away, n).alias("progress_label"),
        classify.theme_label(F.coalesce("_b.theme_key", F.lit(config.OTHER_THEME[0]))).alias("top_theme_by_dollars"),
    ).orderBy(F.col("positive_share").desc(), "district_name")


def best_and_worst(progress: DataFrame, n: int = 8, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The n districts (or themes) of highest and lowest share with enough scorable metrics."""
    enough = progress.where(F.col("scorable_metrics") >= least)
    key = progress.columns[0]
    return enough.orderBy(F.col("positive_share").desc(), key).limit(n), enough.orderBy("positive_share", key).limit(n)


# Areas


def area_rows(goals: DataFrame, actions: DataFrame, metrics: DataFrame, examples: int = 3) -> DataFrame:
    """Goals, actions and metrics by matched area, with what the rollups sum.

    A row stands for all of a district's that have the same texts: ``copies`` is their number, and
    dollars are their exact sum. The best ``examples`` actions of every text follow
    as rows of their own without copies, with their own ``number`` and ``shown_dollars``.
    """
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("decimal(34,4)")
    empty, no = F.array().cast("array<string>"), F.lit(None).cast("double")
    g = distinct_texts(goals, ["district_name", "description"])
    g = g.select("district_name", F.lit("goal").alias("kind"), "copies", none.alias("number"), F.col("description").alias("name"), F.explode(classify.area_scores(F.coalesce("description", F.lit("")))).alias("area_key", "match_score"), F.lit(0).alias("title_score"), zero.alias("dollars"), no.alias("shown_dollars"), F.lit(0.0).alias("vendor_fit"), none.alias("profile"), empty.alias("movements"), none.alias("first_movement"), none.alias("pace_status"), no.alias("pace_ratio"))
    a = actions.withColumn("_d", F.coalesce(F.col("total_funds"), F.lit(0.0)))
    texts = ["district_name", "title", "description"]
    each = distinct_texts(a, texts, F.sum(F.col("_d").cast("decimal(24,4)")).cast("decimal(34,4)").alias("dollars")).select(*texts, "copies", "dollars", none.alias("number"), no.alias("shown_dollars"))
    if examples:
        # within a text scores and fit are equal, so its best by dollars are its best examples
        order = Window.partitionBy(*texts).orderBy(F.col("_d").desc(), "action_number")
        best = a.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= examples)
        each = each.unionByName(best.select(*texts, F.lit(0).cast("long").alias("copies"), zero.alias("dollars"), F.col("action_number").alias("number"), F.col("_d").alias("shown_dollars")))
    a = each.withColumns({"_t": classify.area_scores(F.coalesce("title", F.lit("")), "action"), "_p": classify.procurement("title", "description")})
    a = a.select("district_name", F.lit("action").alias("kind"), "copies", "number", F.col("title").alias("name"), "_t", "_p", "dollars", "shown_dollars", F.explode(classify.area_scores(joined_text("title", "description"), "action")).alias("area_key", "match_score"))
    a = a.select("district_name", "kind", "copies", "number", "name", "area_key", "match_score", F.coalesce(F.try_element_at("_t", F.col("area_key")), F.lit(0)).alias("title_score"), "dollars", "shown_dollars", F.col("_p.vendor_fit").alias("vendor_fit"), F.col("_p.profile").alias("profile"), empty.alias("movements"), none.alias("first_movement"), none.alias("pace_status"), no.alias("pace_ratio"))
    raw = ["metric_name", "baseline_raw", "year_1_outcome_raw", "year_3_target_raw", "current_difference_from_baseline_raw"]
    # of metrics with equal texts the first by number is the best example, one without number before all
    first = F.when(F.count("metric_number") == F.count("*"), F.min("metric_number")).alias("metric_number")
    m = distinct_texts(metrics, ["district_name", *raw], first)
    m = m.withColumns({"_m": numeric.movements("metric_name", "current_difference_from_baseline_raw"), "_p": numeric.pace("metric_name", "baseline_raw", "year_1_outcome_raw", "year_3_target_raw")})
    m = m.select("district_name", F.lit("metric").alias("kind"), "copies", F.col("metric_number").alias("number"), F.col("metric_name").alias("name"), F.explode(classify.area_scores(F.coalesce("metric_name", F.lit("")))).alias("area_key", "match_score"), F.lit(0).alias("title_score"), zero.alias("dollars"), no.alias("shown_dollars"), F.lit(0.0).alias("vendor_fit"), none.alias("profile"), F.col("_m.movement").alias("movements"), F.try_element_at("_m", F.lit(1))["raw"].alias("first_movement"), F.col("_p.status").alias("pace_status"), F.col("_p.ratio").alias("pace_ratio"))
    return reduce(DataFrame.unionByName, [g, a, m])


_PROFILES = tuple(p[0] for p in (*config.PROCUREMENT, config.OTHER_PROCUREMENT))
_MONEY = ("action_dollars", "externalizable_dollars")


def _district_sums(rows: DataFrame) -> DataFrame:
    """The one pass over the classified rows: per district and area all counts and exact dollars."""
    moved = lambda k: F.sum(F.size(F.filter("movements", lambda x: x == k)) * F.col("copies")).alias(f"movement_{k}")
    paced = lambda names, out: _copies(F.col("pace_status").isin(*names)).alias(out)
    return rows.groupBy("district_name", "area_key").agg(
        *_kinds(),
        F.sum("dollars").alias("action_dollars"),
        F.sum(F.col("dollars") * F.col("vendor_fit").cast("decimal(3,2)")).alias("externalizable_dollars"),
        *[moved(k) for k in MOVEMENTS],
        paced(STATUSES[:2], "pace_positive"),
        paced(STATUSES[2:], "pace_negative"),
        *[_copies(F.col("profile") == p).alias(f"_{p}") for p in _PROFILES],
    )


def _rounded_money(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in _MONEY})


def _with_shares(df: DataFrame) -> DataFrame:
    points, paced = sum(F.col(f"movement_{k}") for k in MOVEMENTS), F.col("pace_positive") + F.col("pace_negative")
    return df.withColumns(
        {
            "movement_points": points,
            "pace_metrics": paced,
            "_ms": F.when(points > 0, F.col("movement_worsening") / points).otherwise(0.0),
            "_ps": F.when(paced > 0, F.col("pace_negative") / paced).otherwise(0.0),
        }
    )


def district_areas(rows: DataFrame, examples: int = 3) -> DataFrame:
    """Per district and area: counts, dollars, movement, pace, and the best examples."""
    by = ["district_name", "area_key"]
    out = _with_shares(_rounded_money(_district_sums(rows))).drop(*[f"_{p}" for p in _PROFILES])
    actions = rows.where("shown_dollars is not null")
    order = Window.partitionBy(*by).orderBy(F.col("title_score").desc(), F.col("match_score").desc(), (F.col("shown_dollars") * F.col("vendor_fit")).desc(), "number", "name")
    best = actions.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= examples).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_r", "name", F.col("shown_dollars").alias("dollars")))).alias("_a"))
    worsening = F.size(F.filter("movements", lambda x: x == "worsening"))
    bad = F.coalesce(F.col("pace_status").isin(*config.NEGATIVE_STATUSES), F.lit(False))
    metrics = rows.where("kind = 'metric'").withColumns({"_w": worsening, "_b": bad})
    # metrics under pressure come first, and a metric without ratio before those with one
    order = Window.partitionBy(*by).orderBy(F.col("_b").desc(), F.col("_w").desc(), F.col("match_score").desc(), F.coalesce(F.col("pace_ratio"), F.lit(-999.0)).asc(), "number", "name")
    shown = metrics.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).select(*by, F.col("name").alias("metric_example_1"), F.coalesce("pace_status", F.lit("")).alias("metric_example_1_status"), F.coalesce("first_movement", F.lit("")).alias("metric_example_1_diff"))
    out = out.join(best, by, "left").join(shown, by, "left")
    named = lambda k: [F.coalesce(F.get("_a", F.lit(k))["name"], F.lit("")).alias(f"top_action_{k + 1}"), F.round(F.coalesce(F.get("_a", F.lit(k))["dollars"], F.lit(0.0)), 2).alias(f"top_action_{k + 1}_dollars")]
    kept = [c for c in out.columns if c not in ("_a", "_ms", "_ps", "metric_example_1", "metric_example_1_status", "metric_example_1_diff")]
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(*kept, classify.area_label("area_key").alias("area_label"), F.round("_ms", 4).alias("movement_negative_share"), F.round("_ps", 4).alias("pace_negative_share"), *named(0), *named(1), text("metric_example_1"), text("metric_example_1_status"), text("metric_example_1_diff"))


def area_rollup(rows: DataFrame, district_count: int | Column) -> DataFrame:
    """Per area: prevalence, dollars, pressure, the usual procurement profile and a composite score.

    score = .30 prevalence + .30 log10(external dollars + 1) / log10(highest + 1)
          + .25 the larger negative share + .15 the share of districts under pressure
    """
    per = _with_shares(_district_sums(rows))
    pressed = (F.round("_ms", 4) >= 0.25) | (F.round("_ps", 4) >= 0.25)
    summed = [c for c in per.columns if c not in ("district_name", "area_key", "_ms", "_ps", "movement_points", "pace_metrics")]
    out = per.groupBy("area_key").agg(F.count("*").alias("districts_with_area"), F.sum(F.when(pressed, 1).otherwise(0)).alias("districts_with_negative_pressure"), *[F.sum(c).alias(c) for c in summed])
    out = _with_shares(_rounded_money(out))
    # the most frequent profile; on ties the one that stands first in the order of classes
    usual = F.array_max(F.array(*[F.struct(F.col(f"_{p}").alias("n"), F.lit(-k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(_PROFILES)]))
    out = out.withColumn("top_procurement_profile", F.when(usual["n"] > 0, usual["p"]).otherwise(""))
    most = F.max("externalizable_dollars").over(Window.partitionBy())  # areas are a dozen rows
    count = F.lit(district_count) if isinstance(district_count, int) else district_count
    prevalence = F.when(count > 0, F.col("districts_with_area") / count).otherwise(0.0)
    spend = F.when(most > 0, F.log10(F.col("externalizable_dollars") + 1) / F.log10(most + 1)).otherwise(0.0)
    pressed_share = F.col("districts_with_negative_pressure") / F.col("districts_with_area")
    score = 0.30 * prevalence + 0.30 * spend + 0.25 * F.greatest("_ms", "_ps") + 0.15 * pressed_share
    return out.select(
        "area_key",
        classify.area_label("area_key").alias("area_label"),
        "districts_with_area",
        F.round(prevalence, 4).alias("district_prevalence_share"),
        "goal_count",
        "action_count",
        "metric_count",
        "action_dollars",
        "externalizable_dollars",
        "movement_points",
        "movement_worsening",
        F.round("_ms", 4).alias("movement_negative_share"),
        "pace_metrics",
        "pace_positive",
        "pace_negative",
        F.round("_ps", 4).alias("pace_negative_share"),
        "districts_with_negative_pressure",
        F.round(pressed_share, 4).alias("district_negative_pressure_share"),
        _share(F.col("externalizable_dollars"), F.col("action_dollars")).alias("externalizable_share_of_action_dollars"),
        "top_procurement_profile",
        classify.area_service("area_key").alias("service_hypothesis"),
        F.round(score, 4).alias("opportunity_score"),
    ).orderBy(F.col("opportunity_score").desc(), "area_key")


def area_examples(per: DataFrame, n: int = 5) -> DataFrame:
    """The n districts of each area with most external dollars, weighted by pressure."""
    weight = F.col("externalizable_dollars") * (1 + F.col("movement_negative_share") + F.col("pace_negative_share"))
    order = Window.partitionBy("area_key").orderBy(weight.desc(), F.col("action_dollars").desc(), "district_name")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


# Attendance titles


def explicit_actions(actions: DataFrame) -> DataFrame:
    """Actions with an explicit attendance title, the first of each district, number and title.

    ``actions`` carries an ordinal ``ord`` that says which of equal ones is first.
    """
    rows = actions.withColumn("title", compact("title")).where("title <> ''").where(classify.explicit_title("title"))
    order = Window.partitionBy("district_name", "action_number", "title").orderBy("ord")
    rows = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    rows = rows.withColumns({"dollars": F.coalesce(F.col("total_funds"), F.lit(0.0)), "explicit_workflow_title": classify.workflow_title("title"), "_d": compact("description")})
    return rows.select("ord", "district_name", "goal_number", "action_number", "title", F.left("_d", F.lit(280)).alias("description_snippet"), "dollars", "explicit_workflow_title", classify.tactics("title", "_d").alias("tactics"))


def attendance_districts(explicit: DataFrame, districts: DataFrame, broad: DataFrame) -> DataFrame:
    """Per district: explicit and workflow actions and dollars, the best funded title, broad figures.

    ``broad`` has the attendance area's row of each district (see district_areas); of several the
    last by action_dollars is taken.
    """
    cents = lambda c: F.coalesce(F.sum(c.cast("decimal(18,2)")).cast("double"), F.lit(0.0))
    work = F.col("explicit_workflow_title")
    by = explicit.groupBy("district_name").agg(
        F.count("*").alias("explicit_action_count"),
        cents(F.col("dollars")).alias("explicit_action_dollars"),
        F.sum(F.when(work, 1).otherwise(0)).alias("workflow_action_count"),
        cents(F.when(work, F.col("dollars"))).alias("workflow_action_dollars"),
        F.sum(F.when(F.col("dollars") == 0, 1).otherwise(0)).alias("zero_dollar_count"),
        F.max(F.when(F.col("dollars") > 0, F.struct("dollars", (-F.col("ord")).alias("o"), "title"))).alias("_top"),
    )
    one = broad.groupBy("district_name").agg(F.max(F.struct("action_dollars", "externalizable_dollars", "action_count", "metric_count", "movement_negative_share", "pace_negative_share", "metric_example_1", "metric_example_1_status")).alias("_b"))
    rows = districts.select("district_name").distinct().join(by, "district_name", "left").join(one, "district_name", "left")
    pressure = classify.negative_pressure(F.col("_b.metric_example_1_status"), F.col("_b.pace_negative_share"), F.col("_b.movement_negative_share"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    return rows.select(
        "district_name",
        *[zero(F.col(c), k).alias(c) for c, k in (("explicit_action_count", "long"), ("explicit_action_dollars", "double"), ("workflow_action_count", "long"), ("workflow_action_dollars", "double"), ("zero_dollar_count", "long"))],
        F.coalesce("_top.title", F.lit("")).alias("top_explicit_action"),
        zero(F.col("_top.dollars"), "double").alias("top_explicit_action_dollars"),
        zero(F.col("_b.action_dollars"), "double").alias("broad_action_dollars"),
        zero(F.col("_b.externalizable_dollars"), "double").alias("broad_externalizable_dollars"),
        zero(F.col("_b.action_count"), "long").alias("broad_action_count"),
        pressure.alias("negative_pressure"),
    ).orderBy(F.col("negative_pressure").desc(), F.col("explicit_action_dollars").desc(), F.col("broad_action_dollars").desc(), "district_name")


def tactic_rollup(explicit: DataFrame, examples: int = 3) -> DataFrame:
    """Per tactic: districts, actions, dollars and the first distinct titles."""
    rows = explicit.select("*", F.explode("tactics").alias("tactic"))
    firsts = rows.groupBy("tactic", "title").agg(F.min(F.struct("ord", "district_name")).alias("_f"))
    order = Window.partitionBy("tactic").orderBy("_f.ord")
    shown = firsts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= examples)
    shown = shown.groupBy("tactic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.concat_ws(": ", "_f.district_name", "title").alias("t")))), lambda x: x["t"]), " | ").alias("examples"))
    by = rows.groupBy("tactic").agg(F.countDistinct("district_name").alias("district_count"), F.count("*").alias("action_count"), F.sum(F.col("dollars").cast("decimal(18,2)")).cast("double").alias("matched_action_dollars"))
    return by.join(shown, "tactic").orderBy("tactic")


def pressured(attendance: DataFrame, funded: bool = False) -> DataFrame:
    """Districts under pressure that have explicit actions, on request with dollars only."""
    rows = attendance.where((F.col("explicit_action_count") > 0) & F.col("negative_pressure"))
    return rows.where(F.col("explicit_action_dollars") > 0) if funded else rows


def unfunded(explicit: DataFrame) -> DataFrame:
    """Explicit actions without dollars."""
    return explicit.where(F.col("dollars") == 0)


def inflation(attendance: DataFrame, n: int) -> DataFrame:
    """The districts where broad dollars exceed explicit ones the most."""
    return attendance.withColumn("gap", F.col("broad_action_dollars") - F.col("explicit_action_dollars")).orderBy(F.col("gap").desc(), "district_name").limit(n)
