"""Keyword classifiers as expressions: actionability, themes, areas, procurement, titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass import config
from tallyglass.functions.text import _col, compact, contains_any, let, normal_lines, normal_space, strip


def actionability(title: Column | str, description: Column | str, funds: Column | str) -> Column:
    """struct(actionability, confidence, sales_read); the description is the snippet that is shown."""

    def labelled(text: Column) -> Column:
        label = reduce(lambda out, kv: F.when(contains_any(text, kv[1]), kv[0]) if out is None else out.when(contains_any(text, kv[1]), kv[0]), config.SELLABLE, None)
        return label.when(contains_any(text, config.BUNDLED), "bundled_or_staffing").when(F.coalesce(_col(funds), F.lit(0.0)) >= config.LARGE_BUNDLE, "large_unclear_bundle").otherwise("unclear")

    def read(label: Column) -> Column:
        def of(k: int) -> Column:
            reads = config.ACTIONABILITY_READS
            named = ("bundled_or_staffing", "large_unclear_bundle", "unclear")
            return reduce(lambda out, n: F.when(label == n, reads[n][k]).otherwise(out), named, F.lit(reads["sellable"][k]))

        return F.struct(label.alias("actionability"), of(0).alias("actionability_confidence"), of(1).alias("sales_read"))

    return let(let(F.lower(F.concat(normal_space(title), F.lit(" "), normal_space(description))), labelled), read)


def keyword_score(text: Column, keywords: tuple[str, ...]) -> Column:
    """Two for each keyword of several words that the lower-cased text holds, one for each other."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(k)), 2 if " " in k else 1).otherwise(0) for k in keywords])


def _scored(text: Column | str, lists: list[tuple[str, tuple[str, ...]]]) -> Column:
    """map key -> score of the lists with a hit, in the order given."""
    rows = lambda low: F.array(*[F.struct(F.lit(k).alias("key"), keyword_score(low, words).alias("score")) for k, words in lists])
    found = let(F.lower(normal_lines(text, bullets=False, zero_width=False)), rows)
    return F.map_from_entries(F.filter(found, lambda e: e["score"] > 0))


def theme_scores(text: Column | str) -> Column:
    return _scored(text, [(t.key, t.keywords) for t in config.THEMES])


def area_scores(text: Column | str, kind: str = "metric") -> Column:
    """Scores by the keywords for goals and metrics, or for actions."""
    return _scored(text, [(a.key, a.action_keywords if kind == "action" else a.metric_keywords) for a in config.AREAS])


def _best(scores: Column, order: tuple[str, ...], otherwise: Column) -> Column:
    """The key of highest score; on ties the one that stands first in the order."""
    place = F.array(*[F.lit(k) for k in order])
    ranked = F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("s"), (-F.array_position(place, e["key"])).alias("p"), e["key"].alias("k")))
    return F.coalesce(F.array_max(ranked)["k"], otherwise)


def primary_theme(text: Column | str) -> Column:
    return _best(theme_scores(text), tuple(t.key for t in config.THEMES), F.lit(config.OTHER_THEME[0]))


def themes(text: Column | str) -> Column:
    return let(F.map_keys(theme_scores(text)), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.lit(config.OTHER_THEME[0]))))


def theme_label(key: Column | str) -> Column:
    return reduce(lambda out, t: F.when(_col(key) == t.key, t.label).otherwise(out), reversed(config.THEMES), F.lit(config.OTHER_THEME[1]))


def primary_area(text: Column | str) -> Column:
    return _best(area_scores(text), tuple(a.key for a in config.AREAS), F.lit(None).cast("string"))


def area_label(key: Column | str) -> Column:
    return reduce(lambda out, a: F.when(_col(key) == a.key, a.label).otherwise(out), reversed(config.AREAS), F.lit(None).cast("string"))


def area_service(key: Column | str) -> Column:
    return reduce(lambda out, a: F.when(_col(key) == a.key, a.service).otherwise(out), reversed(config.AREAS), F.lit(None).cast("string"))


def procurement(title: Column | str, description: Column | str) -> Column:
    """struct(profile, vendor_fit): the first class with a hit."""
    text = F.lower(normal_lines(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(description), F.lit(""))), bullets=False, zero_width=False))
    made = lambda name, fit: F.struct(F.lit(name).alias("profile"), F.lit(fit).alias("vendor_fit"))
    return let(text, lambda t: reduce(lambda out, c: F.when(contains_any(t, c[2]), made(c[0], c[1])).otherwise(out), reversed(config.PROCUREMENT), made(*config.OTHER_PROCUREMENT)))


def clean_title(title: Column | str) -> Column:
    """The title before its first bracket, lower case."""
    return F.lower(strip(F.split_part(compact(title), F.lit("("), F.lit(1))))


def explicit_title(title: Column | str) -> Column:
    return let(clean_title(title), lambda t: contains_any(t, config.EXPLICIT_TITLE))


def workflow_title(title: Column | str) -> Column:
    return let(clean_title(title), lambda t: contains_any(t, config.EXPLICIT_TITLE) & contains_any(t, config.WORKFLOW_TITLE))


def tactics(title: Column | str, description: Column | str) -> Column:
    """array<string> of the tactics that a title and description name."""
    text = F.lower(F.concat(compact(title), F.lit(" "), compact(description)))
    return F.array_compact(let(text, lambda t: F.array(*[F.when(contains_any(t, words), F.lit(k)) for k, words in config.TACTICS.items()])))


def negative_pressure(status: Column, pace_share: Column, movement_share: Column) -> Column:
    return F.coalesce(status.isin(*config.NEGATIVE_STATUSES), F.lit(False)) | (F.coalesce(pace_share, F.lit(0.0)) > 0) | (F.coalesce(movement_share, F.lit(0.0)) >= 0.5)


def indicator_name(key: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in config.INDICATORS.items() for x in kv])
    k = strip(F.coalesce(_col(key).cast("string"), F.lit("")))
    return F.coalesce(F.try_element_at(known, k), F.when(k == "", F.lit("")).otherwise(F.concat(F.lit("indicator_"), k)))
