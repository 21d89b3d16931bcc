"""Column functions that read numbers, targets and progress out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.config import AREA_LOWER_IS_BETTER, REPORT_LOWER_IS_BETTER, REPORT_LOWER_PHRASES
from tallyglass.functions.text import _col, contains_any, label_and_value, let, normal_lines, normal_space, strip

NUMBER = r"\(?[-+]?\$?\d[\d,]*\.?\d*%?\)?"
NUMBER_TOKEN = r"(?<![\w])(?:\(?[-+]?\$?\d[\d,]*\.?\d*%?\)?)(?![\w])"

#: The usual measurement cell: a label of plain words, and one plain number. Nothing in it is to be made normal.
_USUAL_CELL = r"\A[A-Za-z]+(?: [A-Za-z]+)*: \d+(?:\.\d+)?%?\z"

# Names of student groups as they are compared.
LABEL_ALIASES = {
    "all students": "all",
    "district wide": "district",
    "districtwide": "district",
    "district overall": "district",
    "overall districtwide rate": "district",
    "overall district": "district",
    "english learners": "el",
    "english learner": "el",
    "els": "el",
    "long-term english learners": "ltel",
    "ltels": "ltel",
    "reclassified fluent english proficient": "rfep",
    "students with disabilities": "swd",
    "sped": "swd",
    "special education": "swd",
    "socioeconomically disadvantaged": "sed",
    "low income": "sed",
    "li": "sed",
    "sed/li": "sed",
    "nslp/low income": "sed",
    "foster youth": "fy",
    "foster": "fy",
    "students experiencing homelessness": "homeless",
    "homeless youth": "homeless",
    "m-v": "homeless",
    "mv": "homeless",
    "hispanic/latino": "hispanic_latino",
    "hispanic": "hispanic_latino",
    "latino": "hispanic_latino",
    "african american": "african_american",
    "aa": "african_american",
    "as": "asian",
}


def _number(token: Column) -> Column:
    """A numeric token as double: dollar, percent and commas go, brackets make it negative."""
    def read(plain: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(plain, r"^[()]+|[()]+$", ""), "%+$", "")
        value = let(bare, lambda x: F.when(x.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), x.try_cast("double")))
        return F.when(plain.startswith("(") & plain.endswith(")"), -value).otherwise(value)

    return let(F.trim(F.regexp_replace(token, "[$,]", "")), read)


def currency(c: Column | str) -> Column:
    """The first amount of a text. Its sign isn't read: the result is never negative."""
    digits = F.regexp_extract(_col(c), r"-?\$?\s*(\d[\d,]*(?:\.\d+)?)", 1)
    return F.nullif(F.replace(digits, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def contributing(c: Column | str) -> Column:
    """True for a text with "yes", else false for one with "no" (also in "unknown"), else null."""
    return let(F.lower(_col(c)), lambda low: F.when(low.contains("yes"), True).when(low.contains("no"), False))


def first_number(c: Column | str) -> Column:
    return _number(F.nullif(F.regexp_extract(F.coalesce(_col(c), F.lit("")), NUMBER, 0), F.lit("")))


def numbers(c: Column | str) -> Column:
    """array<double> of all numeric tokens that stand by themselves."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(NUMBER_TOKEN), F.lit(0)), _number)
    return F.filter(found, lambda x: x.isNotNull())


def _lines(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), "\n"), lambda x: strip(F.regexp_replace(normal_lines(x, bullets=False, zero_width=False), "[ \t]+", " "))), lambda x: x != "")


def measurement(c: Column | str) -> Column:
    """struct(raw, context_lines, entries(label, value, numeric_values)) of a measurement cell.

    A first line of several without label, percent sign or group code is context.
    """
    none = F.array().cast("array<string>")
    code = r"\b(ALL|EL|SED|SWD|FY|AA|AS|HI|HOM|LTEL|FOS)\b"

    def is_context(parted: Column) -> Column:
        return parted["label"].isNull() & ~parted["value"].contains("%") & ~parted["value"].rlike(code)

    def entry(line: Column) -> Column:
        return let(label_and_value(line), lambda e: F.struct(e["label"].alias("label"), e["value"].alias("value"), numbers(e["value"]).alias("numeric_values")))

    def cell(raw: Column) -> Column:
        def made(lines: Column) -> Column:
            context = F.when(F.size(lines) > 1, F.filter(F.slice(lines, 1, 1), lambda x: let(label_and_value(x), is_context))).otherwise(none)
            rest = lambda top: F.slice(lines, F.size(top) + 1, F.greatest(F.size(lines) - F.size(top), F.lit(0)))
            return let(context, lambda top: F.struct(raw.alias("raw"), F.transform(top, lambda x: label_and_value(x)["value"]).alias("context_lines"), F.transform(rest(top), entry).alias("entries")))

        return let(_lines(raw), made)

    def usual(raw: Column) -> Column:
        value = F.substring_index(raw, ": ", -1)
        entry = F.struct(F.substring_index(raw, ": ", 1).alias("label"), value.alias("value"), F.array(F.rtrim(value, F.lit("%")).try_cast("double")).alias("numeric_values"))
        return F.struct(raw.alias("raw"), none.alias("context_lines"), F.array(entry).alias("entries"))

    return let(F.coalesce(_col(c).cast("string"), F.lit("")), lambda t: F.when(t.rlike(_USUAL_CELL), usual(t)).otherwise(let(normal_lines(t, zero_width=False), cell)))


def label_alias(c: Column | str) -> Column:
    """A student group's name as it is compared; names without alias stay, in lower case."""
    known = F.create_map(*[F.lit(x) for kv in LABEL_ALIASES.items() for x in kv])
    name = F.regexp_replace(F.lower(normal_lines(c, bullets=False, zero_width=False)), r"^[. ]+|[. ]+$", "")
    return let(name, lambda n: F.coalesce(F.try_element_at(known, n), n))


def _pair(longest: int) -> str:
    return r"^([A-Za-z][A-Za-z0-9/&() .,%+'-]{0," + str(longest) + r"}?)[\s]*[:-][\s]*(.+)$"


def measured(c: Column | str, aliases: bool = True, longest_label: int = 90, longest_line: int = 60, units: str = "%|point|dfs|level|students|rate|score") -> Column:
    """struct(labelled map<string,double>, unlabelled array<double>) of a measurement text.

    Lines ``label: value`` with a number go to the map (the last of equal labels wins); others
    that name a unit and are short give an unlabelled value. Header lines are skipped when
    labels are compared by alias.
    """
    pair = _pair(longest_label)

    def read(line: Column) -> Column:
        label, text = F.regexp_extract(line, pair, 1), F.regexp_extract(line, pair, 2)
        value = F.when(text.rlike(r"\d"), first_number(text))
        named = label_alias(label) if aliases else F.lower(strip(label))
        loose = F.lower(line).rlike(units) & (F.length(line) < longest_line)
        return let(value, lambda v: F.struct(F.when(v.isNotNull(), named).alias("label"), F.when(v.isNotNull(), v).when(loose, first_number(line)).alias("value")))

    def made(found: Column) -> Column:
        named = F.filter(found, lambda e: e["label"].isNotNull())
        last = let(named, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda o: o["label"] == e["label"])))
        return F.struct(F.map_from_entries(last).alias("labelled"), F.transform(F.filter(found, lambda e: e["label"].isNull()), lambda e: e["value"]).alias("unlabelled"))

    lines = _lines(c)
    if aliases:
        lines = F.filter(lines, lambda x: ~(x.endswith("Outcome") | x.endswith("from Baseline")))
    return let(F.filter(F.transform(lines, read), lambda e: e["value"].isNotNull()), made)


def measured_for_area(c: Column | str) -> Column:
    return measured(c, aliases=False, longest_label=100, longest_line=50, units="%|dfs|level|students|rate|score")


def lower_is_better(name: Column | str, text: Column | str, report: bool) -> Column:
    """Whether a metric is better when lower, by its name and target text.

    The theme report also takes phrases as "less than" for a sign; the area report doesn't.
    """
    both = normal_lines(F.concat(F.coalesce(_col(name), F.lit("")), F.lit(" "), F.coalesce(_col(text), F.lit(""))), bullets=False, zero_width=False)
    return let(both, lambda t: contains_any(t, (*REPORT_LOWER_IS_BETTER, *REPORT_LOWER_PHRASES) if report else AREA_LOWER_IS_BETTER))


def relative_target(c: Column | str, lower: Column) -> Column:
    """The change against the baseline that a target text asks for, or null.

    "baseline +n", then "maintain" (no change unless it says by how much to improve), then
    improve or increase by n, then decrease or reduce by n.
    """
    base = r"(?i)baseline\s*([+-])\s*(\d+(?:\.\d+)?)"

    def read(text: Column) -> Column:
        amount = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).try_cast("double")
        more = amount(r"(?i)(?:improve|increase)\s+by\s+(\d+(?:\.\d+)?)", 1)
        less = amount(r"(?i)(?:decrease|reduce)\s+by\s+(\d+(?:\.\d+)?)", 1)
        kept = amount(r"(?i)maintain(?:\s+or\s+(?:improve|increase))?\s+by\s+(\d+(?:\.\d+)?)", 1)
        maintain = text.contains("maintain") & (text.contains("+/- 0") | ~(text.contains("improve by") | text.contains("increase by")))
        return (
            F.when(text.rlike(base), amount(base, 2) * F.when(F.regexp_extract(text, base, 1) == "+", 1).otherwise(-1))
            .when(maintain, 0.0)
            .when(more.isNotNull(), F.when(lower, -more).otherwise(more))
            .when(less.isNotNull(), F.when(lower, less).otherwise(-less))
            .when(kept.isNotNull(), F.when(lower, -kept).otherwise(kept))
        )

    return let(F.lower(normal_lines(c, bullets=False, zero_width=False)), read)


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-9


def _progress(base: Column, now: Column, goal: Column, lower: Column, equal_counts: bool) -> Column:
    """Share of the way from baseline to target that is done; null where it can't be told."""
    way = F.when(lower, base - goal).otherwise(goal - base)
    done = F.when(lower, base - now).otherwise(now - base)
    same = F.when(_close(now, goal), F.lit(1.0)) if equal_counts else F.lit(None).cast("double")
    return F.when(_close(base, goal), same).when(way > 0, done / way)


def _mean(ratios: Column) -> Column:
    return let(ratios, lambda r: F.when(F.size(r) > 0, F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / F.size(r)))


def _status(ratio: Column) -> Column:
    return F.when(ratio >= 1, "at_or_above_target").when(ratio >= 1 / 3, "on_track").when(ratio >= 0, "off_track").when(ratio < 0, "moving_away")


def _ratios(base: Column, now: Column, goal: Column, lower: Column, equal_counts: bool) -> Column:
    labels = F.array_intersect(F.array_intersect(F.map_keys(base), F.map_keys(now)), F.map_keys(goal))
    return F.filter(
        F.transform(F.array_sort(labels), lambda k: _progress(F.element_at(base, k), F.element_at(now, k), F.element_at(goal, k), lower, equal_counts)),
        lambda x: x.isNotNull(),
    )


def trajectory(name: Column | str, baseline: Column | str, year_1: Column | str, target: Column | str) -> Column:
    """struct(status, direction, ratio, evidence_points) of a metric for the theme report; null if unscorable.

    Targets relative to the baseline count; a target equal to the baseline doesn't.
    """

    def scored(m: Column) -> Column:
        b, y, t, lower, delta = m["b"], m["y"], m["t"], m["lower"], m["delta"]
        given = (F.size(F.map_keys(t["labelled"])) > 0) | (F.size(t["unlabelled"]) > 0)
        goal = F.when(~given & delta.isNotNull(), F.transform_values(b["labelled"], lambda _, v: v + delta)).otherwise(t["labelled"])
        ratios = let(goal, lambda g: _ratios(b["labelled"], y["labelled"], g, lower, equal_counts=False))
        b0, y0, t0 = (F.try_element_at(x["unlabelled"], F.lit(1)) for x in (b, y, t))
        one = F.filter(F.array(_progress(b0, y0, F.coalesce(t0, b0 + delta), lower, equal_counts=False)), lambda x: x.isNotNull())
        found = let(ratios, lambda r: F.when(F.size(r) > 0, r).otherwise(one))
        out = lambda f: let(_mean(f), lambda r: F.when(r.isNotNull(), F.struct(_status(r).alias("status"), F.when(lower, "lower").otherwise("higher").alias("direction"), r.alias("ratio"), F.size(f).alias("evidence_points"))))
        return let(found, out)

    first = F.struct(measured(baseline).alias("b"), measured(year_1).alias("y"), measured(target).alias("t"), lower_is_better(name, target, report=True).alias("lower"))
    more = lambda m: F.struct(m["b"].alias("b"), m["y"].alias("y"), m["t"].alias("t"), m["lower"].alias("lower"), relative_target(target, m["lower"]).alias("delta"))
    return let(let(first, more), scored)


def pace(name: Column | str, baseline: Column | str, year_1: Column | str, target: Column | str) -> Column:
    """struct(status, ratio) of a metric for the area report; null if it can't be told.

    Where baseline and target are equal, a year on target counts as fully done.
    """

    def scored(m: Column) -> Column:
        parts = [m[k] for k in ("b", "y", "t")]
        ratios = _ratios(*[x["labelled"] for x in parts], m["lower"], equal_counts=True)
        one = F.filter(F.array(_progress(*[F.try_element_at(x["unlabelled"], F.lit(1)) for x in parts], m["lower"], equal_counts=True)), lambda x: x.isNotNull())
        ratio = _mean(let(ratios, lambda r: F.when(F.size(r) > 0, r).otherwise(one)))
        return let(ratio, lambda r: F.when(r.isNotNull(), F.struct(_status(r).alias("status"), r.alias("ratio"))))

    first = F.struct(measured_for_area(baseline).alias("b"), measured_for_area(year_1).alias("y"), measured_for_area(target).alias("t"), lower_is_better(name, target, report=False).alias("lower"))
    return let(first, scored)


def movements(name: Column | str, difference: Column | str) -> Column:
    """array<struct(label, value, movement, raw)>: what each line of a difference text says."""
    pair = _pair(100)

    def read(line: Column, lower: Column) -> Column:
        low = F.lower(line)
        labelled = line.rlike(pair) & F.regexp_extract(line, pair, 2).rlike(r"\d")
        number = first_number(F.when(labelled, F.regexp_extract(line, pair, 2)).otherwise(line))

        def judged(value: Column) -> Column:
            none = value.isNull() & low.contains("no difference")
            movement = (
                F.when(none, "flat")
                .when(value.isNull(), F.lit(None).cast("string"))
                .when(low.contains("improvement") | low.contains("improved"), "improving")
                .when(low.contains("maintain") | low.contains("no difference") | (value == 0), "flat")
                .when(lower == (value < 0), "improving")
                .otherwise("worsening")
            )
            return F.struct(F.when(labelled, strip(F.regexp_extract(line, pair, 1))).alias("label"), F.when(none, 0.0).otherwise(value).alias("value"), movement.alias("movement"), line.alias("raw"))

        return let(number, judged)

    lower = lower_is_better(name, difference, report=False)
    return F.filter(let(lower, lambda low: F.transform(_lines(difference), lambda x: read(x, low))), lambda e: e["movement"].isNotNull())


def progress_label(positive: Column, moving_away: Column, scorable: Column) -> Column:
    return (
        F.when(scorable < 10, "Limited evidence")
        .when((positive >= 0.75) & (moving_away <= 0.10), "Strong early trajectory")
        .when(positive >= 0.60, "Mostly on track")
        .when(positive >= 0.45, "Mixed trajectory")
        .otherwise("Needs acceleration")
    )


def opportunity_score(strict: Column, broad: Column, affected: Column, rate: Column, change: Column) -> Column:
    """2 log10(spend + 1) + 1.5 log10(affected + 1) + rate / 10 + |change|; spend is strict, or 15 % of broad."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    spend = F.when(zero(strict) > 0, zero(strict)).otherwise(zero(broad) * 0.15)
    return F.log10(spend + 1) * 2.0 + F.log10(zero(affected) + 1) * 1.5 + zero(rate) / 10.0 + F.abs(zero(change))


def share_percent(part: Column, whole: Column) -> Column:
    return F.when(F.coalesce(whole, F.lit(0.0)) > 0, 100.0 * F.coalesce(part, F.lit(0.0)) / whole).otherwise(0.0)


def residual_band(rate: Column | str) -> Column:
    r = _col(rate)
    return F.when(r >= 25, "very high residual need").when(r >= 20, "high residual need").when(r >= 15, "moderate residual need").otherwise("lower residual need")


def outcome_read(change: Column | str, lower: bool) -> Column:
    c = F.coalesce(_col(change), F.lit(0.0))
    return F.when(c == 0, "flat").when((c < 0) if lower else (c > 0), "improving").otherwise("worsening")


def as_flag(c: Column | str) -> Column:
    """Nullable 0 or 1 of a boolean."""
    return _col(c).cast("boolean").cast("int")


def page_range(c: Column | str) -> Column:
    """struct(first, last) of source pages: a JSON array, else the digits in the text, else (0, 0)."""
    raw = F.coalesce(_col(c), F.lit(""))
    parsed = F.from_json(raw, "array<int>")
    digits = F.transform(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    pages = F.filter(F.when(F.size(parsed) > 0, parsed).otherwise(digits), lambda x: x.isNotNull())
    return F.when(F.size(pages) > 0, F.struct(F.array_min(pages).alias("first"), F.array_max(pages).alias("last"))).otherwise(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last")))


def vector_literal(c: Column | str) -> Column:
    """A vector as text with 8 decimals; null if a value isn't finite."""
    v = _col(c)
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return F.when(~bad, F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]")))


def simple_lines(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), "\n"), normal_space), lambda x: x != "")
