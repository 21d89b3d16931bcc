"""Hand-computed cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from tallyglass.config import topic
from tallyglass.functions import classify as C
from tallyglass.functions import numeric as N
from tallyglass.functions import text as X
from tallyglass.plans.opportunities import trend_filter

L = F.lit

CASES = [
    (lambda: N.currency(L("$1,234.50")), 1234.5),
    (lambda: N.currency(L("($500)")), 500.0),
    (lambda: N.currency(L("-$20")), 20.0),
    (lambda: N.currency(L("N/A")), None),
    (lambda: N.contributing(L("Yes")), True),
    (lambda: N.contributing(L("Unknown")), False),
    (lambda: N.contributing(L("")), None),
    (lambda: N.first_number(L("(2.0%)")), -2.0),
    (lambda: N.first_number(L("$1,200")), 1200.0),
    (lambda: N.first_number(L("none")), None),
    (lambda: N.first_number(L(None).cast("string")), None),
    (lambda: N.numbers(L("a1 12, (3.5%) $4,000 5d")), [12.0, -3.5, 4000.0]),
    (lambda: N.pace(L("Chronic absenteeism rate"), L("All: 20%"), L("All: 18%"), L("All: 14%"))["status"], "on_track"),
    (lambda: N.pace(L("Rate"), L("All: 5"), L("All: 5"), L("All: 5"))["ratio"], 1.0),
    (lambda: N.trajectory(L("Rate"), L("All: 5"), L("All: 5"), L("All: 5")), None),
    (lambda: N.trajectory(L("Graduation"), L("All Students: 80%"), L("ALL: 82%"), L("Increase by 4"))["ratio"], 0.5),
    (lambda: N.trajectory(L("Graduation"), L("80%"), L("70%"), L("90%"))["status"], "moving_away"),
    (lambda: N.movements(L("Chronic absenteeism rate"), L("All: -2.0%"))[0]["movement"], "improving"),
    (lambda: N.movements(L("x"), L("No difference"))[0]["value"], 0.0),
    (lambda: N.relative_target(L("Baseline - 2"), L(False)), -2.0),
    (lambda: N.relative_target(L("Maintain"), L(False)), 0.0),
    (lambda: N.page_range(L("[12, 14]"))["last"], 14),
    (lambda: N.page_range(L("p. 3-5"))["first"], 3),
    (lambda: N.page_range(L(""))["first"], 0),
    (lambda: N.residual_band(L(25.0)), "very high residual need"),
    (lambda: N.residual_band(L(14.9)), "lower residual need"),
    (lambda: N.residual_band(L(None).cast("double")), "lower residual need"),
    (lambda: N.opportunity_score(L(999.0), L(5000.0), L(99), L(20.0), L(-1.5)), 12.5),
    (lambda: N.outcome_read(L(None).cast("double"), True), "flat"),
    (lambda: N.vector_literal(F.array(L(1.0), L(float("nan")))), None),
    (lambda: N.vector_literal(F.array(L(1.0), L(2.5))), "[1.00000000,2.50000000]"),
    (lambda: N.progress_label(L(0.8), L(0.05), L(10)), "Strong early trajectory"),
    (lambda: N.progress_label(L(0.8), L(0.05), L(9)), "Limited evidence"),
    (lambda: X.names_match(L("Alameda Unified"), L("Alameda Unified School District")), 1),
    (lambda: X.names_match(L("Mt. Diablo Unified"), L("Mount Diablo")), 1),
    (lambda: X.names_match(L("Santa Clara Unified"), L("Santa Ana Unified")), 0),
    (lambda: X.names_match(L("X"), L("LCAP 2025 - 1")), None),
    (lambda: X.names_match(L("County Office of Education"), L("Alameda")), None),
    (lambda: X.code_of(L(None).cast("string"), L("a 12345678901234 b")), "12345678901234"),
    (lambda: X.code_of(L("123456789012345")), ""),
    (lambda: X.clean(L(None).cast("string")), ""),
    (lambda: X.clean(L(" No Data "), no_data=True), ""),
    (lambda: X.normal_space(L(" a–b \n c ")), "a-b c"),
    (lambda: X.normal_lines(L("a\r\n\n\n\nb­ •")), "a\n\nb *"),
    (lambda: X.token_estimate(L("1234567")), 1),
    (lambda: X.token_estimate(L("")), 1),
    (lambda: X.token_estimate(L("12345678")), 2),
    (lambda: F.length(X.snippet(L("x" * 400))), 360),
    (lambda: X.label_and_value(L("Goal: 12%"))["label"], "Goal"),
    (lambda: X.label_and_value(L("plain"))["label"], None),
    (lambda: X.valid_email(L(" A@b.co ")), True),
    (lambda: X.valid_email(L("a@b")), False),
    (lambda: X.markdown_cell(L("a|b\nc")), "a/b c"),
    (lambda: X.dollars(L(1234567.4)), "$1,234,567"),
    (lambda: X.html_lines(L("<p>a &amp; b</p><script>x</script><br>c")), ["a & b", "c"]),
    (lambda: X.field(X.html_fields(L("<tr><th>CDS Code:</th><td>1</td></tr><tr><th>CDS Code</th><td>2</td></tr>")), "cds"), "1"),
    (lambda: X.short_hash(L("abc"), 8), "a9993e36"),
    (lambda: C.actionability(L("Attendance Dashboard"), L(""), L(1.0))["actionability"], "software_or_data_system"),
    (lambda: C.actionability(L("Base: teacher salaries"), L(""), L(1.0))["actionability"], "bundled_or_staffing"),
    (lambda: C.actionability(L("Misc"), L(""), L(6e6))["actionability"], "large_unclear_bundle"),
    (lambda: C.actionability(L("Misc"), L(None).cast("string"), L(None).cast("double"))["actionability"], "unclear"),
    (lambda: C.procurement(L("Approach to learning"), L(""))["profile"], "technology_platform"),
    (lambda: C.primary_theme(L("relationship")), "academic_instruction"),
    (lambda: C.primary_theme(L("zzz")), "other"),
    (lambda: C.primary_area(L("zzz")), None),
    (lambda: C.tactics(L("SARB home visit team"), L("")), ["Home Visits", "SART / SARB"]),
    (lambda: C.explicit_title(L("Support (attendance)")), False),
    (lambda: C.indicator_name(L("9")), "indicator_9"),
    (lambda: C.indicator_name(L("")), ""),
    (lambda: C.indicator_name(L("elpi_2024")), "english_learner_progress"),
]


def test_cases(spark):
    got = spark.range(1).select(*[f().alias(f"c{k}") for k, (f, _) in enumerate(CASES)]).first()
    for k, (_, want) in enumerate(CASES):
        value = got[k]
        assert value == (pytest.approx(want) if isinstance(want, float) else want), (k, value, want)


def test_measurement(spark):
    m = spark.range(1).select(N.measurement(L("Fall results\nALL: 20% and 30\nEL - 5")).alias("m")).first().m
    assert m.context_lines == ["Fall results"]
    assert [(e.label, e.numeric_values) for e in m.entries] == [("ALL", [20.0, 30.0]), ("EL", [5.0])]


def test_options():
    assert topic(" Chronic-Absenteeism ").lower_is_better
    with pytest.raises(ValueError):
        topic("weather")
    with pytest.raises(ValueError):
        trend_filter(L(1), "sideways", True)
    assert trend_filter(L(1), "all", True) is None
    assert X.text_query("Show the chronic absenteeism re-engagement") == '"chronic" OR "absenteeism" OR "re-engagement"'
    assert X.text_query("the of") == ""
