"""Rollups read texts once for each distinct one; counts, dollars and examples stay those of all rows."""

from tallyglass.plans import reports


def _made(spark):
    goals = spark.createDataFrame([("d", "1", "Math science")] * 3 + [("d", "2", None)], "district_name string, goal_number string, description string")
    actions = spark.createDataFrame([("d", str(k), "Home visit outreach", None, float(k)) for k in (2, 9, 5, 9)] + [("d", "7", "Home visit outreach", None, None)], "district_name string, action_number string, title string, description string, total_funds double")
    texts = ("Chronic absenteeism rate", "", "All: 9%", "All: 8%", "All: 6%", "All: -1%")
    metrics = spark.createDataFrame([("d", n, *texts) for n in ("3", "1", "2")], "district_name string, metric_number string, metric_name string, goal_description string, baseline_raw string, year_1_outcome_raw string, year_3_target_raw string, current_difference_from_baseline_raw string")
    return goals, actions, metrics


def test_equal_texts_are_read_once(spark):
    rows = reports.themed(*_made(spark))
    got = sorted((r.kind, r.copies, float(r.dollars), r.status or "") for r in rows.collect())
    assert got == [("action", 5, 25.0, ""), ("goal", 1, 0.0, ""), ("goal", 3, 0.0, ""), ("metric", 3, 0.0, "on_track")]
    one = reports.overall_progress(rows).first()
    assert (one.scorable_metrics, one.on_track) == (3, 3)
    assert reports.overall_progress(rows.where("false")).first().scorable_metrics == 0


def test_area_examples_are_those_of_all_rows(spark):
    rows = reports.area_rows(*_made(spark))
    per = {r.area_key: r for r in reports.district_areas(rows).collect()}
    r = per["chronic_absenteeism"]
    assert (r.action_count, r.metric_count, r.action_dollars, r.externalizable_dollars) == (5, 3, 25.0, 15.0)
    assert (r.top_action_1_dollars, r.top_action_2_dollars, r.movement_improving) == (9.0, 9.0, 3)
    assert rows.where("kind = 'metric'").first().number == "1"
