"""What keeps the work in proportion to the rows, on small tables."""

import re

from tallyglass import catalogue_texts
from tallyglass.functions import numeric
from tallyglass.operators import tables


def test_landed_files_are_written_by_many_tasks(spark, sf, tmp_path, monkeypatch):
    """A file for each row: few bytes, but by them all files would go to one task."""
    monkeypatch.setattr(catalogue_texts, "_folder", lambda s: f"file://{tmp_path}/landed")
    files = catalogue_texts._file_scan(spark, sf).first().files
    found = [re.search(r"s_part=(\d+)/part-(\d+)-", str(p)) for p in tmp_path.rglob("s_part=*/part-*")]
    folders = {m[1] for m in found}
    assert len(found) == files > 8 and len({m[2] for m in found}) == len(folders) == len({m.groups() for m in found})


def test_a_document_s_table_rows_are_shuffled_once(spark, sf):
    for made in (catalogue_texts._plan_metrics, catalogue_texts._plan_actions, catalogue_texts._plan_goals):
        plan = made(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange\b", plan)) == 1


def test_usual_measurement_cells(spark, monkeypatch):
    """The usual cell is read as by the long path."""
    raws = ["All: 17%", "Low Income: 3.50", "All: 17%%", "All: 17 %", "All:  17%", "All: 17%\n", " All: 17%", "A-B: 1", "All: 1,000", "All: .5", "All: 5.", "17%", "", "A : 1", "All: 1\nEL: 2%", "All: 1: 2", None]
    got = numeric.measurement("t").alias("got")
    monkeypatch.setattr(numeric, "_USUAL_CELL", r"\A\b\B")
    rows = spark.createDataFrame([(x,) for x in raws], "t string").coalesce(1).select("t", got, numeric.measurement("t").alias("want")).collect()
    assert len(rows) == len(raws) and all(r.got == r.want for r in rows)


def test_heads_of_odd_tables(spark):
    """Names that repeat, cells that aren't plain, and rows that go on, by hand."""
    head = ["Metric #", "Met­ric ", "Baseline", "Year 1  Outcome", "Year 2 Outcome", "Target for Year 3 Outcome"]
    cells = [(0, head), (1, ["1.1", "Rate", "All: 5%", "", None, "All: 7%"]), (2, ["", "goes on", "", "", "", ""]), (3, ["metric #", "metric", "baseline", "year 1 outcome", "", ""]), (4, ["", "", "", "", "", ""]), (5, ["1.2", "Other", "EL: 1", "", "", "2"])]
    rows = spark.createDataFrame([("d", 1, 0, i, c) for i, c in cells], "doc string, page int, table_no int, row_no int, cells array<string>")
    found = {r.metric_number: r for r in tables.metrics(tables.padded(rows)).collect()}
    assert set(found) == {"1.1", "1.2"} and found["1.1"].metric_name == "Rate\ngoes on" and found["1.1"].baseline.entries[0].numeric_values == [5.0]
    assert found["1.2"].year_3_target_raw == "2" and found["1.2"].source_pages == [1]
    kinds = tables.typed(rows).select("row_no", "kind", "heads").collect()
    assert {r.row_no for r in kinds} == {1, 2, 5} and all(r.kind == "metric" and r.heads["metric"] == 1 and r.heads["baseline"] == 2 for r in kinds)
