"""Operators on small literal tables."""

import json

from pyspark.sql import functions as F

from tallyglass import sinks, sources
from tallyglass.operators import chunking, dedup, flatten, quality, tables, upsert
from tallyglass.plans import reports, retrieval
from tallyglass.streaming import load_chunks


def test_plans_are_resolved_and_flattened(spark, tmp_path):
    plan = {
        "source_path": "/p/12345678901234.pdf", "source_file": "x.pdf", "district_name": "Alameda Unified School District", "school_year": "2025-26",
        "goal_count": 1, "metric_count": 1, "action_count": 2, "extraction_warnings": ["w"],
        "goals": [{"goal_number": "", "description": " d ", "goal_type": "Broad", "source_pages": [1],
                   "actions": [{"action_number": "1.1", "title": "t", "total_funds": 5.0, "contributing": True}, {"title": "u"}],
                   "metrics": [{"metric_name": "m"}]}, {"goal_number": "2"}],
    }
    (tmp_path / "plans.json").write_text(json.dumps({"districts": [plan]}))
    (tmp_path / "manifest.json").write_text(json.dumps([{"cds_code": "12345678901234", "district": "Old"}, {"cds_code": "12345678901234", "district": "Alameda Unified", "county": "C"}]))
    rows = flatten.resolved(sources.plans_json(spark, str(tmp_path / "plans.json")), sources.manifest_json(spark, str(tmp_path / "manifest.json")))
    doc = flatten.plan_documents(rows).first()
    assert (doc.cds_code, doc.district, doc.district_name_match, doc.extraction_warning_count) == ("12345678901234", "Alameda Unified", 1, 1)
    assert [r.goal_id for r in flatten.plan_goals(rows).orderBy("goal_id").collect()] == ["12345678901234:goal:1:1", "12345678901234:goal:2:2"]
    acts = flatten.plan_actions(rows).orderBy("action_id").collect()
    assert [(a.action_id.split(":goal:")[1], a.contributing) for a in acts] == [("1:1:action:1.1:1", 1), ("1:1:action:2:2", None)]
    assert flatten.plan_metrics(rows).count() == 1


def test_packages_of_three_shapes(spark):
    row = {"status": 1.5, "studentGroup": "ALL", "schoolYearId": 0}
    package = {
        "metadata": {"school_year_id": 9, "district": {"cds_code": "1", "county": "C"}},
        "summary": {"summary_cards": [{"indicatorId": 1, "primary": row}, 5, {"primary": 3}]},
        "student_groups": {"4": {"primary": {"list": [row, row]}}, "5": [{"primary": row}, {"list": [row]}], "9": "x"},
        "charts": {"cci": [{"grade": "1", "currentYear": 2}, 7], "five": {"currentYear": 3}},
    }
    rows = flatten.packages(spark.createDataFrame([(json.dumps(package),), ("broken",)], "value string"))
    card = flatten.dashboard_indicators(rows).collect()
    assert [(c.cds_code, c.indicator_name, c.status, c.school_year_id) for c in card] == [("1", "chronic_absenteeism", 1.5, 9)]
    groups = flatten.dashboard_student_groups(rows).groupBy("indicator_name").count().collect()
    assert {g.indicator_name: g["count"] for g in groups} == {"graduation_rate": 2, "college_career": 2}
    trends = flatten.dashboard_trends(rows).collect()
    assert {(t.indicator_name, t.current_year) for t in trends} == {("college_career", 2.0), ("indicator_five", 3.0)}
    ids = spark.createDataFrame([('{"a": {"indicatorId": 4}, "b": [{"indicatorId": "2"}]}',), ("{}",)], "t string").select(flatten.indicator_ids("t").alias("i"))
    assert [r.i for r in ids.collect()] == [[2, 4], list(range(1, 9))]


def test_directory(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("CD Code\tCounty\tDistrict\tStatusType\tPhone\tExt  \tAdmFName\tAdmLName\n0110017\tA\tX\tActive\tNo Data\t\tJo\tDoe\nbad\tB\tY\tActive\t\t\t\t\n")
    rows = sources.directory_tsv(spark, str(tmp_path / "d.tsv"))
    assert [(r.cds_code, r.phone) for r in rows.collect()] == [("01100170000000", "")]
    assert sources.administrator_contacts(rows).first().name == "Jo Doe"
    assert sources.public_districts(rows, county="a", district="x").count() == 1
    html = "<tr><th>CDS Code</th><td>01 10017 0000000</td></tr><tr><th>Superintendent</th><td>Ann Lee<br>Chief<br>(510) 555-1234<br>a@b.org</td></tr>"
    pages = sources.directory_pages(spark.createDataFrame([(1, html), (2, "Please solve the CAPTCHA"), (3, "")], "id int, html string"))
    assert [r.parse_status for r in pages.orderBy("id").collect()] == ["ok", "blocked", "error"]
    c = sources.directory_contacts(pages).collect()
    assert [(x.role, x.name, x.title, x.phone, x.email) for x in c] == [("superintendent", "Ann Lee", "Chief", "(510) 555-1234", "a@b.org")]


def test_segments_and_chunks(spark):
    words = "The district improved family outreach and attendance support for every student this year. "
    body = "Plan Summary\n" + (words * 3) + "\n" + (words * 3) + "\nAction # Title Description\nskipped " + words + "\nGoal Analysis\n" + words * 4
    pages = spark.createDataFrame([("d", 1, body), ("d", 25, "LCAP Instructions"), ("d", 26, "Plan Summary\n" + words * 5)], "doc string, page_number int, text string")
    segs = chunking.segments(pages).orderBy("segment").collect()
    assert [(s.section_type, s.page_start, s.page_end) for s in segs] == [("plan_summary", 1, 1), ("goal_analysis", 1, 1)]
    assert "skipped" not in segs[0].text
    docs = spark.createDataFrame([("d", "1", "C", "D", "2025", "/p", "", 1)], "doc string, cds_code string, county string, district string, school_year string, source_path string, pdf_url string, district_name_match int")
    chunks = chunking.chunks(chunking.segments(pages), docs).collect()
    assert len(chunks) == 2 and chunks[0].search_text.startswith("District: D | County: C | Section: ")
    assert all(len(c.chunk_id) == 24 and 0 <= c.authored_confidence <= 1 for c in chunks)


def test_packing_limits_and_overlap(spark):
    unit = "Attendance teams called families about school and listened to them closely. " * 4
    text = "\n\n".join(f"Part {k}. {unit}" for k in range(40))
    out = spark.createDataFrame([(text,), ("short",), ("",), (None,)], "t string").select(chunking.packed(chunking.text_units(F.coalesce("t", F.lit("")))).alias("p")).collect()
    bodies = out[0].p
    assert len(bodies) > 3 and all(len(b) / 4 <= 930 for b in bodies)
    for a, b in zip(bodies, bodies[1:]):
        assert b.split("\n\n")[0] in a  # the overlap
    assert {k for b in bodies for k in range(40) if f"Part {k}." in b} == set(range(40))
    assert [r.p for r in out[1:]] == [[], [], []]


def test_quality_gate(spark):
    long = "word " * 60
    rows = [(1, "D", "s", "p", 1, 0.9, long), (2, "D", "s", "p", 0, 0.9, long), (3, "D", "s", "p", 1, 0.2, long + " Instructions: Introduction"), (4, "D", "s", "p", 1, 0.9, "tiny")]
    df = spark.createDataFrame(rows, "chunk_id int, district string, section_type string, section_path string, page_start int, authored_confidence double, body_text string")
    got = {r.chunk_id: r.issues for r in quality.with_issues(df).collect()}
    assert got == {1: [], 2: ["missing_citation_metadata"], 3: ["template_marker", "low_confidence"], 4: ["too_short"]}
    s = quality.summary(df).first()
    assert (s.chunks, s.issue_chunk_count, s.hard_issue_chunk_count) == (4, 3, 2) and not s["pass"]
    assert quality.summary(df.limit(0)).first()["pass"]
    assert quality.issue_rows(df).count() == 3


def test_issue_counts_make_each_chunk_s_issues_once(spark):
    lines = "\n".join(["Total 12 34", "$ 5", "9 9 9", "a b"] * 20)
    texts = ["word " * 60, "tiny", lines, f"{lines}\nLCAP\n  Instructions", f"{lines} metric #", f"{lines}\nTotal  Planned Expenditures", "word " * 60 + "Contributing\tActions Table", "x" * 9000 + " ACTION #  TITLE", "", None]
    rows = [(k, "D", "s", "p", k % 3, 0.5 + k % 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_id int, district string, section_type string, section_path string, page_start int, authored_confidence double, body_text string")
    want = {}
    for r in quality.with_issues(df).collect():
        for k in r.issues:
            want[k] = want.get(k, 0) + 1
    out = quality.issue_counts(df)
    assert {r.issue: r.n for r in out.collect()} == want and {"template_marker", "budget_marker", "table_marker", "table_like"} <= set(want)
    assert [(r.n, r.issue) for r in out.collect()] == sorted(((n, k) for k, n in want.items()), key=lambda x: (-x[0], x[1]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\d]") == 1  # the pattern of the score


def test_tables(spark):
    rows = [
        ("d", 1, 0, 0, ["Goal #", "Description", "Type of Goal"]), ("d", 1, 0, 1, ["1", "Better", "Broad"]),
        ("d", 2, 0, 0, ["Action #", "Title", "Description", "Total Funds", "Contributing"]), ("d", 2, 0, 1, ["1.1", "Visit", "Home", "$1,000", "Yes"]), ("d", 2, 0, 2, ["", "", "more", "", ""]),
        ("d", 3, 0, 0, ["Metric #", "Metric", "Baseline", "Year 1 Outcome"]), ("d", 3, 0, 1, ["1.1", "Rate", "All: 20%", "All: 18%"]), ("d", 3, 0, 2, ["", "", "EL: 5%", ""]),
    ]
    df = spark.createDataFrame(rows, "doc string, page int, table_no int, row_no int, cells array<string>")
    assert [(g.goal_number, g.description) for g in tables.goals(df).collect()] == [("1", "Better")]
    a = tables.actions(df).first()
    assert (a.action_number, a.title, a.description, a.total_funds, a.contributing) == ("1.1", "Visit", "Home\nmore", 1000.0, True)
    m = tables.metrics(df).first()
    assert (m.metric_number, m.baseline_raw) == ("1.1", "All: 20%\nEL: 5%") and len(m.baseline.entries) == 2
    pages = spark.createDataFrame([("d", 1, "Goal # Description"), ("d", 2, "x"), ("d", 3, "y"), ("e", 1, "z")], "doc string, page_number int, text string")
    assert {(r.doc, r.page_number) for r in tables.candidate_pages(pages).collect()} == {("d", 1), ("d", 2), ("e", 1)}


def test_dedup_and_merge(spark):
    df = spark.createDataFrame([("k", 1, "", [2], 1.0), ("k", 2, "v", [1], None), ("k", 3, "w", [2], 3.0)], "k string, ord int, v string, source_pages array<int>, total_funds double")
    assert dedup.keep_first(df, ["k"], ["ord"]).first().ord == 1
    m = dedup.merge_records(df, ["k"]).first()
    assert (m.v, m.source_pages) == ("v", [1, 2])
    a = dedup.merge_actions(df.withColumn("description", F.col("v")), ["k"]).first()
    assert (a.description, a.total_funds) == ("v\nw", 1.0)


def test_upserts(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    assert sorted(map(tuple, upsert.upsert(t, new, ["k"], "at").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    state, told = upsert.insert_if_absent(t, new, ["k"], "at")
    assert sorted(map(tuple, state.collect())) == [(1, "a"), (2, "b"), (3, "z")]
    assert sorted(map(tuple, told.collect())) == [(2, False), (3, True)]
    assert sorted(map(tuple, upsert.replace_children(t, new, new.where("v = 'y'"), "k").collect())) == [(1, "a"), (2, "y")]
    null_source = spark.createDataFrame([(1, "r", None, "old")], "cds_code int, role string, source string, name string")
    inc = spark.createDataFrame([(1, "r", "s", "new")], "cds_code int, role string, source string, name string")
    assert upsert.contacts_upsert(null_source, inc).first().name == "new"
    hit, miss = upsert.cache_probe(spark.createDataFrame([("a",), ("b",)], "text_hash string"), spark.createDataFrame([("m:3:a", [1.0])], "cache_key string, embedding array<double>"), "m", 3)
    assert (hit.count(), miss.count()) == (1, 1)


def test_retrieval(spark):
    chunks = spark.createDataFrame([("a", "x y", 1), ("b", "x", 2), ("c", "re engagement here", 3)], "chunk_id string, search_text string, cds_code int").withColumns({"district": F.lit("D"), "section_type": F.lit("s")})
    assert [r.chunk_id for r in retrieval.bm25(chunks, "re-engagement", 5).collect()] == ["c"]
    assert retrieval.bm25(chunks, "the of", 5).count() == 0
    cohort = chunks.where("chunk_id = 'c'").select("cds_code")
    assert [r.chunk_id for r in retrieval.filtered(chunks, cohort=cohort).collect()] == ["c"]
    assert retrieval.filtered(chunks, cohort=cohort.where("false")).count() == 3
    bm = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, bm25_rank int")
    dn = spark.createDataFrame([("b", 1), ("c", 2)], "chunk_id string, dense_rank int")
    assert [r.chunk_id for r in retrieval.rrf_joined(bm, dn).collect()] == ["b", "a", "c"]
    assert [r.chunk_id for r in retrieval.rrf([(bm, "bm25_rank")]).collect()] == ["a", "b"]
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    assert [r.chunk_id for r in retrieval.dense(emb, [1.0, 0.1], 5).collect()] == ["a", "b"]
    w = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 2.0)], "chunk_id string, term string, weight double")
    assert [r.chunk_id for r in retrieval.sparse(w, {"t": 1.0}, 5).collect()] == ["b", "a"]
    found = retrieval.search(chunks, emb, "x", [1.0, 0.0])
    assert found.first().chunk_id == "a"

    def broken(rows):
        raise RuntimeError

    assert retrieval.search(chunks, emb, "x", [1.0, 0.0], scorer=broken).first().chunk_id == "a"
    assert retrieval.search(chunks, emb, "x", [1.0, 0.0], scorer=lambda rows: {"b": 1.0}).first().chunk_id == "b"
    linked = retrieval.neighbours(chunks.withColumns({"section_id": F.lit("1"), "page_start": F.lit(1), "chunk_index": F.col("cds_code")}))
    assert [(r.chunk_id, r.place) for r in retrieval.with_neighbours(linked, "b").collect()] == [("a", -1), ("b", 0), ("c", 1)]


def test_semi_join_and_fan_out(spark):
    t = {
        "indicators": spark.createDataFrame([(1, "chronic_absenteeism", "ALL", 20.0, -1.0, 5, 3)], "cds_code int, indicator_name string, student_group string, status double, change double, count int, chronic_count int"),
        "districts": spark.createDataFrame([(1, "C", "D")], "cds_code int, county string, district string"),
        "documents": spark.createDataFrame([(1, None), (1, 1)], "cds_code int, district_name_match int"),
        "actions": spark.createDataFrame([(1, "a", "Attendance", None, 10.0), (1, "b", "Home visit", "x", 5.0)], "cds_code int, action_id string, title string, description string, total_funds double"),
    }
    r = reports.declining_candidates(t).first()
    # two documents double the sums; a null description drops the broad hit but not the strict one
    assert (r.broad_funds, r.broad_actions, r.strict_funds, r.strict_actions) == (10.0, 2, 30.0, 4)


def test_sinks_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], True, None)], "id int, xs array<int>, ok boolean, t string")
    sinks.write_csv(df, str(tmp_path / "csv"), files=1)
    back = sources.table_csv(spark, str(tmp_path / "csv")).first()
    assert (back.id, back.xs, back.ok) == ("1", "[1,2]", "1")
    assert "| Rank | Id |" in sinks.markdown(df, {"Id": "id"})
    assert json.loads(sinks.envelope(df))["count"] == 1
    assert sinks.row_counts({"a": df, "b": df.limit(0)}).count() == 2
    sinks.write_json_lines(df, str(tmp_path / "land"))
    for _ in range(2):  # the second run finds nothing new
        load_chunks(spark, str(tmp_path / "land"), "id int, t string", str(tmp_path / "out"), str(tmp_path / "cp"), key="id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_grant_prompt_becomes_a_heading(spark):
    line = "Additional Concentration Grant Funding A description of the plan for how the additional concentration grant add-on funding identified above will be used, as applicable. We hire two counselors."
    df = spark.createDataFrame([(line,)], "t string")
    assert df.select(chunking.clean_line(F.col("t")).alias("t")).first().t == "Additional Concentration Grant Funding: We hire two counselors."


def test_counts_come_from_the_write(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    own = spark.range(10, numPartitions=2).mapInArrow(through, "id long")
    assert sinks.write_counted({"a": own, "b": spark.range(3), "none": spark.range(0)}, str(tmp_path)) == {"a": 10, "b": 3, "none": 0}
    assert read.value == 10 and spark.read.parquet(f"{tmp_path}/a").count() == 10
    assert sinks.write_counted({"b": spark.range(4)}, str(tmp_path), append=True) == {"b": 4} and spark.read.parquet(f"{tmp_path}/b").count() == 7
