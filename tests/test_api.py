"""The engine object on small tables."""

from pyspark.sql import functions as F

from tallyglass import fixtures as fx
from tallyglass import sinks
from tallyglass.api import Engine
from tallyglass.catalogue import TOPIC
from tallyglass.operators import chunking


def test_engine(spark, sf, tmp_path):
    tables = {"indicators": fx.indicators(spark, sf), "districts": fx.districts(spark, sf), "documents": fx.documents(spark, sf).withColumns({"pdf_url": F.lit("u"), "school_year": F.lit(2025)}), "actions": fx.actions(spark, sf), "goals": fx.goals(spark, sf), "metrics": fx.metrics(spark, sf)}
    sinks.write_tables({k: tables[k] for k in ("districts", "documents")}, str(tmp_path))
    assert set(Engine.open(spark, str(tmp_path)).tables) == {"districts", "documents"}
    engine = Engine(tables | {"chunks": fx.chunks(spark, sf).withColumns({"cds_code": F.col("chunk_id"), "section_id": F.lit("s"), "page_start": F.lit(1), "chunk_index": F.col("chunk_id")}), "embeddings": fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")})
    assert engine.find_opportunities(TOPIC, limit=3).count() == 3
    brief = engine.account_brief(1, TOPIC)
    assert brief["district"].count() == 1 and brief["strict_topic_actions"].count() <= 6
    assert engine.declining_report()["summary"].count() == 1
    assert engine.plan_documents(district="*1*", limit=99).count() == 25
    assert engine.stats().first().chunks == 200
    assert [r.place for r in engine.get_chunk(5).collect()] == [-1, 0, 1]
    assert engine.explain()["indicator"] == "chronic_absenteeism"

    def fails(query):
        raise RuntimeError

    engine.embed = fails
    assert 0 < engine.search("onre thand", 5, district="en").count() <= 5
    engine.embed = lambda q: [1.0] * 64
    assert engine.search("onre", 5).count() == 5
    spent, sections = engine.district_context(1)
    assert spent.first().action_count > 0 and sections.count() == 1


def test_export(spark):
    rows = spark.createDataFrame([("c", "1", "/a/b.pdf", "D", "", "S", "", "", "text", ""), ("d", "1", None, "", "", "", "", "", " ", None)], "chunk_id string, cds_code string, source_path string, district string, county string, section_path string, goal_number string, action_number string, body_text string, search_text string")
    out = chunking.exported(rows).withColumn("t", chunking.embedding_text()).collect()
    assert [(r.district_doc_id, r.t) for r in out] == [("1:b.pdf", "District: D\nSection: S\n\ntext")]


def test_command_line(spark, sf, tmp_path, capsys):
    from tallyglass.__main__ import main

    tables = {"chunks": fx.chunks(spark, sf).withColumn("cds_code", F.col("chunk_id")), "embeddings": fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")}
    sinks.write_tables(tables, str(tmp_path))
    assert "| Rank | Chunk |" in main(["search", str(tmp_path), "onre thand", "--filters", '{"district": "en"}'])
    assert '"count": 2' in main(["search", str(tmp_path), "onre", "--limit", "2", "--json"])


def test_report_helpers(spark):
    from tallyglass.functions import text
    from tallyglass.plans import reports

    a = spark.createDataFrame([("x", 1, 0.0, True), ("y", 1, 5.0, True), ("z", 0, 0.0, True)], "district_name string, explicit_action_count int, explicit_action_dollars double, negative_pressure boolean")
    assert (reports.pressured(a).count(), reports.pressured(a, funded=True).count()) == (2, 1)
    r = spark.range(1).select(text.composed(", ", F.lit("a"), F.lit(" "), F.lit("b")).alias("c"), text.sanitised(F.array(F.lit("x" * 600), F.lit(None)), 25).alias("s")).first()
    assert r.c == "a, b" and [len(x) for x in r.s] == [500]
