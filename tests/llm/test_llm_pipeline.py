"""The pipeline's stages against their operators' own rules, on whole small tables."""

import collections
import re

import corpus_pipeline
import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_queries import exact_components

from tallyglass.llm import decontaminate, language_id, line_dedup, quality
from tallyglass.llm.common import table

#: Names that operators use for what they add or keep to themselves.
CLASHING = ("score", "accepted", "lang_pred", "n_lines", "n_removed", "ids", "n_tokens", "decoded", "_in", "_whole", "_text", "_words", "_lines", "_good", "_bits", "_at", "_gone", "_own", "_doc", "kept")


@pytest.fixture(scope="module")
def seen(spark, sf, tmp_path_factory):
    """Rows before and after each stage, run on what the last one wrote, with clashing columns."""
    docs = table(spark, sf, "documents").withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHING})
    columns, root, out = docs.columns, tmp_path_factory.mktemp("stages"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(root / name))
        before, docs = docs, spark.read.parquet(str(root / name))
        assert docs.columns[: len(columns)] == columns if k == len(corpus_pipeline.STAGES) - 1 else docs.columns == columns
        out[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
    return out


def test_stages(seen):
    before, after = seen["line_dedup"]
    assert set(before) == set(after) and any(after[i].text != before[i].text for i in before)
    before, after = seen["near_dedup"]
    want = exact_components([(i, r.text) for i, r in before.items()], 5)
    assert set(after) == {i for i, (_, comp, _) in want.items() if comp == i}
    before, after = seen["byte_bpe"]
    assert all(after[i].text == before[i].text and len(after[i]["ids_"]) == 4 * after[i]["n_tokens_"] for i in before)


def test_stages_keep_other_columns(seen):
    for before, after in seen.values():
        for i, r in after.items():
            assert all(r[c] == before[i][c] for c in (*CLASHING, "lang", "source"))


def test_language_stage_keeps_what_is_accepted(spark, sf, seen):
    before, after = seen["language_id"]
    docs = table(spark, sf, "documents")
    said = language_id.predict(docs.select("doc_id", "text"), language_id.fitted(docs, keep=language_id.in_training(F.col("doc_id")))).collect()
    assert set(after) == {r.doc_id for r in said if r.accepted} and {r.doc_id for r in said if r.lang_pred == "und"}.isdisjoint(after)
    assert all(after[i].text == before[i].text for i in after)


def test_line_stage_by_plain_rules(seen):
    before, after = seen["line_dedup"]
    strip = lambda x: x.strip(" \t\n\v\f\r")
    sites = collections.defaultdict(set)
    for r in before.values():
        for line in (r.text or "").split("\n"):
            sites[strip(line)].add(r.source)
    gone = {x for x, s in sites.items() if x and len(s) >= line_dedup.MIN_SITES}
    cut = 0
    for i, r in before.items():
        clean = "\n".join(x for x in (r.text or "").split("\n") if strip(x) not in gone)
        heavy = 2 * len(clean) < len(r.text or "")
        cut += clean != (r.text or "")
        assert after[i].text == clean or (heavy and after[i].text == r.text)
        assert after[i].n_chars == len(after[i].text)
    assert cut > 0


def test_decontaminate_stage_by_sql(sf, seen):
    before, after = seen["decontaminate"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(before), "text": [r.text for r in before.values()]}))
    con.sql(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
    found = {r[0] for r in con.sql(decontaminate.ORACLE).fetchall()}
    assert found and set(after) == set(before) - found


def test_quality_keeps_other_columns(spark, sf):
    docs = table(spark, sf, "documents").withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHING if c != "kept"})
    out = quality.judged(docs)
    assert out.columns == [*docs.columns, *quality.RESULTS]
    rows, plain = out.collect(), {r.doc_id: r for r in quality.judged(table(spark, sf, "documents").select("doc_id", "text")).collect()}
    assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING if c != "kept")
    assert all(r[c] == plain[r.doc_id][c] for r in rows for c in quality.RESULTS)


def test_quality_verdict_by_plain_rules(spark, sf):
    word = r"[^\x20\x09-\x0D]+"

    def fails(line):
        n = len(re.findall(word, line))
        letters = [c for c in line if c.isalpha()]
        navigation = len(re.findall(quality.NAVIGATION, line)) * 10 > n or (n <= 3 and not re.search(r"[^\w\s]|_", line.rstrip(" \t\n\v\f\r")[-1:]))
        upper = not any(c.islower() for c in letters) and sum(c.isupper() for c in letters) >= 20
        return navigation or (line.count("!") - 1) * 10 > n or upper or re.search(quality.BOILERPLATE, line)

    twice = table(spark, sf, "documents").select("doc_id", "text")
    rows = quality.judged(twice.unionByName(twice)).collect()
    assert len(rows) == 2 * twice.count()
    for r in rows:
        lines = [x for x in (r.text or "").split("\n") if re.search(word, x)]
        good = [x for x in lines if not fails(x)]
        lost = sum(map(len, re.findall(word, " ".join(lines)))) - sum(map(len, re.findall(word, " ".join(good))))
        assert (r.n_lines_removed, r.lost_chars, r.cleaned) == (len(lines) - len(good), lost, "\n".join(good))
        assert r.kept == (not r.base_failed and 100 * lost <= quality.MOST_LOST * r.word_chars)


def test_run_and_empty_tables(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    rows = corpus_pipeline.run(spark, sf).count()
    assert 0 < rows < table(spark, sf, "documents").count()
    for name in ("documents", "benchmark"):
        table(spark, sf, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
