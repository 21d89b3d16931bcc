"""What must hold beyond the bounds of broadcasts and blocks, with hot groups, null ids and private names."""

import random

import pandas as pd
from pyspark.sql import functions as F
from test_llm_cases import docs
from test_llm_queries import exact_components

from tallyglass.llm import decontaminate, license_scan, line_dedup, near_dedup


def test_line_dedup_without_broadcasts(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda: sorted(map(tuple, line_dedup.deduplicated(df).select("doc_id", "n_removed", F.md5("text")).collect()))
    want = rows()
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_near_dedup_without_broadcasts(spark, sf, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = exact_components([(r.doc_id, r.text) for r in df.collect()])
    assert {r["_id"]: (r["_n"], r.component_id) for r in near_dedup.near_duplicates(df).collect()} == {i: x[:2] for i, x in want.items()}


def test_decontamination_without_broadcasts(spark, sf, monkeypatch):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    rows = lambda: sorted(map(tuple, decontaminate.found_items(read("documents"), read("benchmark")).collect()))
    want = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert want and rows() == want


def test_private_names_of_lines(spark):
    rows = [(k, f"Shared footer.\nBody of text number {k} with more words than the footer.", "en", f"s{k}", 0) for k in range(12)]
    for name in ("_at", "_row", "_text", "_in", "_doc", "_k1", "_h1", "_site", "_copy"):
        df = docs(spark, rows).withColumnRenamed("lang", name)
        for only in (False, True):
            out = line_dedup.deduplicated(df, only_copies=only).collect()
            assert len(out) == 12 and all(r.n_removed == 1 and r[name] == "en" for r in out), name


def test_very_long_text_of_lines(spark):
    rows = [(k, "Footer of all.\n" + "\n".join(f"own line {k} {j}" for j in range(3)), "en", f"s{k}", 0) for k in range(11)]
    rows.append((99, "\n".join([f"line {j}" for j in range(50_000)] + ["Footer of all."]), "en", "s99", 0))
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs(spark, rows)).collect()}
    assert got[99].n_removed == 1 and got[99].n_lines == 50_001 and got[99].text.endswith("line 49999")


def look_alikes(n):
    """Texts of one template that aren't linked with each other, but for a few."""
    rng = random.Random(4)
    base = [f"c{k}" for k in range(160)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(160), 14 if i % 10 else 1):
            w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w), None, None, 0))
    return rows


def test_blocks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    sizes = []

    def seen(block: pd.DataFrame, shingle: int = 2):
        sizes.append(len(block))
        return []

    rows = look_alikes(400)
    want = exact_components([(r[0], r[1]) for r in rows])
    got = {r["_id"]: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: x[1] for i, x in want.items()}
    # batches of any cut come together by block, and by no more than that
    monkeypatch.setattr(near_dedup, "_links_of", seen)
    table = pd.DataFrame({"_key": 1, "_i": [k // 64 for k in range(640)], "_j": 0, "_left": True, "_id": range(640), "_comp": range(640), "_rest": True})
    list(near_dedup._block_links(iter([table[lo : lo + 50].copy() for lo in range(0, 640, 50)])))
    assert sizes == [64] * 10


def test_null_ids_in_stages(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = " ".join(f"t{k}" for k in range(80))
    rows = [(None, item, None, None, 0), (1, "clean text", None, None, 0), (2, text, None, None, 0), (None, text + " more", None, None, 0), (None, "all its own", None, None, 0)]
    left = decontaminate.stage(spark, docs(spark, rows), str(tmp_path))
    assert left.count() == 4 and item not in [r.text for r in left.collect()]
    assert sorted(r.text for r in near_dedup.stage(spark, left, "").collect()) == sorted([text, "clean text", "all its own"])


def test_licenses_of_any_size(spark):
    long = " ".join(f"term{k}" for k in range(3000))  # as long as a whole license text
    rows = [(1, "before " * 700 + long + " after" * 90, None, None, 0), (2, long[:9000], None, None, 0), (3, None, None, None, 0)] * 2
    got = license_scan.found_templates(docs(spark, rows), {"long": long, "short": "term7 term8 term9 term10 term11 term12"}).collect()
    assert sorted((r["_doc"], r["_template"], r.n_shared) for r in got) == [(1, "long", 2996), (1, "short", 2), (2, "short", 2)]
    assert license_scan.found_templates(docs(spark, rows), {}).count() == 0
