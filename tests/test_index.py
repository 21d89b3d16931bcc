"""The written index and tables kept by key hash: what is read, what is rewritten, and results against plain Python."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass import fixtures as fx
from tallyglass.functions.stem import dictionary, folded, stem
from tallyglass.plans import cells, inverted, retrieval
from tallyglass.sinks.keyed import Keyed

SCHEMA = "chunk_id long, search_text string, district string, section_type string"
ROWS = [(1, "a b c a b", "", ""), (2, "b x x a b y", "", ""), (3, "a x b", None, ""), (4, "b a", "", ""), (5, "a a a", "", ""), (6, None, "", ""), (7, "a b z", "", ""), (8, "", "", ""), (None, "a b", "", "")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return inverted.build(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path_factory.mktemp('small')}", buckets=4)


@pytest.fixture(scope="module")
def whole(spark, sf, tmp_path_factory):
    return inverted.build(fx.chunks(spark, sf), f"file://{tmp_path_factory.mktemp('whole')}", buckets=16)


def density(query):
    """Covers by trying all stretches."""
    clauses, out = inverted.parsed(query), []
    for i, text, *_ in ROWS:
        words = (text or "").split()

        def at(p, words=words):
            return [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]

        fit = [c for c in clauses if all(at(p) for p in c["all"]) and not any(at(p) for p in c["none"])]

        def holds(a, b, fit=fit, at=at):
            return any(all(any(a <= k and k + len(p) - 1 <= b for k in at(p)) for p in c["all"]) for c in fit)

        covers = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)]
        needed = {w for c in clauses for p in c["all"] for w in p}
        if covers and i is not None:
            out.append((i, round(sum(0.1 / (1 + b - a + 1 - sum(w in needed for w in words[a : b + 1])) for a, b in covers), 9)))
    return sorted(out, key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("query", ["a b", '"a b"', "a or b", "a -x", '"a b" or x -z', 'b "a b"', "a-b z", "q", "-a", ""])
def test_cover_density(small, query):
    got = inverted.cover_density(small, query, 50).collect()
    assert [(r.chunk_id, r.density) for r in got] == density(query) and [r.density_rank for r in got] == list(range(1, len(got) + 1))


def test_parsed():
    assert inverted.parsed('red "blue sky" -old or -"not this" green-leaf') == [{"all": [["red"], ["blue", "sky"]], "none": [["old"]]}, {"all": [["green", "leaf"]], "none": [["not", "this"]]}]


@pytest.mark.parametrize("query", ["onre thand", "onre-thand onre", "zzzz"])
def test_bm25_as_by_scan(spark, sf, whole, query):
    for limit in (3, 500):
        got, want = (df.withColumn("bm25_score", F.round("bm25_score", 9)).collect() for df in (inverted.bm25(whole, query, limit), retrieval.bm25(fx.chunks(spark, sf), query, limit)))
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_bounds_hold_and_prune(spark, sf, whole):
    """No chunk scores above its block's bound, and the pruned search leaves blocks out."""
    terms = ["onre", "thand"]
    docs, words = whole.totals()
    rows = whole.of_terms(terms)
    df = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("size").alias("n")).collect()}
    idf = {t: inverted._idf(docs, df.get(t, 0)) for t in terms}
    limit = {r["block"]: r["bound"] for r in inverted.bounds(rows, terms, idf, words / docs).collect()}
    scored = inverted.bm25(whole, "onre thand", 10_000, prune=False).withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(whole.blocks)))
    assert all(-r.bm25_score <= limit[r.block] + 1e-9 for r in scored.collect())
    few = inverted.build(fx.chunks(spark, sf), whole.path + "-small-blocks", buckets=4, per_block=2)
    sizes = few.postings.read().groupBy("term").agg(F.sum("size").alias("n")).where("n < 60").orderBy(F.col("n").desc(), "term").first()
    own = few.of_terms([sizes["term"]])
    kept = inverted._reached(own, few, [sizes["term"]], {sizes["term"]: inverted._idf(docs, sizes["n"])}, words / docs, 1)
    assert kept.count() < own.count()


def test_reads_the_terms_files_and_row_groups_only(spark, whole):
    rows = whole.of_terms(["onre"])
    read = {re.search(r"_bucket=(\d+)", f)[1] for f in rows.select("term", F.input_file_name().alias("f")).select("f").distinct().toPandas()["f"]}
    plan = explained(rows)
    assert len(read) == 1 and re.search(r"PartitionFilters: .*_bucket", plan) and "PushedFilters: [IsNotNull(term), EqualTo(term,onre)]" in plan
    narrow = explained(rows.groupBy("term").agg(F.sum("size")))
    assert "ReadSchema: struct<term:string,size:int>" in narrow


def explained(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def files(path):
    return {os.path.join(r, f) for r, _, names in os.walk(path.removeprefix("file://")) for f in names if f.endswith(".parquet")}


def test_added_chunks_rewrite_touched_buckets_only(spark, sf, whole):
    index = inverted.build(fx.chunks(spark, sf), whole.path + "-more", buckets=64)
    before = files(index.path)
    one = spark.createDataFrame([(10**9, "onre wholly-new", None, None)], SCHEMA)
    told = index.add(one)
    assert 0 < len(told["postings"]) <= 3 and len(told["chunks"]) == len(told["statistics"]) == 1
    gone = {re.search(r"(\w+)/_bucket=(\d+)", f).groups() for f in before - files(index.path)}
    assert gone <= {(t, str(b)) for t, bs in told.items() for b in bs}
    assert inverted.bm25(index, "wholly-new", 5).first().chunk_id == 10**9
    assert index.add(one) == {"postings": [], "chunks": [], "statistics": []}
    index.add(one.withColumn("search_text", F.lit("changed")))
    assert inverted.bm25(index, "wholly-new", 5).count() == 0 and inverted.bm25(index, "changed", 5).count() == 1
    docs, words = index.totals()
    assert docs == fx.chunks(spark, sf).count() + 1
    again = inverted.opened(spark, index.path)
    assert again == index and again.totals() == (docs, words)


def test_stems(spark, sf):
    # examples published with the rules
    said = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert [stem(w) for w in said[::2]] == said[1::2]
    assert folded("Ｃafé ﬁn") == "cafe fin" and stem("ab") == "ab" and stem("naïve") == "naïve"
    words = fx.chunks(spark, sf).select(F.explode(retrieval.tokens(F.col("search_text"))).alias("word"))
    got = {r.word: r.term for r in dictionary(words).collect()}
    assert set(got) == {r.word for r in words.distinct().collect()} and all(t == stem(folded(w)) for w, t in got.items())


def test_stemmed_index(spark, tmp_path):
    rows = [(1, "hoping for relations", "", ""), (2, "hope relation", "", ""), (3, "Café relational", "", "")]
    index = inverted.build(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/s", buckets=4, stemmed=True)
    assert {r.chunk_id for r in inverted.bm25(index, "hopes", 5).collect()} == {1, 2}
    assert {r.chunk_id for r in inverted.bm25(index, "relating", 5).collect()} == {1, 2, 3}
    assert {r.chunk_id for r in inverted.cover_density(index, "cafe", 5).collect()} == {3}
    assert inverted.opened(spark, index.path).stemmed


def test_keyed_upsert_rewrites_touched_partitions(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    table = Keyed(spark, f"file://{tmp_path}/t", ("k",), 32)
    assert not table.exists() and len(table.upsert(rows)) == 32
    new = spark.createDataFrame([(5, -1), (2000, 7)], "k long, v long")
    assert table.upsert(new) == table.touched(new) and table.upsert(new) == []
    assert table.insert_absent(spark.createDataFrame([(5, 9)], "k long, v long")) == []
    want = {(k, -1 if k == 5 else 2 * k) for k in range(1000)} | {(2000, 7)}
    assert {(r.k, r.v) for r in table.read().collect()} == want
    gone = table.change(new, lambda old, _: old.where("false"))
    assert gone == table.touched(new) and not table.read(gone).count()
    with pytest.raises(ValueError, match="kept by"):
        table.replace_children(new, new, "v")
    assert table.upsert(new.limit(0)) == []


def test_cells_hold_all_rows_and_reach_the_recall(spark, sf, tmp_path):
    """Queries are the ids divisible by 20, against all rows. Random vectors: three quarters of the cells."""
    rows = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    odd = spark.createDataFrame([(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [1.0]), (9005, [None] * 64)], "chunk_id long, embedding array<float>")
    index = cells.build(rows.unionByName(odd), f"file://{tmp_path}/cells", 64)
    held = index.vectors().select("chunk_id", "unit", "cell").collect()
    assert sorted(r.chunk_id for r in held) == sorted(r.chunk_id for r in rows.collect())
    x, ids = np.array([r.unit for r in held]), np.array([r.chunk_id for r in held])
    of_cell, n = np.array([r.cell for r in held]), len(index.centroids())
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        v = x[ids == q][0]
        want = set(ids[np.lexsort((ids, -(x @ v)))[:20]].tolist())
        probed = np.isin(of_cell, index.nearest_cells(v.tolist(), n * 3 // 4))
        hit += len(want & set(ids[probed][np.lexsort((ids[probed], -(x[probed] @ v)))[:20]].tolist()))
        total += 20
    assert hit >= 0.9 * total
    some = index.nearest_cells(x[0].tolist(), 3)
    got = index.search(x[0].tolist(), 500, 3)
    assert {r.chunk_id for r in got.collect()} == set(ids[np.isin(of_cell, some)].tolist())
    assert re.search(r"PartitionFilters: .*cell", explained(index.vectors(some)))
    assert cells.build(rows.limit(0), f"file://{tmp_path}/none", 64).centroids()


def test_no_word_is_shuffled(spark, whole, sf):
    """The postings of a group of blocks meet by one exchange, that of the chunks; a change leaves nothing beside the table."""
    chunks = spark.createDataFrame(ROWS, SCHEMA)
    rows = inverted.packed(inverted._postings(inverted._dealt(chunks, whole), whole))
    assert len(re.findall(r"^\(\d+\) Exchange", explained(rows), re.M)) == 1
    index = inverted.build(chunks, whole.path + "-beside", buckets=4)
    index.add(spark.createDataFrame([(1, "a q q", "", ""), (9, "b b", "", "")], SCHEMA))
    got = {(r.term, r.chunk_id, r.tf, r.n, *r.positions) for r in inverted.unpacked(index.postings.read(), index).collect()}
    want = {(w, i, ws.count(w), len(ws), *[k for k, x in enumerate(ws) if x == w]) for i, ws in [(1, ["a", "q", "q"]), (9, ["b", "b"]), *[(i, (t or "").split()) for i, t, *_ in ROWS if i and i > 1]] for w in ws}
    assert got == want and not [f for f in os.listdir(index.path.removeprefix("file://")) if "staged" in f]
