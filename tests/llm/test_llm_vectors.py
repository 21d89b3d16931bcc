"""Vector operators against brute force, on whole test tables and on small tables with every odd case."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass import llm
from tallyglass.llm.centroid_clusters import clustered, nearest
from tallyglass.llm.common import table
from tallyglass.llm.hard_negatives import limits, mined
from tallyglass.llm.nearest import neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, score double, cluster int, _x int, _g string"


def odd_rows():
    """Copies, ties, repeated rows, other lengths, and rows that take no part."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-6, 7, 4) / 8], int(rng.integers(0, 3))) for i in range(0, 360, 5)]
    rows += [(1000 + 50 * k, [0.5, -0.25, 0.125, 0.75], k % 2) for k in range(40)]  # copies of one vector
    rows += [(4000 + i, [x / 4 for x in (i, 1 - i, 2.5)], i % 3) for i in range(12)]  # another length
    rows += [rows[0], rows[0], rows[-1]]  # repeated rows
    rows += [(7000, None, 1), (7100, [1.0, None, 0.0, 0.0], 1), (7200, [math.nan, 0.0, 0.0, 0.0], 1), (7300, [math.inf, 0.0, 0.0, 0.0], 1), (7400, [], 1), (None, [0.1, 0.2, 0.3, 0.4], 1), (7500, [0.0, 0.0, 0.0, 0.0], 2), (7600, [0.1, 0.2, 0.3, 0.4], None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1.5, 3, 4, "x") for r in odd_rows()], SCHEMA).repartition(3)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_op11_odd_rows(odd):
    import hashlib

    got, centroids = clustered(odd, k=7, rounds=3, size=4)
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in odd_rows() if fine(v) and len(v) == 4]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:7]
    c = [v for _, v in starts]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(c))

    for _ in range(3):
        by = {}
        for _, v in rows:
            by.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(by[k]) for x in zip(*by[k], strict=True)] if k in by else m for k, m in enumerate(c)]
    assert centroids.tolist() == c
    want = [(i, near(v)[1], near(v)[0]) for i, v in rows]
    by = {k: sum(d for _, m, d in want if m == k) for k in range(7)}
    want = [(i, k, d, by[k], sum(by.values())) for i, k, d in want]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_op11_few_none_and_large(spark, odd):
    got, centroids = clustered(odd.where("vec_id = 0"), size=4)
    assert {tuple(r) for r in got.collect()} == {(0, 0, 0, 0, 0)} and got.count() == 3 and len(centroids) == 3
    got, centroids = clustered(odd.limit(0))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"] and len(centroids) == 0
    x, c = np.array([[1 << 26, -5], [3, 4]]), np.array([[1 << 26, -6], [0, 0], [0, 0]])
    best, d = nearest(x, c)
    assert best.tolist() == [0, 1] and d.tolist() == [1, 25]
    with pytest.raises(Exception, match="beyond 2"):
        clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))[0].collect()


def mined_plainly(rows, anchor, k, m, low, high):
    own = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if i is not None and lab is not None and fine(v)}
    out = set()
    for i, lab, v in own:
        if not anchor(i):
            continue
        others = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in own if j != i and len(w) == len(v)]
        others.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in others if s[2] == lab][:k]:
            found = [s for s in others if s[2] != lab and low * p <= 100 * s[0] <= high * p][:m]
            out |= {(i, j, r, n, p, s) for r, (s, n, _) in enumerate(found, 1)}
    return out


def test_op12_odd_rows(odd):
    df = mined(odd, F.col("_id") % 50 == 0, positives=3, negatives=4, leaf=16, anchor_leaf=4, seeds=1)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in df.collect()]
    want = mined_plainly(odd_rows(), lambda i: i % 50 == 0, 3, 4, 30, 90)
    assert len(got) == len(set(got)) and set(got) == want and any(r[0] >= 4000 for r in want)


def test_op12_prunes_and_empty(spark, odd):
    """Two far clusters: whole groups of anchors never meet the other one, and results are whole."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (np.array([4, 0, 0, 4]) if i % 2 else np.array([-4, 1, 0, -4])) + rng.normal(0, 0.2, 4)], i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {tuple(r) for r in mined(df, F.col("_id") % 20 == 0, leaf=32, anchor_leaf=4).collect()}
    assert got == mined_plainly(rows, lambda i: i % 20 == 0, 5, 10, 30, 90)
    assert mined(odd.limit(0), F.col("_id") % 20 == 0).count() == 0
    assert mined(odd.where("vec_id < 50"), F.col("_id") > 100).count() == 0


def test_op12_limits():
    p = np.array([-7, 0, 7, 10, 1 << 60])
    low, high = limits(p, 30, 90)
    assert low.tolist() == [-(-30 * int(x) // 100) for x in p]
    assert high.tolist() == [90 * int(x) // 100 for x in p]


def near_plainly(rows, query, k):
    own = {(i, tuple(v)) for i, v, _ in rows if i is not None and fine(v) and any(v)}
    out = {}
    for i, v in own:
        if query(i):
            found = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in own if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


@pytest.mark.parametrize("block", [8, 4096])
def test_op13_odd_rows(odd, block):
    """All is below the top of the arrays here, so the answer is exact."""
    df = neighbours(odd, F.col("_id") % 20 == 0, miss=1e-9, block=block)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == near_plainly(odd_rows(), lambda i: i % 20 == 0, 20)


def test_op13_lengths_in_bands(spark):
    """Vectors of very different lengths: the largest product wins, not the smallest angle."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.standard_normal(8) * 2.0 ** (i % 9)], 0) for i in range(600)]
    df = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours(df, F.col("_id") % 20 == 0, block=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = near_plainly(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and sum(len(got[i] & {j for j, _ in want[i]}) for i in want) >= 0.9 * 20 * len(want)
    assert neighbours(df.limit(0), F.col("_id") % 20 == 0).count() == 0


def test_op13_recall(spark, duck):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table(spark, sf, "embeddings").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in llm.queries()["op13_nearest_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    hit = 0
    for i, found in got.items():
        s = x @ x[ids == i][0]
        s[ids == i] = -np.inf
        assert len(found) == 20 and all(abs(s[ids == j][0] - v) < 1e-9 for j, v in found.items())
        hit += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & set(found))
    assert hit >= 0.9 * 20 * len(got)
