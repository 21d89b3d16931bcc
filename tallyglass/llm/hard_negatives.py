"""Hard negatives by dual-tree search over integer inner products.

Rows get a code of one bit per principal axis of a bounded sample, each split at its median.
Sorted by code they are packed into blocks, the leaves; the nodes above are prefixes of the code,
with a ball around the vectors below. Anchors have a tree of their own by the same axes. A search
starts at the two roots and expands pairs of nodes; the interval of inner products between two
balls, a.c +- (|a| r_c + |c| r_a + r_a r_c), drops a whole group of anchors against a whole node
of candidates when it can't reach what the anchors already have, or lies above all they may take.
Pairs of leaves that are left are scored exactly, in integers.

What anchors already have comes from a few leaves with the anchors' own prefix, scored first.
Those are bounds only: every pair of leaves is then pruned by its interval or scored.

Defined results

* Rows with a null id, label or vector, or a null or non-finite component, take no part.
* Rows equal in id, label and vector are one row; another row is one with another id.
* Vectors are compared with vectors of their own length only.
* Of equal vectors with one label only the smallest ids can come first, so candidates keep as
  many of those as a list is long: copies cost no more than that, and no result changes.
* An anchor without positives, or a positive without rows in its interval, has no rows.
* A table without anchors or without rows gives none. Components beyond 2**27 are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.centroid_clusters import matrix, quantised, usable
from tallyglass.llm.common import picked, small_batches, table, written
from tallyglass.llm.vectors import distance, dot, first_by_row, met, pa_schema, partitions, products

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Rows that the axes are fitted on, rows of a leaf of candidates and of anchors, levels of a step.
SAMPLE_ROWS, LEAF, ANCHOR_LEAF, STEP = 2048, 1024, 128, 3
#: Leaves that are scored first, for bounds.
SEEDS = 8
#: Bits of a code.
MOST_BITS = 30
#: What the rounding of bounds may amount to, for each unit of their size.
SLACK = 1e-9
NONE = np.iinfo(np.int64).min

PACKED = "block long, dim int, code long, n int, ids binary, labels binary, vectors binary, center array<double>, radius double"


def axes(sample: list[list[int]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes of the most common length of the sample, and the medians along them."""
    sizes = [len(v) for v in sample]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    if not size:
        return np.zeros((0, 0)), np.zeros(0)
    x = np.array([v for v in sample if len(v) == size], np.float64)
    _, _, own = np.linalg.svd(x - x.mean(0), full_matrices=False)
    own = own[: min(bits, len(own))]
    return own, np.median(x @ own.T, axis=0)


def coded(rows: DataFrame, directions: np.ndarray, medians: np.ndarray) -> DataFrame:
    """Rows with ``_code``, the sides of the medians as bits; vectors of another length have code 0."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _code long"
    at = rows.columns.index("_v")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lengths = pa.compute.list_value_length(b.column(at)).to_numpy()
            code = np.zeros(b.num_rows, np.int64)
            fit = np.flatnonzero(lengths == directions.shape[1])
            if len(fit) and len(directions):
                sides = matrix(b.column(at).take(pa.array(fit))) @ directions.T > medians
                for bit in sides.T:
                    code[fit] = 2 * code[fit] + bit
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], [*b.schema.names, "_code"])

    return rows.mapInArrow(task, schema)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (_id, _label, _v, _code) as blocks of up to ``size`` rows of one length and code.

    Dealt by ranges of code and id, so a code that a third of the rows share is many tasks.
    """
    spark = rows.sparkSession
    target = pa_schema(spark, PACKED)
    dealt = rows.withColumn("_dim", F.size("_v")).repartitionByRange(partitions(spark), "_dim", "_code", "_id").sortWithinPartitions("_dim", "_code", "_id")
    dealt = dealt.select("_dim", "_code", "_id", "_label", "_v")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key = TaskContext.get().partitionId() << 33, None
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            number += 1
            center = x.mean(0)
            radius = math.sqrt(((x - center) ** 2).sum(1).max())
            return pa.RecordBatch.from_pydict({"block": [number], "dim": [key[0]], "code": [key[1]], "n": [len(ids)], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vectors": [x.astype(np.int32).tobytes()], "center": [center.tolist()], "radius": [radius]}, schema=target)

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            ids, labels = b.column(2).to_numpy(), b.column(3).to_numpy()
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                own = (int(keys[lo, 0]), int(keys[lo, 1]))
                if held and own != key:
                    yield block()
                key = own
                x = matrix(b.column(4).slice(lo, hi - lo)) if own[0] else np.zeros((hi - lo, 1), np.int64)
                while lo < hi:
                    take = min(hi - lo, size - sum(len(h[0]) for h in held))
                    held.append((ids[lo : lo + take], labels[lo : lo + take], x[:take]))
                    lo, x = lo + take, x[take:]
                    if sum(len(h[0]) for h in held) == size:
                        yield block()
        if held:
            yield block()

    return dealt.mapInArrow(task, PACKED)


def tree(blocks: DataFrame, bits: int, name: str) -> list[DataFrame]:
    """Levels from the root to the leaves: (dim, node, up, center, radius); leaves have their block as node.

    A node above the leaves is a prefix of the code; its ball has the weighted mean of the leaves'
    centres and holds their balls. All levels come from one pass over the leaves.
    """
    depths = sorted(range(bits, 0, -STEP)) if bits else []
    depths = [0, *depths]
    prefix = lambda d: F.shiftright("code", bits - d) if d else F.lit(0).cast("long")
    at = [F.struct(F.lit(k).alias("level"), prefix(d).alias("node"), (prefix(depths[k - 1]) if k else F.lit(-1).cast("long")).alias("up")) for k, d in enumerate(depths)]
    by = ["dim", "level", "node", "up"]
    own = blocks.select("dim", F.explode(F.array(*at)).alias("_at"), "n", "center", "radius").select("dim", "_at.*", "n", "center", "radius")
    mean = own.select(*by, "n", F.posexplode("center").alias("_i", "_c")).groupBy(*by, "_i").agg((F.sum(F.col("_c") * F.col("n")) / F.sum("n")).alias("_c"))
    mean = mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda s: s["_c"]).alias("_mean"))  # one entry a component
    above = own.join(mean, by).groupBy(*by).agg(F.any_value("_mean").alias("center"), (F.max(distance(F.col("center"), F.col("_mean")) + F.col("radius")) * (1 + SLACK) + SLACK).alias("radius"))
    leaves = blocks.select("dim", F.lit(len(depths)).alias("level"), F.col("block").alias("node"), F.col("code").alias("up"), "center", "radius")
    nodes = written(above.unionByName(leaves), name)
    return [nodes.where(F.col("level") == k).drop("level") for k in range(len(depths) + 1)]


def interval(a: str, c: str) -> tuple[Column, Column]:
    """Least and largest inner product between two balls, a little wider than exact."""
    at, ra, rc = dot(F.col(f"{a}center"), F.col(f"{c}center")), F.col(f"{a}radius"), F.col(f"{c}radius")
    size = lambda x: F.sqrt(dot(F.col(f"{x}center"), F.col(f"{x}center")))
    reach = size(a) * rc + size(c) * ra + ra * rc
    wide = 1 + SLACK * (F.abs(at) + reach)
    return at - reach - wide, at + reach + wide


def descended(anchors: list[DataFrame], candidates: list[DataFrame], bounds: DataFrame) -> DataFrame:
    """Pairs of leaves (ablock, cblock) whose interval meets what the anchors may still take.

    ``bounds``: (ablock, least, most) by leaf of anchors. Nodes above take the widest of those below.
    """
    limits, own = [], None
    for level in reversed(anchors):
        if own is None:
            own = level.join(bounds.select(F.col("ablock").alias("node"), "least", "most"), "node")
        else:
            below = own.groupBy("dim", F.col("up").alias("node")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
            own = level.join(below, ["dim", "node"])
        limits.append(own)
    sides = [[x.select("dim", *[F.col(c).alias(s + c) for c in x.columns if c != "dim"]) for x in levels] for s, levels in (("a_", limits[::-1]), ("c_", candidates))]
    pairs = sides[0][0].join(sides[1][0], "dim")  # the roots: one of each length
    for k in range(1, max(map(len, sides))):
        for s, levels in zip(("a_", "c_"), sides, strict=True):
            if k < len(levels):
                kept = [c for c in pairs.columns if not c.startswith(s)]
                pairs = pairs.withColumn("_from", F.col(f"{s}node")).select(*kept, "_from").join(levels[k].withColumn("_from", F.col(f"{s}up")), ["dim", "_from"]).drop("_from")
        low, high = interval("a_", "c_")
        pairs = pairs.where((high >= F.col("a_least")) & (low <= F.col("a_most")))
    return pairs.select(F.col("a_node").alias("ablock"), F.col("c_node").alias("cblock"))


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(r["vectors"], np.int32).reshape(r["n"], -1)
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), x


def _hits(s: np.ndarray, k: int, least: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``k`` entries of each row that are at least ``least``; NONE marks what may not count."""
    least = np.maximum(least, NONE + 1)
    if s.shape[1] > k:
        least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
    row, col = np.nonzero(s >= least[:, None])
    best = first_by_row(row, s[row, col], ids[col], k)
    return row[best], col[best]


def positive_task(k: int):
    def task(block: dict, ask: dict) -> Iterator[dict]:
        ids, labels, x = _unpacked(block)
        own, mine, a = _unpacked(ask)
        s = products(a, x)
        s[(labels[None] != mine[:, None]) | (ids[None] == own[:, None])] = NONE
        least = np.array(ask["floors"], np.int64) if ask["floors"] else np.full(len(own), NONE)
        row, col = _hits(s, k, least, ids)
        yield {"ablock": np.full(len(row), ask["ablock"]), "at": row.astype(np.int32), "anchor_id": own[row], "other_id": ids[col], "score": s[row, col]}

    return task


def limits(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest negative scores for positive scores: low * p <= 100 * n <= high * p, in longs."""
    q, r = np.divmod(score, 100)
    return low * q - (-low * r) // 100, high * q + high * r // 100


def negative_task(k: int, low: int, high: int):
    def task(block: dict, ask: dict) -> Iterator[dict]:
        ids, labels, x = _unpacked(block)
        own, mine, a = _unpacked(ask)
        at = np.array([p["at"] for p in ask["positives"]], np.int64)
        score = np.array([p["score"] for p in ask["positives"]], np.int64)
        least, most = limits(score, low, high)
        s = products(a, x)
        s[labels[None] == mine[:, None]] = NONE
        s[ids[None] == own[:, None]] = NONE
        s = s[at]
        s[(s < least[:, None]) | (s > most[:, None])] = NONE
        floors = np.array([NONE if p["floor"] is None else p["floor"] for p in ask["positives"]], np.int64)
        row, col = _hits(s, k, floors, ids)
        place = np.array([p["place"] for p in ask["positives"]], np.int32)
        positive = np.array([p["other_id"] for p in ask["positives"]], np.int64)
        yield {"ablock": np.full(len(row), ask["ablock"]), "at": at[row].astype(np.int32), "place": place[row], "anchor_id": own[at[row]], "positive_id": positive[row], "positive_score": score[row], "negative_id": ids[col], "negative_score": s[row, col]}

    return task


def _first(rows: DataFrame, by: list[str], score: str, ident: str, k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), ident)
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


FOUND = "ablock long, at int, anchor_id long, other_id long, score long"
MINED = "ablock long, at int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def mined(df: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, leaf: int = LEAF, anchor_leaf: int = ANCHOR_LEAF, seeds: int = SEEDS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``is_anchor``: a condition on ``_id``. ``label``: a column of ``df`` or an expression over it.
    """
    spark = df.sparkSession
    small_batches(spark)
    of = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), of.cast("long").alias("_label"), F.col(f"`{vector_column}`").alias("_x"))
    rows = rows.where("_id is not null and _label is not null").where(usable(F.col("_x"))).select("_id", "_label", quantised(F.col("_x"), scale).alias("_v"))
    rows = written(rows.groupBy("_id", "_label", "_v").agg(F.count("*").alias("_n")).drop("_n"), "quantised")
    copies = Window.partitionBy("_v", "_label").orderBy("_id")
    kept = rows.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= max(positives + 1, negatives)).drop("_c")

    sample = [r["_v"] for r in picked(rows, _v="_v", _id="_id").orderBy(F.xxhash64("_id"), "_v").limit(SAMPLE_ROWS).collect()]
    n = rows.count()
    bits = max(0, min(MOST_BITS, math.ceil(math.log2(max(n, 1) / leaf)))) if n else 0
    directions, medians = axes(sample, bits)
    bits = len(directions)
    cblocks = written(packed(coded(kept, directions, medians), leaf), "candidate-leaves")
    coarse = max(0, min(bits, math.floor(math.log2(max(n / 100 / anchor_leaf, 1)))))
    ablocks = written(packed(coded(rows.where(is_anchor), directions[:coarse], medians[:coarse]), anchor_leaf), "anchor-leaves")
    trees = [tree(b, k, f"{side}-nodes") for side, b, k in (("anchor", ablocks, coarse), ("candidate", cblocks, bits))]

    cpacked = cblocks.select(F.col("block").alias("cblock"), "n", "ids", "labels", "vectors")
    apacked = ablocks.select(F.col("block").alias("ablock"), "n", "ids", "labels", "vectors")
    first = cblocks.select("dim", F.shiftright("code", bits - coarse).alias("code"), F.col("block").alias("cblock"))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("dim", "code").orderBy("cblock"))).where(F.col("_r") <= seeds).drop("_r")
    seeded = written(ablocks.select("dim", "code", F.col("block").alias("ablock")).join(first, ["dim", "code"]).select("ablock", "cblock"), "seed-pairs")

    # positives: the k-th score among the seeds is a floor for each anchor, the least of a leaf's floors one for the leaf
    known = written(met(cpacked, seeded.join(apacked.withColumn("floors", F.lit(None).cast("array<long>")), "ablock"), ["cblock"], positive_task(positives), FOUND), "seed-positives")
    floors = _first(known, ["ablock", "at"], "score", "other_id", positives, "_r").where(F.col("_r") == positives).select("ablock", "at", F.col("score").alias("floor"))
    places = ablocks.select(F.col("block").alias("ablock"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    floors = places.join(floors, ["ablock", "at"], "left").groupBy("ablock").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("floor", F.lit(NONE)).alias("floor")))).alias("_f"))  # one entry an anchor of the leaf
    floors = written(floors.select("ablock", F.transform("_f", lambda s: s["floor"]).alias("floors")), "positive-floors")
    bounds = floors.select("ablock", F.array_min("floors").cast("double").alias("least"), F.lit(math.inf).alias("most"))
    pairs = descended(*trees, bounds)
    found = met(cpacked, pairs.join(apacked.join(floors, "ablock"), "ablock"), ["cblock"], positive_task(positives), FOUND)
    found = written(found, "positives")
    found = written(_first(found, ["ablock", "at"], "score", "other_id", positives, "place"), "first-positives")

    # negatives: the same search, each positive with its own interval
    listed = lambda rows: rows.groupBy("ablock").agg(F.collect_list(F.struct("at", "place", "other_id", "score", "floor")).alias("positives"))  # noqa: E731  at most positives x anchor_leaf entries
    begun = listed(found.withColumn("floor", F.lit(None).cast("long")))
    task = negative_task(negatives, low, high)
    known = written(met(cpacked, seeded.join(apacked.join(begun, "ablock"), "ablock"), ["cblock"], task, MINED), "seed-negatives")
    by = ["ablock", "at", "place"]
    floors = _first(known, by, "negative_score", "negative_id", negatives, "_r").where(F.col("_r") == negatives).select(*by, F.col("negative_score").alias("floor"))
    held = written(found.join(floors, by, "left"), "negative-floors")
    of_score = F.col("score")
    least = F.greatest(F.col("floor"), F.floor(of_score / 100 * low) - 1)
    bounds = held.groupBy("ablock").agg(F.min(least).cast("double").alias("least"), F.max(of_score / 100 * high + 1).alias("most"))
    pairs = descended(*trees, bounds)
    done = written(met(cpacked, pairs.join(apacked.join(listed(held), "ablock"), "ablock"), ["cblock"], task, MINED), "negatives")
    return _first(done, by, "negative_score", "negative_id", negatives, "rank").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ten hard negatives for each positive of every anchor of ``embeddings``."""
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0, label=own)


ORACLE = """
with v as materialized (
  select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.id a, b.id b, a.l = b.l same, list_inner_product(a.v, b.v)::bigint s from v a join v b on a.id % 100 = 0 and b.id <> a.id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a anchor_id, p.b positive_id, (row_number() over (partition by p.a, p.b order by s.s desc, s.b))::int rank, s.b negative_id, p.s positive_score, s.s negative_score
from p join s on p.a = s.a and not s.same and 30 * p.s <= 100 * s.s and 100 * s.s <= 90 * p.s
qualify rank <= 10
"""
