"""Nearest neighbours by inner product over a forest of long hash strings.

Index. Every distinct vector gets one string of 48 bits a tree: sides of orthogonal random
directions, after the component that makes all vectors of a band of lengths equally long (so the
largest inner product is the smallest angle). Each tree is one sorted array of all its strings,
written as blocks of consecutive entries with their vectors.

Search. Each query first descends in every tree to its longest prefix match: the block that holds
its place, and in it the shortest prefix with at least 256 entries. The 21st score found so far
bounds the result from below. A vector at that score shares a prefix of x bits with the query in
one tree with probability p**x, where p = 1 - angle / pi; so the query ascends in all trees at
once, to the longest prefixes under which such a vector would escape all trees with a probability
of at most ``miss``, and is compared with everything below them. What is below those prefixes is
scored whole: nothing is capped, and a prefix of no bits is the whole array.

Bounds. A query on clustered vectors reads a few blocks a tree; on vectors without neighbours at
any distance it reads most of the array, as the stated recall then needs. Blocks and queries are
dealt by block, and by a part of the queries where more than 65,536 could meet at one.

Defined results

* Vectors that are null, empty, all zero, or hold a null or non-finite component take no part,
  and neither do rows with a null id. Rows equal in id and vector are one row.
* Vectors are compared with vectors of their own length only.
* A query's own id is no candidate of it; with fewer candidates than ``k`` all are returned.
* Equal vectors are one entry with their ``k + 1`` smallest ids, which is all that a list can hold.
* Scores are sums of products in double precision, the same for equal vectors; ties go to the
  smaller id. Components beyond 1e150 leave the range of such sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.centroid_clusters import usable
from tallyglass.llm.common import small_batches, table, written
from tallyglass.llm.vectors import pa_schema, partitions

K, TREES, BITS, MISS, SEED = 20, 10, 48, 0.05, 13
#: Entries of a block, entries that a descent compares at least, queries that meet a block in one task.
BLOCK, LEAST, MEET = 4096, 256, 65536
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
#: Queries scored at once.
AT_ONCE = 64

PACKED = "dim int, band int, tree int, block long, first long, last long, n int, keys binary, entries binary, vectors binary"


@lru_cache(maxsize=64)
def directions(size: int, tree: int, bits: int, seed: int = SEED) -> np.ndarray:
    """Random directions of one tree, orthogonal as far as there are dimensions."""
    rng = np.random.default_rng([seed, tree, size])
    parts = [np.linalg.qr(rng.standard_normal((size, size)))[0].T for _ in range(math.ceil(bits / size))]
    return np.concatenate(parts)[:bits]


def strings(x: np.ndarray, tree: int, bits: int, longest: float | None) -> np.ndarray:
    """Hash strings as longs, the first bit highest. ``longest``: length that candidates are brought to."""
    if longest is None:
        extra = np.zeros((len(x), 1))
    else:
        extra = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]
    sides = np.concatenate([x, extra], 1) @ directions(x.shape[1] + 1, tree, bits).T > 0
    out = np.zeros(len(x), np.int64)
    for bit in sides.T:
        out = 2 * out + bit
    return out


def doubles(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _planted(distinct: DataFrame, longest: dict[tuple[int, int], float] | None, trees: int, bits: int) -> DataFrame:
    """(_g, dim, band, _x) to one row a tree: (dim, band, tree, key, _g, _x)."""
    kind = distinct.schema["_x"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
            for own in np.unique(key, axis=0):
                part = b.take(pa.array(np.flatnonzero((key == own).all(1))))
                x = doubles(part.column(3))
                for t in range(trees):
                    h = strings(x, t, bits, longest[tuple(own.tolist())] if longest else None)
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(np.full(len(h), t, np.int32)), pa.array(h), part.column(0), part.column(3)], ["dim", "band", "tree", "key", "_g", "_x"])

    return distinct.select("_g", "dim", "band", "_x").mapInArrow(task, f"dim int, band int, tree int, key long, _g long, _x {kind}")


def _blocks(planted: DataFrame, size: int) -> DataFrame:
    """The sorted arrays, cut into blocks of ``size`` consecutive entries of one tree."""
    spark = planted.sparkSession
    order = ["dim", "band", "tree", "key", "_g"]
    dealt = planted.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(*order, "_x")
    single = dealt.schema["_x"].dataType.simpleString() == "array<float>"
    target = pa_schema(spark, PACKED)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = TaskContext.get().partitionId() << 33, None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            keys, entries, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            number += 1
            row = {"dim": own[0], "band": own[1], "tree": own[2], "block": number, "first": int(keys[0]), "last": int(keys[-1]), "n": len(keys), "keys": keys.tobytes(), "entries": entries.tobytes(), "vectors": x.astype(np.float32 if single else np.float64).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=target)

        for b in batches:
            if not b.num_rows:
                continue
            part = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            cuts = (np.flatnonzero((part[1:] != part[:-1]).any(1)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if held and own != tuple(part[lo].tolist()):
                    yield block()
                own = tuple(part[lo].tolist())
                keys, entries, x = b.column(3).to_numpy()[lo:hi], b.column(4).to_numpy()[lo:hi], doubles(b.column(5).slice(lo, hi - lo))
                while len(keys):
                    take = size - sum(len(h[0]) for h in held)
                    held.append((keys[:take], entries[:take], x[:take]))
                    keys, entries, x = keys[take:], entries[take:], x[take:]
                    if sum(len(h[0]) for h in held) == size:
                        yield block()
        if held:
            yield block()

    return dealt.mapInArrow(task, PACKED)


def _ranges(keys: np.ndarray, key: np.ndarray, level: np.ndarray | None, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query key the entries below its prefix of ``level`` bits; without levels, of the longest prefix with ``least`` entries."""
    if level is not None:
        shift = bits - level.astype(np.int64)
        low = (key >> shift) << shift
        return np.searchsorted(keys, low), np.searchsorted(keys, low + (np.int64(1) << shift))
    lo, hi = np.zeros(len(key), np.int64), np.full(len(key), len(keys))
    open_ = np.arange(len(key))
    for shift in range(bits + 1):  # from the whole string upwards: descend as far as enough entries match
        low = (key[open_] >> shift) << shift
        a, b = np.searchsorted(keys, low), np.searchsorted(keys, low + (np.int64(1) << shift))
        done = b - a >= least
        lo[open_[done]], hi[open_[done]] = a[done], b[done]
        open_ = open_[~done]
        if not len(open_):
            break
    return lo, hi


def scored(x: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the first ``k`` entries in each query's range that reach its floor, ties at the end included."""
    rows, cols = [], []
    for start in range(0, len(q), AT_ONCE):
        own = slice(start, start + AT_ONCE)
        a, b = int(lo[own].min()), int(hi[own].max())
        if a >= b:
            continue
        s = q[own] @ x[a:b].T
        at = np.arange(a, b)[None]
        s[(at < lo[own, None]) | (at >= hi[own, None])] = -np.inf
        near = 1e-12 * (1 + np.abs(np.where(np.isfinite(s), s, 0)).max(1))  # the order of sums in a product of matrices is open
        least = floor[own] - near
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - near)
        r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        rows.append(r + start)
        cols.append(c + a)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, col = np.concatenate(rows), np.concatenate(cols)
    return row, col, (q[row] * x[col]).sum(1)


FOUND = "_q long, _g long, score double"


def _met(blocks: DataFrame, asks: DataFrame, bits: int, k: int, n_queries: int, single: bool) -> DataFrame:
    """Every ask (block, _q, key, level, floor, _x) scored in its block: (_q, _g, score), entries of several trees repeated."""
    parts = math.ceil(n_queries / MEET)
    asks = asks.select("block", F.pmod(F.xxhash64("_q"), F.lit(parts)).alias("_part"), F.lit(1).alias("_kind"), "_q", "key", "level", "floor", "_x")
    held = F.struct("n", "keys", "entries", "vectors").alias("_held")
    kinds = asks.withColumn("_held", F.lit(None).cast(blocks.select(held).schema["_held"].dataType))
    own = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"), F.lit(0).alias("_kind"), held)
    both = kinds.unionByName(own, allowMissingColumns=True).repartition(partitions(blocks.sparkSession), "block", "_part").sortWithinPartitions("block", "_part", "_kind", "key")
    both = both.select("block", "_part", "_kind", "_q", "key", "level", "floor", "_x", "_held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = entries = x = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column(2).to_numpy()
            starts = np.flatnonzero(kind == 0)
            cuts = np.unique(np.concatenate([[0], starts, starts + 1]))
            cuts = cuts[cuts < b.num_rows].tolist()
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if kind[lo] == 0:
                    r = b.column(8)[lo].as_py()
                    keys, entries = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["entries"], np.int64)
                    x = np.frombuffer(r["vectors"], np.float32 if single else np.float64).reshape(r["n"], -1).astype(np.float64)
                    continue
                part = b.slice(lo, hi - lo)
                q, key = doubles(part.column(7)), part.column(4).to_numpy()
                level = None if part.column(5).null_count else part.column(5).to_numpy()
                floor = part.column(6).to_numpy()
                row, col, score = scored(x, q, *_ranges(keys, key, level, bits, LEAST), floor, k)
                fine = score >= floor[row]
                yield pa.RecordBatch.from_arrays([pa.array(part.column(3).to_numpy()[row[fine]]), pa.array(entries[col[fine]]), pa.array(score[fine])], ["_q", "_g", "score"])

    return both.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), "_g")
    return found.groupBy("_q", "_g").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)


def aimed(asks: DataFrame, trees: int, bits: int, miss: float) -> DataFrame:
    """With ``level``: the first ``_n`` trees ascend to prefixes of ``_level`` bits, the others stop a bit before.

    A candidate at the query's floor escapes all of them with a probability of ``miss`` at most; a
    query without a floor ascends to the top. ``_reach``: the query's length times the longest candidate's.
    """
    cosine = F.least(F.greatest(F.col("floor") / F.col("_reach"), F.lit(-1.0)), F.lit(1.0))
    out = asks.withColumn("_p", 1 - F.acos(cosine) / math.pi)
    share = math.log(1 - miss ** (1 / trees))  # what one tree has to find
    level = F.when(F.col("_p") >= 1, bits).when(F.col("_p") > 0, F.least(F.floor(share / F.log("_p")), F.lit(bits)))
    out = out.withColumn("_level", F.coalesce(level.cast("int"), F.lit(0)))
    gone = lambda x: F.log(F.greatest(1 - F.pow(F.col("_p"), x), F.lit(1e-300)))
    out = out.withColumns({"_gone": gone(F.col("_level")), "_later": gone(F.col("_level") + 1)})
    n = F.ceil((math.log(miss) - trees * F.col("_later")) / F.nullif(F.col("_gone") - F.col("_later"), F.lit(0.0)))
    out = out.withColumn("_n", F.coalesce(F.when((F.col("_level") > 0) & (F.col("_level") < bits), n), F.lit(trees)))
    return out.withColumn("level", F.when(F.col("tree") < F.col("_n"), F.col("_level")).otherwise(F.col("_level") + 1).cast("int"))


def neighbours(df: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, trees: int = TREES, bits: int = BITS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of all rows that meet ``is_query``, a condition on ``_id``, against all rows."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{vector_column}`").alias("_x"))
    rows = rows.where(F.col("_id").isNotNull() & usable(F.col("_x"))).where(F.exists("_x", lambda x: x != 0))
    rows = rows.groupBy("_id", "_x").agg(F.count("*").alias("_n")).drop("_n")
    single = rows.schema["_x"].dataType.simpleString() == "array<float>"
    length = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    copies = Window.partitionBy("_x").orderBy("_id")
    kept = rows.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= k + 1)
    distinct = kept.groupBy("_x").agg(F.array_sort(F.collect_list("_id")).alias("_ids"))  # k + 1 at most
    distinct = distinct.select("_x", "_ids", F.element_at("_ids", 1).alias("_g"), F.size("_x").alias("dim"), length.alias("_length"))
    distinct = written(distinct.withColumn("band", F.floor(F.log2("_length") + 0.5).cast("int")), "distinct-vectors")
    bands = distinct.groupBy("dim", "band").agg(F.max("_length").alias("longest"), F.count("*").alias("n"))
    known = bands.collect()  # a row for each length of vectors and power of two
    longest = {(r["dim"], r["band"]): r["longest"] for r in known}
    cell_bits = max(0, min(20, math.ceil(math.log2(max([1, *[r["n"] for r in known]]) / block))))
    forest = written(_blocks(_planted(distinct, longest, trees, bits), block), "forest", BATCH_ROWS, BATCH_BYTES)

    asked = rows.where(is_query)
    own = asked.join(distinct.select("_x", "_g"), "_x").select("_id", "_g")
    sought = asked.select("_x").distinct().join(distinct.select("_x", "_g", "dim", "_length"), "_x")
    n_queries = max(1, sought.count())
    place = sought.select("_g", "dim", F.lit(0).alias("band"), "_x", "_length")
    hashed = _planted(place, None, trees, bits).drop("band").join(place.select("_g", "_length"), "_g")
    of_bands = spark.createDataFrame([(*k, v) for k, v in longest.items()], "dim int, band int, longest double")
    asks = written(hashed.join(F.broadcast(of_bands), "dim").withColumnRenamed("_g", "_q"), "hashed-queries", BATCH_ROWS, BATCH_BYTES)

    # descend: the block of the place in each array
    by = ["dim", "band", "tree"]
    cell = lambda c: F.shiftright(c, bits - cell_bits)
    order = Window.partitionBy(*by).orderBy("first", "block")
    spans = forest.select(*by, "block", "first", "last", F.coalesce(F.lead("first").over(order), F.lit(1 << bits)).alias("_end"), F.row_number().over(order).alias("_k"))
    spans = spans.withColumn("_start", F.when(F.col("_k") == 1, 0).otherwise(F.col("first")))
    reached = spans.where("_start < _end").withColumn("_cell", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end") - 1))))
    first = asks.withColumn("_cell", cell(F.col("key"))).join(reached.select(*by, "_cell", "block", "_start", "_end"), [*by, "_cell"]).where("_start <= key and key < _end")
    first = first.select("block", "_q", "key", F.lit(None).cast("int").alias("level"), F.lit(-math.inf).alias("floor"), "_x")
    found = written(_met(forest, first, bits, k + 1, n_queries, single), "descended", BATCH_ROWS, BATCH_BYTES)
    floors = _best(found, k + 1).groupBy("_q").agg(F.min(F.when(F.col("_r") == k + 1, F.col("score"))).alias("floor"))

    # ascend in all trees at once
    reach = F.col("_length") * F.col("longest")
    wide = asks.join(floors, "_q", "left").withColumn("_reach", reach)
    wide = wide.where(F.coalesce(F.col("floor") <= F.col("_reach") * (1 + 1e-9), F.lit(True)))  # else the band is too short to reach the floor
    wide = aimed(wide, trees, bits, miss).select("_q", *by, "key", "level", "floor", "_x")
    wide = written(wide, "aimed-queries", BATCH_ROWS, BATCH_BYTES)
    shift = F.lit(bits) - F.col("level")
    wide = wide.withColumn("_low", F.call_function("shiftleft", F.call_function("shiftright", F.col("key"), shift), shift)).withColumn("_high", F.col("_low") + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1)
    wide = wide.withColumn("_from", cell(F.col("_low"))).withColumn("_cell", F.explode(F.sequence(F.col("_from"), cell(F.col("_high")))))
    lying = forest.select(*by, "block", "first", "last").withColumn("_cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("last")))))
    pairs = wide.join(lying, [*by, "_cell"]).where("first <= _high and last >= _low").where(F.col("_cell") == F.greatest("_from", cell(F.col("first"))))
    pairs = pairs.select("block", "_q", "key", "level", F.coalesce("floor", F.lit(-math.inf)).alias("floor"), "_x")
    more = written(_met(forest, pairs, bits, k + 1, n_queries, single), "ascended", BATCH_ROWS, BATCH_BYTES)

    best = _best(found.unionByName(more), k + 1).join(distinct.select("_g", "_ids"), "_g")
    best = best.select(F.col("_q").alias("_g"), "score", F.explode("_ids").alias("vec_id"))
    out = own.join(best, "_g").where(F.col("vec_id") != F.col("_id"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("_id", "_g").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    return out.select(F.col("_id").alias("query_id"), "rank", "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` for each row whose id is divisible by 20."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)
