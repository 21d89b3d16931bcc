"""Centroid clustering of vectors on integers: weighted deduplication, then Lloyd rounds.

Identical quantised vectors are one row with their multiplicity, so a vector that a third of
the table repeats is one row of the rounds. Each round reads the distinct vectors once, assigns
each to its nearest centroid and adds up weighted integer sums by task; the driver gets one row
per centroid and component. The last assignment is joined back to the ids.

Defined results

* A vector takes part if it has exactly ``size`` components, none null or non-finite.
* A null id takes part with its vector and never starts a centroid; repeated rows count as
  often as they stand; rows of one id start in order of their vectors.
* With fewer rows than ``k`` there are fewer centroids; a table without rows gives none.
* On equal distances the smaller number wins; an empty centroid stays where it is.
* A component beyond 2**27 in size after scaling is an error, as distances would leave a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import picked, small_batches, table, written

SIZE, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest size of a scaled component: squared distances of 64 such components fit a long.
LARGEST = 1 << 27
#: Below this, sums of 64 products stay below 2**53 and a double holds them exactly.
EXACT_DOUBLE = 1 << 22


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector has no null or non-finite component, and ``size`` of them if given."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = vector.isNotNull() & fine
    return F.coalesce(fine & (F.size(vector) == size) if size else fine, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """array<int> of floor(scale * x), x as double."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    held = lambda x: F.when(F.abs(whole(x)) <= LARGEST, whole(x).cast("int")).otherwise(F.raise_error(F.lit("a scaled component is beyond 2**27")))
    return F.transform(vector, held)


def matrix(lists: pa.Array) -> np.ndarray:
    """The rows of a list array of equal lengths as a matrix of longs."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid (ties: the smaller) and the squared distance."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT_DOUBLE:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None]
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums) by task: multiplicities and weighted sums of the vectors nearest to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            if b.num_rows:
                x, w = matrix(b.column(0)), b.column(1).to_numpy()
                best, _ = nearest(x, centroids)
                order = np.argsort(best, kind="stable")
                found, first = np.unique(best[order], return_index=True)
                sums[found] += np.add.reduceat(x[order] * w[order, None], first, axis=0)
                n[found] += np.add.reduceat(w[order], first)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(own, pa.int32()), "n": pa.array(n[own]), "sums": pa.array(list(sums[own]), pa.list_(pa.int64()))})

    return distinct.mapInArrow(task, "cluster int, n long, sums array<long>")


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    parts = _sums(distinct, centroids).select("cluster", "n", F.posexplode("sums").alias("_at", "_s"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "_at").agg(F.sum("_s").alias("s"), F.sum("n").alias("n")).collect():  # k rows of a component each
        out[r["cluster"], r["_at"]] = r["s"] // r["n"]
    return out


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best, d = nearest(matrix(b.column(0)), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(d)], ["_v", "_w", "cluster", "distance"])

    return distinct.mapInArrow(task, "_v array<int>, _w long, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of every usable vector, and the centroids."""
    spark = df.sparkSession
    small_batches(spark)
    rows = picked(df, _id=id_column, _x=vector_column).where(usable(F.col("_x"), size)).select("_id", quantised(F.col("_x"), scale).alias("_v"))
    started = rows.where("_id is not null").select("_v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256).alias("_h"))
    centroids = np.array([r["_v"] for r in started.orderBy("_h", "_v").limit(k).collect()], np.int64).reshape(-1, size)
    none = "cluster int, distance long, cluster_inertia long, inertia long"
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {df.schema[id_column].dataType.simpleString()}, {none}"), centroids
    distinct = written(rows.groupBy("_v").agg(F.count("*").alias("_w")), "distinct-vectors")
    for _ in range(rounds):
        centroids = _moved(distinct, centroids)
    done = written(_assigned(distinct, centroids), "assigned-vectors")
    by = done.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("_w")).alias("cluster_inertia"))  # k rows at most
    total = done.agg(F.sum(F.col("distance") * F.col("_w")).alias("inertia"))  # one row
    back = rows.join(done.drop("_w"), "_v").join(F.broadcast(by), "cluster").join(F.broadcast(total), F.lit(True))
    return back.select(F.col("_id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia"), centroids


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of ``embeddings`` in one of 40 clusters after 5 rounds."""
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    named = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle() -> str:
    """The rounds one after another, each as a pair of table expressions."""
    near = "(select v.id, v.v, arg_min(c.k, (list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.c) + list_inner_product(c.c, c.c), c.k)) k, min(list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.c) + list_inner_product(c.c, c.c)) d from vectors v, c{r} c group by v.id, v.v)"
    parts = [
        f"vectors as materialized (select vec_id id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) v from embeddings where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {SIZE})",
        f"c0 as materialized (select (row_number() over (order by sha256('{SEED}:' || id)) - 1)::int k, v c from vectors qualify k < {K})",
    ]
    for r in range(ROUNDS):
        parts.append(f"a{r} as materialized {near.format(r=r)}")
        parts.append(f"s{r} as (select k, i, floor(sum(v[i]) / count(*)) x from a{r}, range(1, {SIZE + 1}) t(i) group by k, i)")
        parts.append(f"c{r + 1} as materialized (select c.k, coalesce(n.c, c.c) c from c{r} c left join (select k, list(x order by i) c from s{r} group by k) n using (k))")
    parts.append(f"done as materialized {near.format(r=ROUNDS)}")
    names = f"names as (select k, sha256(array_to_string(list_transform(c, lambda x: x::bigint::varchar), ',')) h from c{ROUNDS})"
    return f"with {', '.join([*parts, names])} select id vec_id, k as \"cluster\", d::bigint as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256 from done join names using (k)"


ORACLE = _oracle()
