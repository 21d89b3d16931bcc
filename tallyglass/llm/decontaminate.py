"""Benchmark decontamination: short test items inside long documents, by containment.

Words are lower-cased runs of letters, marks and digits; a shingle is five words (an item of
fewer words is one shingle as a whole). An item is found in a document that holds 80 of 100 or
more of its distinct shingles.

The index is partitioned by item size: items of 2**(c-1)+1 to 2**c shingles form partition c,
whose MinHash sketch keeps the ``sketch_size`` smallest hashes of each item. One such minimum
lies in a matching document with probability 0.8 or more, so a match escapes all k of them with
at most 0.2**k; where the partition's items can miss fewer than k shingles, it can't escape.
The sketch is on the item's side only: the signature of a document of 20,000 words has a
similarity under 0.002 to an item of 30, and no banding of both sides finds that. So documents
are probed with all their shingle hashes. Candidates are confirmed by the exact containment of
the shingles themselves (strings, not hashes).

Defined results: null and empty texts contain nothing; an item without words matches nothing;
repeated rows of a doc_id (or item_id) count once; a null id is left out of the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import keyed, table, written

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
#: Minima an item keeps at most: 0.2**9 = 5e-7.
MOST_MINIMA = 9
#: The index is broadcast up to so many rows of 24 bytes (48 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _hash_at(words: str, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(F.col(words), i + k) for k in range(n)])


def _hashes(words: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: _hash_at(words, i, n))


def _string_shingles(words: str, n: Column) -> Column:
    """Distinct shingles of n words each as strings; none if there are fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(F.col(words), i, n), " ")))).otherwise(F.array().cast("array<string>"))


def sketch_size(partition: Column) -> Column:
    """Minima of each item of the partition whose items have up to 2**partition shingles."""
    upper = F.pow(F.lit(2.0), partition)
    may_miss = F.floor(upper * (DENOMINATOR - NUMERATOR) / DENOMINATOR)
    return F.least(may_miss + 1, F.lit(MOST_MINIMA)).cast("int")


def item_index(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """_item, _len (words of a shingle), _shingles, _partition, _minima for each item with words."""
    own = items.select(F.col(f"`{item_id}`").alias("_item"), words_of(F.col(f"`{text}`")).alias("_words"))
    own = own.where("_item is not null").groupBy("_item").agg(F.min("_words").alias("_words")).where(F.size("_words") > 0)
    own = own.withColumn("_len", F.least(F.size("_words"), F.lit(SHINGLE)))
    own = own.withColumn("_shingles", _string_shingles("_words", F.col("_len")))
    own = own.withColumn("_partition", F.ceil(F.log2(F.size("_shingles"))).cast("int"))
    hashed = F.lit(None).cast("array<bigint>")
    for n in range(1, SHINGLE + 1):
        hashed = F.when(F.col("_len") == n, _hashes("_words", n)).otherwise(hashed)
    own = own.withColumn("_minima", F.slice(F.array_sort(F.array_distinct(hashed)), F.lit(1), sketch_size(F.col("_partition"))))
    return own.drop("_words")


def found_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """_doc, _item, n_shared, n_item for every item contained in a document."""
    index = written(item_index(items, item_id, item_text), "items")
    source = docs.select(F.col(f"`{doc_id}`").alias("_doc"), words_of(F.col(f"`{text}`")).alias("_words")).where("_doc is not null")
    minima = index.select("_item", "_len", F.explode("_minima").alias("_h"))
    size = minima.count()
    lengths = sorted(r[0] for r in index.select("_len").distinct().collect())  # five values at most
    probes = None
    for n in lengths:
        found = source.where(F.size("_words") >= n).select("_doc", "_words", F.explode(F.sequence(F.lit(0), F.size("_words") - n)).alias("_i"))
        found = found.select("_doc", _hash_at("_words", F.col("_i"), n).alias("_h"))
        own = minima.where(F.col("_len") == n).select("_item", "_h")
        found = found.join(F.broadcast(own) if size <= BROADCAST_ROWS else own, "_h").select("_doc", "_item")
        probes = found if probes is None else probes.unionByName(found)
    if probes is None:
        probes = source.where(F.lit(False)).select("_doc", F.lit(None).cast(index.schema["_item"].dataType).alias("_item"))
    candidates = written(probes.distinct(), "candidates")
    wanted = candidates.select("_doc").distinct()
    texts = source.join(wanted, "_doc", "left_semi")
    pairs = candidates.join(texts, "_doc").join(index.select("_item", "_len", "_shingles"), "_item")
    shared = F.size(F.array_intersect("_shingles", _string_shingles("_words", F.col("_len"))))
    out = pairs.select("_doc", "_item", shared.cast("long").alias("n_shared"), F.size("_shingles").cast("long").alias("n_item"))
    out = out.groupBy("_doc", "_item").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return out.where(F.col("n_shared") * DENOMINATOR >= F.col("n_item") * NUMERATOR)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("_doc").alias("doc_id"), F.col("_item").alias("item_id"), "n_shared", "n_item")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go, those without an id too."""
    own = keyed(F.col("doc_id"), F.col("text"))
    found = found_items(docs.select(own.alias("_own"), "text"), table(spark, sf_dir, "benchmark"), "_own")
    found = written(found.select(F.col("_doc").alias("_gone")).distinct(), "found")
    return docs.join(found, own == found["_gone"], "left_anti")


ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') w from documents),
i as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') w from benchmark),
i2 as (select item_id, w, least(len(w), 5) m from i where len(w) > 0),
s as (select distinct item_id, m, array_to_string(w[k:k + m - 1], ' ') s from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) k from i2)),
n as (select item_id, count(*) n_item from s group by item_id),
ds as (select distinct doc_id, m, array_to_string(w[k:k + m - 1], ' ') s from (
    select doc_id, w, m, unnest(range(1, len(w) - m + 2)) k from d, (select distinct m from i2) where len(w) >= m)),
c as (select doc_id, item_id, count(*) n_shared from ds join s using (m, s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_item from c join n using (item_id) where 100 * n_shared >= 80 * n_item
"""
