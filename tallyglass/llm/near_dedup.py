"""MinHash near-duplicate detection with b-bit signatures.

1. Every text becomes its set of distinct 2-word shingles (ASCII lower case). Texts with equal
   sets form one class; only its document of smallest id goes on, so exact copies cost nothing.
2. Each class gets ``bands * rows`` minima. Their low ``BITS`` bits are packed into a signature;
   each band of minima gives a bucket key. At similarity 0.8 a pair misses all buckets with a
   probability of ``(1 - 0.8**rows) ** bands`` = 1.3e-7.
3. In each bucket every member is paired with one representative only, so a bucket of n members
   makes n - 1 pairs. Pairs pass when the collision-corrected estimate from the counts of equal
   b-bit groups can belong to a similarity of 0.8 (six standard errors), then when the full
   shingle sets say so exactly. Links merge classes into components; the next round takes other
   representatives and looks only at buckets that still hold several components.
   Rounds go on as long as they link a fair share of the pairs they make.
4. Then the members of buckets that still hold several components are compared across them: the
   smaller components of a bucket against all of it. Both sides are dealt into groups of about
   BLOCK members, and each pair of groups is a block of its own with its texts, so that a task
   holds two groups at a time however large the bucket is, and only links leave it. A pair is
   compared in its first common bucket. So no link between different texts is lost, and pairs
   that aren't linked are never written out.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; one
word is a single shingle; repeated rows of a doc_id count as one document (the first text by
order of its hash) for linking and all come back; a null doc_id forms a component of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm.common import dropped, keyed, remember_only, remembers, small_batches, table, written

BANDS, ROWS = 40, 5
#: Low bits kept of each minimum: two of 32.
BITS = 2
PERMUTATIONS = BANDS * ROWS
WORDS64 = PERMUTATIONS * BITS // 64 + bool(PERMUTATIONS * BITS % 64)
#: Words of a shingle, unless a caller names another length.
SHINGLE = 2
#: Words of a shingle in the pipeline's stage.
STAGE_SHINGLE = 5
#: Similarity as a fraction, compared in integers.
NUMERATOR, DENOMINATOR = 80, 100
#: Rounds with other representatives go on while one pair in so many is linked, and end here.
LEAST_YIELD, ROUNDS = 20, 8
#: Members of a bucket on each side of a block, about: a larger bucket is dealt over several.
BLOCK = 1024
#: Tables of ids of up to so many rows (16 MB) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
REMEMBERED_WORDS = 200_000

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


_HASHES = _WordHashes()
remembers("near_dedup", _HASHES.clear)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; one of fewer words is one shingle."""
    words = text.encode("utf-8").lower().split() if text else []  # bytes: ASCII case and white space
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(shingle, len(h))
    out = h[: len(h) - n + 1] if n else h
    for j in range(1, n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of non-empty sets: a row of PERMUTATIONS 32-bit values each."""
    out = np.empty((len(sets), PERMUTATIONS), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 32_768):
            size += len(sets[hi])
            hi += 1
        x = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(PERMUTATIONS):
            np.bitwise_xor(x, _XOR[k], out=y)
            np.multiply(y, _MUL[k], out=y)
            np.right_shift(y, 15, out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0x85EBCA6B), out=y)
            out[lo:hi, k] = np.minimum.reduceat(y, starts)
        lo = hi
    return out


def _band_keys(minima: np.ndarray) -> np.ndarray:
    h = np.zeros((len(minima), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS].astype(np.uint64))
    return h.view(np.int64)


def _packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 // BITS to a word; bit planes lie in even and odd places."""
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    out = np.zeros((len(minima), WORDS64), np.uint64)
    each = 64 // BITS
    for k in range(PERMUTATIONS):
        out[:, k // each] |= low[:, k] << np.uint64(k % each * BITS)
    return out.view(np.int64)


_SKETCH = T.StructType(
    [
        T.StructField("_id", T.LongType()),
        T.StructField("_th", T.LongType()),
        T.StructField("_n", T.LongType()),
        T.StructField("_fp1", T.LongType()),
        T.StructField("_fp2", T.LongType()),
        T.StructField("_bits", T.ArrayType(T.LongType(), False)),
        T.StructField("_keys", T.ArrayType(T.LongType(), False)),
    ]
)


def _sketched(batches: Iterator[pd.DataFrame], shingle: int = SHINGLE) -> Iterator[pd.DataFrame]:
    remember_only("near_dedup")
    for df in batches:
        sets = [shingle_set(t, shingle) for t in df["_text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        minima = signatures([sets[i] for i in full])
        bits, keys = [[]] * len(sets), [[]] * len(sets)
        for i, b, k in zip(full, _packed(minima), _band_keys(minima), strict=True):
            bits[i], keys[i] = b, k
        with np.errstate(over="ignore"):
            yield pd.DataFrame(
                {
                    "_id": df["_id"].astype("Int64"),
                    "_th": df["_th"],
                    "_n": [len(s) for s in sets],
                    "_fp1": [int(_mixed(s).sum().view(np.int64)) for s in sets],
                    "_fp2": [int(_mixed(s ^ np.uint64(0xA0761D6478BD642F)).sum().view(np.int64)) for s in sets],
                    "_bits": bits,
                    "_keys": keys,
                }
            )


def estimated(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: share of equal b-bit groups, corrected for chance.

    Two unequal minima agree in BITS bits by chance with probability 2**-BITS.
    """
    differ = F.lit(0)
    low = 0x5555555555555555
    for k in range(WORDS64):
        x = F.element_at(a, k + 1).bitwiseXOR(F.element_at(b, k + 1))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(low)))
    equal = 1 - differ / F.lit(float(PERMUTATIONS))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


#: Six standard errors below 0.8: of the share of equal groups at that similarity, corrected.
_E = 0.8 + 0.2 * 2.0**-BITS
LEAST_ESTIMATE = 0.8 - 6 * (_E * (1 - _E) / PERMUTATIONS) ** 0.5 / (1 - 2.0**-BITS)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Pairs (_a, _b) whose full shingle sets reach the similarity. ``texts`` has _id, _text."""
    one = texts.select(F.col("_id").alias("_b"), F.col("_text").alias("_tb"))
    two = texts.select(F.col("_id").alias("_a"), F.col("_text").alias("_ta"))
    both = pairs.join(one, "_b").join(two, "_a").select("_a", "_b", "_ta", "_tb")

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, of_last = None, np.zeros(0, np.uint64)
        for a, ta, tb in batches:
            out = []
            for x, p, q in zip(a, ta, tb, strict=True):
                if x != last:
                    last, of_last = x, shingle_set(p, shingle)
                s = shingle_set(q, shingle)
                both = len(np.intersect1d(of_last, s, assume_unique=True))
                out.append(DENOMINATOR * both >= NUMERATOR * (len(of_last) + len(s) - both))
            yield pd.Series(out, dtype=bool)

    return both.where(similar("_a", "_ta", "_tb")).select("_a", "_b")


def components(links: DataFrame) -> DataFrame:
    """(_id, _comp) for every end of a link: _comp is the smallest id reachable.

    Alternating large-star and small-star rounds until the edges are stars: every node has one
    edge, to a node that has none. Minima are grouped in partial sums first and written, so that
    a hub of many links is split where its edges are joined to them.
    """
    spark = links.sparkSession
    edges = written(links.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).where("_u <> _v").distinct(), "edges")
    while True:
        # large star: the larger neighbours of a node move to the least of node and neighbours
        both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = written(both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m")), "least")
        large = both.where("_v > _u").join(least, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).where("_u <> _v").distinct()
        large = written(large, "edges")
        # small star: a node and its smaller neighbours move to the least of them
        small_least = written(large.groupBy("_u").agg(F.min("_v").alias("_m"), F.count("*").alias("_c")), "least")
        single = small_least.where("_c > 1").isEmpty()
        if single and large.join(small_least.select(F.col("_u").alias("_v")), "_v", "left_semi").isEmpty():
            return large.select(F.col("_u").alias("_id"), F.col("_v").alias("_comp")).unionByName(large.select(F.col("_v").alias("_id"), F.col("_v").alias("_comp")).distinct())
        joined = large.join(small_least, "_u")
        small = joined.select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).unionByName(small_least.select("_u", F.col("_m").alias("_v")))
        small = written(small.where("_u <> _v").distinct(), "edges")
        for done in (edges, least, large, small_least):
            dropped(spark, done)
        edges = small


def _labelled(nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return nodes.withColumn("_comp", F.col("_id"))
    return nodes.join(comps, "_id", "left").withColumn("_comp", F.coalesce("_comp", "_id"))


def _estimate_passes(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs that can reach the similarity by their sizes and by the estimate."""
    a = near.select(F.col("_id").alias("_a"), F.col("_bits").alias("_ba"), F.col("_n").alias("_na"))
    b = near.select(F.col("_id").alias("_b"), F.col("_bits").alias("_bb"), F.col("_n").alias("_nb"))
    sizes = F.least("_na", "_nb") * DENOMINATOR >= F.greatest("_na", "_nb") * NUMERATOR
    return pairs.join(b, "_b").join(a, "_a").where(sizes & (estimated(F.col("_ba"), F.col("_bb")) >= LEAST_ESTIMATE)).select("_a", "_b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: _id, _n (set size), component_id."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"), F.xxhash64(F.col(f"`{text}`")).alias("_th"))
    spark = docs.sparkSession
    sketches = written(source.mapInPandas(partial(_sketched, shingle=shingle), _SKETCH), "sketches")
    # classes of equal sets: the document of smallest id stands for all
    one = sketches.where("_n > 0 and _id is not null").groupBy("_id").agg(F.min(F.struct("_th", "_n", "_fp1", "_fp2")).alias("_f")).select("_id", "_f.*")
    one = written(one, "ids")
    heads = written(one.groupBy("_n", "_fp1", "_fp2").agg(F.min(F.struct("_id", "_th")).alias("_h")).select("_n", "_fp1", "_fp2", F.col("_h._id").alias("_head"), F.col("_h._th").alias("_th")), "heads")
    firsts = heads.select(F.col("_head").alias("_id"), "_th")
    sigs = written(sketches.select("_id", "_th", "_n", "_bits", "_keys").join(firsts, ["_id", "_th"]).dropDuplicates(["_id"]), "signatures")
    # only buckets of several classes matter
    by_key = sigs.select("_id", F.explode("_keys").alias("_key"))
    full = written(by_key.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1").select("_key"), "full")
    members = written(by_key.join(full, "_key"), "members")
    wanted = written(members.select("_id").distinct().join(firsts, "_id"), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = written(source.join(few, ["_id", "_th"]).dropDuplicates(["_id"]).select("_id", "_text"), "texts")
    near = written(sigs.join(wanted.select("_id"), "_id").select("_id", "_n", "_bits", "_keys"), "near")

    links, comps = None, None
    across = False
    for turn in range(ROUNDS + 1):
        labelled = _labelled(members, comps)
        order = F.col("_id") if turn == 0 else F.xxhash64(F.lit(turn), "_id", "_key")
        reps = labelled.groupBy("_key").agg(F.min(F.struct(order.alias("o"), "_id", "_comp")).alias("_rep"), F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi"))
        reps = written(reps.where("_lo <> _hi").select("_key", F.col("_rep._id").alias("_a"), F.col("_rep._comp").alias("_ca")), "reps")
        if reps.isEmpty():
            break
        if across:
            got, made = written(_across(labelled.join(reps.select("_key"), "_key"), near, texts, shingle), "links"), 0
        else:
            pairs = labelled.join(reps, "_key").where("_comp <> _ca").select(F.col("_id").alias("_b"), "_a").distinct()
            pairs = written(_estimate_passes(pairs, near), "pairs")
            got, made = written(confirmed(pairs, texts, shingle), "links"), pairs.count()
        found = got.count()
        if found:
            links = got if links is None else links.unionByName(got)
        if across:
            break
        across = turn + 2 > ROUNDS or found * LEAST_YIELD < made
        if found and not across:
            comps = written(components(links), "components")
    if links is not None:
        comps = written(components(links), "components")
    dropped(spark, sigs, full, members, wanted, texts, near)

    # back to all documents: class head, then its component
    ids = one.join(heads.drop("_th"), ["_n", "_fp1", "_fp2"]).select("_id", "_head")
    if comps is not None:
        ids = ids.join(comps.select(F.col("_id").alias("_head"), "_comp"), "_head", "left").select("_id", F.coalesce("_comp", "_head").alias("_comp"))
    else:
        ids = ids.select("_id", F.col("_head").alias("_comp"))
    out = sketches.select("_id", "_n").join(written(ids, "ids"), "_id", "left")
    return out.select("_id", "_n", F.when(F.col("_n") > 0, F.coalesce("_comp", "_id")).otherwise(F.col("_id")).alias("component_id"))


def _across(labelled: DataFrame, near: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links (_a, _b) between the components of a bucket, one at least for each two that are linked."""
    sizes = labelled.groupBy("_key", "_comp").agg(F.count("*").alias("_c"))
    tops = sizes.groupBy("_key").agg(F.max(F.struct("_c", "_comp")).alias("_m"), F.sum("_c").alias("_all"))
    dealt = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    tops = tops.select("_key", F.col("_m._comp").alias("_top"), dealt(F.col("_all")).alias("_g"), dealt(F.col("_all") - F.col("_m._c")).alias("_r"))
    rows = labelled.join(written(tops, "tops"), "_key").withColumn("_rest", F.col("_comp") != F.col("_top"))
    # all members are one side, those outside of the largest component the other
    group = lambda n, salt: F.pmod(F.xxhash64("_id", F.lit(salt)), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.withColumns({"_j": group("_g", 1), "_left": F.lit(False)}).withColumn("_i", all_("_r"))
    left = rows.where("_rest").withColumns({"_i": group("_r", 2), "_left": F.lit(True)}).withColumn("_j", all_("_g"))
    columns = ["_key", "_i", "_j", "_left", "_id", "_comp", "_rest"]
    rows = written(left.select(*columns).unionByName(right.select(*columns)), "blocks")
    rows = rows.join(near, "_id").join(texts, "_id").repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j", "_id")
    return rows.select(*columns, "_n", "_bits", "_keys", "_text").mapInPandas(partial(_block_links, shingle=shingle), "_a long, _b long").distinct()


def _block_links(batches: Iterator[pd.DataFrame], shingle: int = SHINGLE) -> Iterator[pd.DataFrame]:
    """Rows sorted by block to the links within each block; a block may span batches."""
    held: list[pd.DataFrame] = []
    now = None

    def links() -> pd.DataFrame:
        return pd.DataFrame(_links_of(pd.concat(held, ignore_index=True), shingle), columns=["_a", "_b"])

    for df in batches:
        if not len(df):
            continue
        own = [df[c].to_numpy() for c in ("_key", "_i", "_j")]
        cut = np.concatenate([[0], np.flatnonzero(np.any([np.diff(c) != 0 for c in own], axis=0)) + 1, [len(df)]]).tolist()
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            block = tuple(c[lo] for c in own)
            if held and block != now:
                yield links()
                held = []
            now = block
            held.append(df.iloc[lo:hi])
    if held:
        yield links()


def _links_of(block: pd.DataFrame, shingle: int = SHINGLE) -> list[tuple[int, int]]:
    key = block["_key"].iloc[0]
    ids, comps, n = (block[c].to_numpy(np.int64) for c in ("_id", "_comp", "_n"))
    is_left, rest = block["_left"].to_numpy(bool), block["_rest"].to_numpy(bool)
    left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    if not len(left) or not len(right):
        return []
    bits = np.stack(block["_bits"].to_numpy()).view(np.uint64)
    keys = np.stack(block["_keys"].to_numpy())
    band = int((keys[0] == key).argmax())
    low = np.uint64(0x5555555555555555)
    chance = 2.0**-BITS
    texts = block["_text"].to_numpy()
    sets: dict[int, np.ndarray] = {}

    def of(i: int) -> np.ndarray:
        at = int(ids[i])
        if at not in sets:
            sets[at] = shingle_set(texts[i], shingle)
        return sets[at]

    out = []
    for i in left.tolist():
        r = right[(comps[right] != comps[i]) & (np.minimum(n[right], n[i]) * DENOMINATOR >= np.maximum(n[right], n[i]) * NUMERATOR)]
        r = r[~rest[r] | (ids[r] > ids[i])]  # two of the rest meet twice
        if band and len(r):
            r = r[~(keys[r, :band] == keys[i, :band]).any(1)]  # an earlier common bucket has compared them
        if len(r):
            x = bits[r] ^ bits[i]
            differ = np.bitwise_count((x | x >> np.uint64(1)) & low).sum(1)
            r = r[((1 - differ / PERMUTATIONS) - chance) / (1 - chance) >= LEAST_ESTIMATE]
        if not len(r):
            continue
        mine, others = of(i), [of(j) for j in r.tolist()]
        every = np.concatenate(others)
        at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        both = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))
        linked = r[DENOMINATOR * both >= NUMERATOR * (n[i] + n[r] - both)]
        _, firsts = np.unique(comps[linked], return_index=True)  # one link to each component will do
        out += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in linked[firsts].tolist()]
    return out


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies, by five words, stays (the smallest id).

    A document without an id gets one of its text for this; such rows of one text stay together.
    """
    own = keyed(F.col("doc_id"), F.col("text"))
    found = near_duplicates(docs.select(own.alias("_own"), "text"), "_own", shingle=STAGE_SHINGLE)
    gone = written(found.where("_id <> component_id").select(F.col("_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, own == gone["_gone"], "left_anti")
