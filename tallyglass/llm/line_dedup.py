"""Cross-site line deduplication by the spread of a line over distinct sites.

1. Lines (white space trimmed at both ends) are hashed to 96 bits and reduced to distinct pairs of
   line and site, in partial aggregation. So a line that a third of all rows hold is dealt out by
   its sites, and counts as many rows from here on as it has sites. One aggregation finds the lines
   on two sites or more: smallest and largest site hash differ.
2. For those, a HyperLogLog sketch of sites per line is built in partial aggregation and merged.
3. Lines whose estimate lies near the threshold (four standard errors and one site to either
   side) get an exact distinct count; the others are decided by the estimate.
4. Lines on MIN_SITES sites or more are boilerplate and are removed from every document, unless
   that would take more than half of a document's characters: such a document is a copy of a
   text that itself is widely spread, which is the near-duplicate operator's business. With
   ``only_copies`` such a document is spared only if MinHash bands over its lines link it with
   another one; all others lose their boilerplate whatever its share.

Defined results: null texts stay null, have no lines and lose none; blank lines are never
boilerplate; a null source is a site of its own; repeated rows each lose the same lines. Input
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import dropped, opened, sealed, table, written

MIN_SITES = 10
#: Bands and minima of each that tell copies by their lines: 1 - (1 - 0.8**6)**16 = 0.99.
BANDS, ROWS = 16, 6
LG_CONFIG_K = 11
#: Standard error of the sketch: 1.04 / sqrt(2**11).
ERROR = 1.04 / (1 << LG_CONFIG_K) ** 0.5
#: Hundredths of its characters that a document may lose, unless only copies are spared.
MOST_LOST = 50
#: Key tables of up to so many rows (20 bytes each) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _bounded(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast only if it is small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _lines(rows: DataFrame) -> DataFrame:
    """_k1, _k2 (document), _site, _i (place), _h1, _h2 (line) of lines with a word. ``rows`` has _row, _text, _source."""
    rows = rows.select(
        F.xxhash64("_row").alias("_k1"),
        F.hash("_row").alias("_k2"),
        F.xxhash64(F.coalesce(F.col("_source"), F.lit("\0"))).alias("_site"),
        F.posexplode(F.split("_text", "\n")).alias("_i", "_raw"),
    )
    rows = rows.withColumn("_line", F.trim("_raw", F.lit(" \t\n\x0b\f\r")))
    return rows.where("_line <> ''").select("_k1", "_k2", "_site", "_i", F.xxhash64("_line").alias("_h1"), F.hash("_line").alias("_h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (_h1, _h2) of the lines on ``min_sites`` distinct sites or more."""
    by = ["_h1", "_h2"]
    pairs = written(lines.select(*by, "_site").distinct(), "pairs")
    spread = pairs.groupBy(*by).agg(F.min("_site").alias("_lo"), F.max("_site").alias("_hi"))
    spread = written(spread.where("_lo <> _hi").select(*by), "spread")
    shared = pairs.join(_bounded(spread), by)
    sketches = shared.groupBy(*by).agg(F.hll_sketch_agg("_site", LG_CONFIG_K).alias("_sketch"))
    estimates = written(sketches.select(*by, F.hll_sketch_estimate("_sketch").alias("_est")), "estimates")
    width = 4 * ERROR * min_sites + 1
    near = written(estimates.where(F.abs(F.col("_est") - min_sites) <= width).select(*by), "near")
    exact = pairs.join(_bounded(near), by).groupBy(*by).agg(F.count("*").alias("_n"))
    sure = estimates.where(F.col("_est") > min_sites + width).select(*by)
    out = written(sure.unionByName(exact.where(F.col("_n") >= min_sites).select(*by)), "boilerplate")
    dropped(lines.sparkSession, pairs, spread, estimates, near)
    return out


def _copies(docs: DataFrame) -> DataFrame:
    """Ids (_copy) of the documents (_id, _text) whose lines are nearly those of another one.

    MinHash over the distinct lines: documents of equal lines share every band of minima, those
    of 0.8 of their lines in common one band at least with a probability of 0.99.
    """
    trimmed = F.transform(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")))
    hashed = F.transform(F.array_distinct(F.filter(trimmed, lambda x: x != "")), lambda x: F.xxhash64(x))
    rows = docs.where("_id is not null").select(F.col("_id").cast("long").alias("_id"), hashed.alias("_lines")).where(F.size("_lines") > 0)
    minima = F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda k: F.array_min(F.transform("_lines", lambda h: F.xxhash64(h, k))))
    rows = written(rows.withColumn("_minima", minima).select("_id", F.xxhash64("_minima").alias("_sig"), "_minima"), "minima")
    # documents of equal minima are one class: a group of exact copies is one row from here on
    classes = written(rows.groupBy("_sig").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.min("_minima").alias("_minima")), "classes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("_minima", b * ROWS + 1, ROWS)))
    keys = written(classes.select("_sig", F.explode(bands).alias("_key")), "bands")
    several = keys.groupBy("_key").agg(F.min("_sig").alias("_lo"), F.max("_sig").alias("_hi")).where("_lo <> _hi").select("_key")
    linked = keys.join(several, "_key").select("_sig").unionByName(classes.where("_lo <> _hi").select("_sig")).distinct()
    out = written(rows.select("_id", "_sig").join(linked, "_sig").select(F.col("_id").alias("_copy")).distinct(), "copies")
    dropped(docs.sparkSession, rows, classes, keys)
    return out


def deduplicated(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", min_sites: int = MIN_SITES, only_copies: bool = False, most_lost: int = MOST_LOST) -> DataFrame:
    """``docs`` with the text cleaned, and n_lines, n_removed (lines with a word)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed") or c == text]
    at = lambda c: F.col("_in").getField(c)
    rows = sealed(docs).select("_in", at(doc_id).alias("_doc"), at(text).alias("_text"), at(site).alias("_source"), F.struct(at(doc_id), at(text)).alias("_row"))
    lines = _lines(rows)
    keys = boilerplate(lines, min_sites)
    hits = lines.join(_bounded(keys), ["_h1", "_h2"]).groupBy("_k1", "_k2").agg(F.collect_set("_i").alias("_at"))
    hits = written(hits, "hits")
    found = rows.withColumns({"_k1": F.xxhash64("_row"), "_k2": F.hash("_row")}).join(hits, ["_k1", "_k2"], "left").select("_in", "_doc", "_text", "_at")
    split = F.split("_text", "\n")
    found = found.withColumn("_split", F.when(F.col("_at").isNotNull(), split))
    found = found.withColumn("_stay", F.when(F.col("_at").isNotNull(), F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), "_at"))))
    found = found.withColumn("_clean", F.array_join(F.transform("_stay", lambda i: F.get(F.col("_split"), i)), "\n"))
    enough = F.coalesce(100 * F.length("_clean") >= (100 - most_lost) * F.length("_text"), F.lit(False))
    if only_copies:
        heavy = found.where(F.col("_at").isNotNull() & ~enough)
        copies = _copies(written(heavy.select(F.col("_doc").alias("_id"), "_text"), "heavy"))
        found = found.join(copies, F.col("_doc").cast("long") == F.col("_copy"), "left")
        enough = F.col("_at").isNotNull() & (enough | F.col("_copy").isNull())
    n_lines = F.coalesce(F.size(F.filter(split, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")
    n_removed = F.when(enough, F.size("_at")).otherwise(0).cast("long")
    clean = F.when(enough, F.col("_clean")).otherwise(F.col("_text"))
    return opened(found, own, **{text: clean} | {k: v for k, v in (("n_lines", n_lines), ("n_removed", n_removed)) if k != text})


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: boilerplate lines leave the texts (n_chars follows); every document stays, and so do all its other columns."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_whole")
    out = deduplicated(docs.select("doc_id", "text", "source", others), only_copies=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*[new.get(c, F.col("_whole").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
w as (select *, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) line from l),
b as (select line from w where line <> '' group by line having count(distinct coalesce(source, chr(0))) >= 10),
c as (select w.doc_id, count(*) filter (where w.line <> '') n_lines, count(b.line) n_removed,
        string_agg(raw, chr(10) order by i) filter (where b.line is null) clean
      from w left join b on b.line = w.line group by w.doc_id),
d as (select doc_id, text, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, coalesce(clean, '') clean,
        coalesce(n_removed, 0) > 0 and 2 * length(coalesce(clean, '')) >= length(text) enough
      from documents left join c using (doc_id))
select doc_id, n_lines, case when enough then n_removed else 0 end n_removed,
  length(case when enough then clean else text end) n_chars, md5(case when enough then clean else text end) text_md5 from d
"""
