"""The data-quality gate of chunks: issue codes, rates, review samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import SPACE, contains_any, held, let, strip, token_estimate, word_count
from tallyglass.operators import narrative_rules as R
from tallyglass.operators.chunking import _digit_share
from tallyglass.operators.dedup import first_of_each


ISSUES = ("template_marker", "budget_marker", "table_marker", "table_like", "too_short", "too_long", "missing_citation_metadata", "low_confidence")


def _flat(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _flat), lambda x: x != "")


def line_table_score(text: Column) -> Column:
    """Share of lines that look like cells: markers, digits, short lines with $ or %, or very short ones."""

    def scored(lines: Column) -> Column:
        n = F.size(lines)
        cell = lambda x: contains_any(x, R.QA_TABLE + R.QA_SOFT_TABLE) | (_digit_share(x) > 0.22) | ((x.contains("$") | x.contains("%")) & (word_count(x) <= 14)) | ((n >= 5) & (word_count(x) <= 3))
        return F.when(n == 0, 1.0).otherwise(F.size(F.filter(lines, cell)) / n)

    return let(_lines(text), scored)


def body(chunks: DataFrame) -> Column:
    """The body text of a chunk, or its search text if that is empty."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("body_text", "search_text") if c in chunks.columns]
    return F.coalesce(*parts, F.lit(""))


def _markers(text: Column) -> Column:
    """All markers that the text holds, whatever white space parts their words; one that lacks the longest word of each holds none."""
    every = tuple(dict.fromkeys(R.QA_TEMPLATE + R.QA_TABLE + R.QA_SOFT_TABLE + R.QA_BUDGET))
    longest = sorted({max(t.split(), key=len) for t in every})
    return F.when(contains_any(text, longest), held(_flat(text), every)).otherwise(F.array().cast("array<string>"))


def with_issues(chunks: DataFrame, scores: bool = True) -> DataFrame:
    """Chunks with issues (array), table_score and the markers found.

    Budget markers count only beside a table issue, table-like lines only beside table or form markers.
    Without ``scores`` only texts whose issues hang on the score get one; all issues are the same.
    """
    rows = chunks.withColumn("_b", body(chunks)).withColumn("_found", _markers(F.col("_b")))
    some = lambda terms: F.array_intersect(F.array(*[F.lit(t) for t in terms]), "_found")
    wanted = lambda c: c if scores else F.when(F.size("_found") > 0, c)
    rows = rows.withColumns({"table_score": wanted(line_table_score(F.col("_b"))), "_n": wanted(F.size(_lines(F.col("_b")))), "template_markers": some(R.QA_TEMPLATE), "all_table_markers": some(R.QA_TABLE), "soft_table_markers": some(R.QA_SOFT_TABLE), "budget_markers": some(R.QA_BUDGET)})
    rows = rows.withColumn("_hits", F.filter("all_table_markers", lambda m: (m != "contributing actions table") | (F.col("table_score") >= 0.2)))
    template, table = F.size("template_markers") > 0, F.size("_hits") > 0
    like = (F.col("_n") >= 4) & (F.col("table_score") >= 0.42)
    budget = (F.size("budget_markers") > 0) & (like | table)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0")
    codes = (
        ("template_marker", template),
        ("budget_marker", budget),
        ("table_marker", table),
        ("table_like", like & (table | template)),
        ("too_short", token_estimate("_b") < R.QA_MIN_TOKENS),
        ("too_long", token_estimate("_b") > R.QA_MAX_TOKENS),
        ("missing_citation_metadata", blank("district") | blank("section_path") | blank("page_start")),
        ("low_confidence", F.coalesce("authored_confidence", F.lit(0.0)) < 0.75),
    )
    return rows.withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in codes]))).drop("_b", "_n", "_hits", "_found")


def issue_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with an issue as report rows."""
    rows = with_issues(chunks).where(F.size("issues") > 0)
    joined = lambda c, out: F.array_join(c, ";").alias(out)
    return rows.select("chunk_id", "district", "section_type", joined("issues", "issues"), joined("template_markers", "template_markers"), joined("all_table_markers", "table_markers"), joined("soft_table_markers", "soft_table_markers"), joined("budget_markers", "budget_markers"), F.round("table_score", 3).alias("table_score"), F.left(_flat(body(rows)), F.lit(500)).alias("snippet"))


def hard(issues: str = "issues") -> Column:
    return F.arrays_overlap(issues, F.array(*[F.lit(x) for x in R.HARD_ISSUES]))


def summary(chunks: DataFrame, most_bad: float = R.MOST_BAD, most_table: float = R.MOST_TABLE) -> DataFrame:
    """One row of counts and rates, and whether the gate passes."""
    rows = with_issues(chunks, scores=False)
    n = F.count("*")
    some = F.sum(F.when(F.size("issues") > 0, 1).otherwise(0))
    bad = F.sum(F.when(hard(), 1).otherwise(0))
    tables = F.sum(F.when(F.array_contains("issues", "table_marker"), 1).otherwise(0))
    out = rows.agg(n.alias("chunks"), F.countDistinct("district").alias("districts"), F.coalesce(some, F.lit(0)).alias("issue_chunk_count"), F.coalesce(bad, F.lit(0)).alias("hard_issue_chunk_count"), F.coalesce(tables, F.lit(0)).alias("_t"))
    rate = lambda c: F.col(c) / F.greatest(F.col("chunks"), F.lit(1))
    passes = (rate("hard_issue_chunk_count") <= most_bad) & (rate("_t") <= most_table)
    return out.select("chunks", "districts", "issue_chunk_count", "hard_issue_chunk_count", F.round(rate("issue_chunk_count"), 4).alias("bad_rate"), F.round(rate("hard_issue_chunk_count"), 4).alias("hard_bad_rate"), F.round(rate("_t"), 4).alias("table_like_rate"), passes.alias("pass"))


def issue_counts(chunks: DataFrame) -> DataFrame:
    # a generator over the issues would have them made twice, once more for the filter that Spark puts before it
    counts = with_issues(chunks, scores=False).select("issues").agg(*[F.count(F.when(F.array_contains("issues", k), 1)).alias(k) for k in ISSUES])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in ISSUES])).alias("_x")).select("_x.*")
    return rows.where("n > 0").orderBy(F.col("n").desc(), "issue")


def wanted_signals(chunks: DataFrame) -> DataFrame:
    found = held(_flat(body(chunks)), R.WANTED_SIGNALS)
    return chunks.select(F.explode(found).alias("signal")).groupBy("signal").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "signal")


def review_sample(chunks: DataFrame, per_bucket: int = 3, order: str = "chunk_id") -> DataFrame:
    return first_of_each(chunks, ["district", "section_type"], per_bucket, [order])


def without_chunks(extracted: DataFrame, chunks: DataFrame) -> DataFrame:
    return extracted.join(chunks.select("cds_code"), "cds_code", "left_anti")
