"""Line-first quality rules: judge lines, drop those that fail, then judge the document.

A line with a word fails if
* it is navigation: symbols of ``[#*$%&|<>]`` or the marks » · • number more than a tenth of its
  words, or it has at most three words and doesn't end in punctuation;
* its punctuation is off: exclamation marks number more than a tenth of its words beyond one,
  or it has twenty letters or more and no lower-case one;
* it is boilerplate: it holds one of the phrases in BOILERPLATE.
What is left is the cleaned text. A document is rejected if it fails the base rules (under 50
words, or more than half of its words in repeated 3-word windows) or if the lines that go hold
more than half of its word characters.

Everything is computed within a row from arrays: no shuffle, no Python.

Defined results: null, empty and blank texts have no words and fail; a line equal to an earlier
one counts as duplicate; repeated rows are judged each; input columns named as results give way to
them, all others come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import opened, sealed, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
NAVIGATION = r"[#*$%&|<>»·•]"
#: Word characters that failed lines may hold, in hundredths.
MOST_LOST = 50
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Phrases of boilerplate lines, lower case.
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|uses cookies|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|click here|subscribe to our|sign up for|powered by|skip to (main )?content)"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: str, packed: str, bits: str) -> Column:
    """Words in 3-word windows found twice or more, from the sorted packed window hashes.

    ``packed`` holds for every window its hash in the high bits and its place in the low
    ``bits``, sorted. Equal windows are neighbours; the words themselves confirm it.
    """
    pairs = F.expr(
        f"""filter(sequence(1, size({packed}) - 1), k ->
              shiftrightunsigned(get({packed}, k - 1) ^ get({packed}, k), {bits}) = 0
              and get({words}, int(get({packed}, k - 1) & (shiftleft(1L, {bits}) - 1))) = get({words}, int(get({packed}, k) & (shiftleft(1L, {bits}) - 1)))
              and get({words}, int(get({packed}, k - 1) & (shiftleft(1L, {bits}) - 1)) + 1) = get({words}, int(get({packed}, k) & (shiftleft(1L, {bits}) - 1)) + 1)
              and get({words}, int(get({packed}, k - 1) & (shiftleft(1L, {bits}) - 1)) + 2) = get({words}, int(get({packed}, k) & (shiftleft(1L, {bits}) - 1)) + 2))"""
    )
    return F.when(F.size(packed) >= 2, pairs).otherwise(F.array().cast("array<int>"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _words, _lines and the base counts n_words .. n_repeat_words."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumn("_text", t).withColumns({"_words": words_of(F.col("_text")), "_lines": F.split("_text", "\n")})
    out = out.withColumn("_lines", F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_bits", F.length(F.bin("n_words")))
    # hash in the high bits, place in the low ones: a primitive sort brings equal windows together
    packed = F.expr("""transform(sequence(0, size(_words) - 3), i ->
        shiftleft(xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)), _bits) | i)""")
    out = out.withColumn("_packed", F.when(F.size("_words") >= 4, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_pairs", repeated_words("_words", "_packed", "_bits"))
    at = F.expr("""array_union(
        transform(_pairs, k -> get(_packed, k) & (shiftleft(1L, _bits) - 1)),
        transform(_pairs, k -> get(_packed, k - 1) & (shiftleft(1L, _bits) - 1)))""")
    out = out.withColumn("_at", F.when(F.size("_pairs") > 0, at).otherwise(F.array().cast("array<bigint>")))
    covered = F.expr("size(array_union(array_union(_at, transform(_at, x -> x + 1)), transform(_at, x -> x + 2)))")
    out = out.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("_at") > 0, covered).otherwise(0).cast("long"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_bits", "_packed", "_pairs", "_at")


#: What ``judged`` adds; input columns of these names give way.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "n_lines_removed", "lost_chars", "kept")


def line_fails(line: Column) -> Column:
    """True for a line (with a word) that a rule removes."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    navigation = (F.regexp_count(line, F.lit(NAVIGATION)) * 10 > n) | ((n <= 3) & ~line.rlike(r"\p{P}[\x20\x09-\x0D]*$"))
    shouted = (F.regexp_count(line, F.lit("!")) - 1) * 10 > n
    upper = ~line.rlike(r"\p{Ll}") & line.rlike(r"(?:\P{Lu}*\p{Lu}){20}")
    return navigation | shouted | upper | line.rlike(BOILERPLATE)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, cleaned (text), n_lines_removed, lost_chars and kept."""
    out = measured(sealed(docs).select("_in", F.col("_in").getField(text).alias("_raw")), "_raw")
    out = out.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x)))
    out = out.withColumns(
        {
            "cleaned": F.array_join("_good", "\n"),
            "n_lines_removed": (F.size("_lines") - F.size("_good")).cast("long"),
            "lost_chars": (F.col("word_chars") - F.length(F.regexp_replace(F.array_join("_good", ""), SPACE, ""))).cast("long"),
        }
    )
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MOST_LOST)
    own = [c for c in docs.columns if c not in RESULTS or c == text]
    return opened(out, own, **{c: kept if c == "kept" else F.col(c) for c in RESULTS if c != text})


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars")
