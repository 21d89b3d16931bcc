"""Search over chunks: BM25, exact and sparse vector search, reciprocal rank fusion, caps, cohorts."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.text import like_pattern, query_tokens

K1, B = 1.2, 0.75
#: The floor of the inverse document frequency.
LEAST_IDF = 1e-6
RRF_K = 60
FILTER_FIELDS = ("county", "district", "cds_code", "school_year", "section_type", "chunk_kind", "goal_number")


def parsed_filters(given: dict[str, object] | str | None) -> dict[str, object]:
    """Filters given as a dict, as JSON text of one, or not at all."""
    if not given:
        return {}
    found = json.loads(given) if isinstance(given, str) else given
    if not isinstance(found, dict):
        raise ValueError("filters must be an object")
    return found


def filters(values: dict[str, object], skip_patterns: bool = False) -> list[Column]:
    """Equalities on the known fields; a district with ``*`` is a pattern, or is skipped on request."""
    out = []
    for field in FILTER_FIELDS:
        value = values.get(field)
        if value is None or value == "":
            continue
        if "*" in str(value):
            if skip_patterns:
                continue
            if field == "district":
                out.append(like_pattern(field, str(value)))
                continue
        out.append(F.col(field) == value)
    if sections := values.get("section_types"):
        out.append(F.col("section_type").isin(*sections))
    return out


def filtered(chunks: DataFrame, values: dict[str, object] | None = None, cohort: DataFrame | None = None, skip_patterns: bool = False) -> DataFrame:
    """Chunks that pass the filters and belong to the cohort; an empty cohort filters nothing."""
    for f in filters(values or {}, skip_patterns):
        chunks = chunks.where(f)
    if cohort is None:
        return chunks
    # one row tells whether the cohort has members: an empty one lets all chunks pass
    none = cohort.limit(1).agg((F.count("*") == 0).alias("_none"))
    inside = cohort.select("cds_code").distinct().withColumn("_in", F.lit(True))
    rows = chunks.join(inside, "cds_code", "left").join(F.broadcast(none), F.lit(True))
    return rows.where(F.col("_in") | F.col("_none")).drop("_in", "_none")


def tokens(*texts: Column) -> Column:
    """array<string> of the lower-cased words of letters, digits of all texts in turn."""
    parts = [F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}\p{Mn}]+"), lambda x: x != "") for t in texts]
    return F.concat(*parts)


def postings(chunks: DataFrame, columns: Iterable[str] = ("search_text", "district", "section_type")) -> DataFrame:
    """(term, chunk_id, tf, n) where n is the number of words of the chunk over all columns."""
    rows = chunks.select("chunk_id", tokens(*[F.col(c) for c in columns]).alias("_t"))
    rows = rows.select("chunk_id", F.size("_t").alias("n"), F.explode("_t").alias("term"))
    return rows.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("n").alias("n"))


def phrase_hits(words: Column, phrase: list[str]) -> Column:
    """How often a phrase of words occurs in an array of words."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - len(phrase) + 1, F.lit(1)))
    found = F.filter(at, lambda i: F.array_join(F.slice(words, i, len(phrase)), " ") == " ".join(phrase))
    return F.when(F.size(words) >= len(phrase), F.size(found)).otherwise(0)


def bm25(chunks: DataFrame, query: str, limit: int, columns: Iterable[str] = ("search_text", "district", "section_type"), values: dict[str, object] | None = None, cohort: DataFrame | None = None, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """The best chunks for a query: chunk_id, bm25_score (lower is better), bm25_rank.

    Statistics are those of the whole corpus; filters act on the matches. A hyphenated term is a
    phrase of its words. The scan is one pass: terms are counted in the row, then two small sums.
    """
    terms = list(dict.fromkeys(query_tokens(query)))
    phrases = [[w for w in t.replace("_", "-").split("-") if w] for t in terms]
    if not phrases:
        return chunks.select("chunk_id", F.lit(0.0).alias("bm25_score"), F.lit(0).alias("bm25_rank")).where(F.lit(False))
    words = tokens(*[F.col(c) for c in columns])
    words = words if stem is None else F.transform(words, stem)
    counted = chunks.withColumn("_w", words)
    counted = counted.withColumns({f"_f{k}": phrase_hits(F.col("_w"), p) for k, p in enumerate(phrases)} | {"_n": F.size("_w")}).drop("_w")
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.sum(F.when(F.col(f"_f{k}") > 0, 1).otherwise(0)).alias(f"_d{k}") for k in range(len(phrases))])
    rows = filtered(counted, values, cohort).where(" or ".join(f"_f{k} > 0" for k in range(len(phrases))))
    rows = rows.join(F.broadcast(stats), F.lit(True))  # one row
    length = 1 - B + B * F.col("_n") / F.col("_avg")
    score = F.lit(0.0)
    for k in range(len(phrases)):
        idf = F.log((F.col("_docs") - F.col(f"_d{k}") + 0.5) / (F.col(f"_d{k}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        tf = F.col(f"_f{k}").cast("double")
        score = score - idf * tf * (K1 + 1) / (tf + K1 * length)
    best = rows.select("chunk_id", score.alias("bm25_score")).orderBy("bm25_score", "chunk_id").limit(limit)
    return ranked(best, "bm25_rank", F.col("bm25_score").asc(), F.col("chunk_id").asc())


def ranked(best: DataFrame, name: str, *order: Column) -> DataFrame:
    """Ranks from 1 of an already limited result: at most a page of rows."""
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 less the cosine; the query's norm is computed once, here."""
    norm = math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((own > 0) & F.lit(norm > 0), 1 - dot / (own * norm))


def dense(embeddings: DataFrame, query: list[float], limit: int, chunks: DataFrame | None = None, values: dict[str, object] | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """The nearest chunks by exact cosine distance: chunk_id, dense_distance, dense_rank."""
    rows = embeddings.select("chunk_id", cosine_distance(F.col("embedding"), query).alias("dense_distance")).where("dense_distance is not null")
    if chunks is not None:
        rows = rows.join(filtered(chunks, values, cohort, skip_patterns=True).select("chunk_id"), "chunk_id", "left_semi")
    best = rows.orderBy("dense_distance", "chunk_id").limit(limit)
    return ranked(best, "dense_rank", F.col("dense_distance").asc(), F.col("chunk_id").asc())


def sparse(weights: DataFrame, query: dict[str, float], limit: int) -> DataFrame:
    """The best chunks by the dot product of sparse term weights (chunk_id, term, weight)."""
    known = F.create_map(*[F.lit(x) for kv in query.items() for x in (kv[0], float(kv[1]))])
    rows = weights.where(F.col("term").isin(*query)).groupBy("chunk_id").agg(F.sum(F.col("weight") * F.element_at(known, F.col("term"))).alias("sparse_score"))
    return ranked(rows.orderBy(F.col("sparse_score").desc(), "chunk_id").limit(limit), "sparse_rank", F.col("sparse_score").desc(), F.col("chunk_id").asc())


def rrf(lists: list[tuple[DataFrame, str]], k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """Rank lists fused: chunk_id, rrf_score = sum of weight / (k + rank); missing ranks add nothing."""
    parts = None
    for (df, rank), w in zip(lists, weights or [1.0] * len(lists), strict=True):
        own = df.select("chunk_id", (F.lit(float(w)) / (F.lit(float(k)) + F.col(rank))).alias("_s"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("chunk_id").agg(F.sum("_s").alias("rrf_score")).orderBy(F.col("rrf_score").desc(), "chunk_id")


def rrf_joined(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """Two rank lists as one row per chunk with both signals (bm25_* and dense_*) and rrf_score."""
    rows = first.join(second, "chunk_id", "full")
    part = lambda c: F.coalesce(1.0 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return rows.withColumn("rrf_score", part("bm25_rank") + part("dense_rank")).orderBy(F.col("rrf_score").desc(), "chunk_id")


def capped(scored: DataFrame, group: str, n: int, score: str = "rrf_score") -> DataFrame:
    """The n best rows of each group (n is clamped to 1..5)."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), "chunk_id")
    return scored.withColumn("group_rank", F.row_number().over(order)).where(F.col("group_rank") <= max(1, min(n, 5)))


def reranked(scored: DataFrame, scorer: Callable[[list[dict]], dict[object, float]] | None, top: int = 40, chars: int = 1400) -> DataFrame:
    """Order by an outside scorer of the first ``top`` rows; without one, or if it fails, as it was.

    Rows beyond the first ``top`` count as 0. Only those rows, cut to ``chars``, reach the driver.
    """
    if scorer is None:
        return scored
    head = [r.asDict() for r in scored.orderBy(F.col("rrf_score").desc(), "chunk_id").limit(top).select("chunk_id", F.left("search_text", F.lit(chars)).alias("search_text")).collect()]
    try:
        found = scorer(head)
    except Exception:  # noqa: BLE001  an outside model may fail in any way; the fused order stands
        return scored
    if not found:
        return scored
    known = F.create_map(*[F.lit(x) for kv in found.items() for x in (kv[0], float(kv[1]))])
    rows = scored.withColumn("rerank_score", F.coalesce(F.try_element_at(known, F.col("chunk_id")), F.lit(0.0)))
    return rows.orderBy(F.col("rerank_score").desc(), F.col("rrf_score").desc(), "chunk_id")


def search(chunks: DataFrame, embeddings: DataFrame, query: str, vector: list[float] | None, limit: int = 10, candidates: int = 80, values: dict[str, object] | None = None, cohort: DataFrame | None = None, scorer: Callable | None = None, lexical: Callable[..., DataFrame] | None = None) -> DataFrame:
    """BM25 and dense candidates, fused, reranked if a scorer is given, and limited, with the chunks.

    Without a vector (the embedding failed) the text leg alone answers if it finds something.
    ``lexical`` takes the place of the scan for the text leg, such as the search of a written index.
    """
    limit = max(1, min(limit, 50))
    text = (lexical or bm25)(chunks=chunks, query=query, limit=candidates, values=values, cohort=cohort)
    if vector is None:
        if not query_tokens(query):
            raise ValueError("neither a vector nor a term to search for")
        fused = text.withColumns({"dense_rank": F.lit(None).cast("int"), "dense_distance": F.lit(None).cast("double"), "rrf_score": 1.0 / (F.lit(float(RRF_K)) + F.col("bm25_rank"))})
    else:
        fused = rrf_joined(text, dense(embeddings, vector, candidates, chunks, values, cohort))
    rows = reranked(fused.join(chunks, "chunk_id", "left"), scorer)
    order = ["rerank_score"] * ("rerank_score" in rows.columns) + ["rrf_score"]
    return rows.orderBy(*[F.col(c).desc() for c in order], "chunk_id").limit(limit)


def search_by_district(chunks: DataFrame, embeddings: DataFrame, vector: list[float], query: str = "", limit: int = 10, candidates: int = 180, per_district: int | None = 2, keyword: bool = False, values: dict[str, object] | None = None) -> DataFrame:
    """Vector search (with keywords .58 to .42 on request) capped per district."""
    limit, candidates = max(1, min(limit, 50)), max(limit, min(candidates, 500))
    own = dense(embeddings, vector, candidates, chunks, values)
    lists, weights = [(own, "dense_rank")], [1.0]
    if keyword:
        lists.append((bm25(chunks, query, candidates, values=values), "bm25_rank"))
        weights = [0.58, 0.42]
    rows = rrf(lists, weights=weights).join(chunks, "chunk_id")
    rows = capped(rows, "district", per_district) if per_district else rows
    return rows.orderBy(F.col("rrf_score").desc(), "chunk_id").limit(limit)


def neighbours(chunks: DataFrame) -> DataFrame:
    """Chunks with prev_chunk_id and next_chunk_id in their section; empty at its ends."""
    order = Window.partitionBy("section_id").orderBy(F.coalesce("page_start", F.lit(0)), F.coalesce("chunk_index", F.lit(0)), "chunk_id")
    return chunks.withColumns({"prev_chunk_id": F.coalesce(F.lag("chunk_id").over(order), F.lit("")), "next_chunk_id": F.coalesce(F.lead("chunk_id").over(order), F.lit(""))})


def with_neighbours(linked: DataFrame, chunk_id: object) -> DataFrame:
    """A chunk and the chunks before and after it, in that order of ``place``: -1, 0, 1."""
    one = linked.where(F.col("chunk_id") == chunk_id).select("chunk_id", "prev_chunk_id", "next_chunk_id")
    ids = one.select(F.explode(F.array(F.struct(F.col("prev_chunk_id").alias("i"), F.lit(-1).alias("p")), F.struct(F.col("chunk_id").alias("i"), F.lit(0).alias("p")), F.struct(F.col("next_chunk_id").alias("i"), F.lit(1).alias("p")))).alias("x")).select(F.col("x.i").alias("chunk_id"), F.col("x.p").alias("place"))
    return linked.join(F.broadcast(ids), "chunk_id").orderBy("place")  # three rows


def collection_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("district").alias("districts"), F.countDistinct("section_type").alias("section_types"))


def counts_by(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)
