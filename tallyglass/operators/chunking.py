"""Pages to narrative segments and chunks. State is carried forward by windows over a document's lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.numeric import page_range
from tallyglass.functions.text import SPACE, _col, clean, compact, contains_any, filled, held, let, normal_lines, short_hash, strip, token_estimate, word_count
from tallyglass.operators import narrative_rules as R

SENTENCES = r"(?U)(?<=[.!?])\s+"


def _lines(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(normal_lines(text), "\n"), lambda x: strip(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")


def _digit_share(chars: Column) -> Column:
    n = F.length(chars)
    return F.when(n > 0, F.length(F.regexp_replace(chars, r"[^\d]", "")) / n).otherwise(0.0)


def table_like_score(text: Column | str) -> Column:
    """The largest of the shares of header lines, numeric lines, and .6 of the share of short lines."""

    def scored(lines: Column) -> Column:
        n = F.size(lines)
        header = F.size(F.filter(lines, lambda x: x.rlike(R.TABLE_HEADER)))
        numeric = F.size(F.filter(lines, lambda x: (_digit_share(F.regexp_replace(x, SPACE, "")) > 0.22) | x.contains("$") | x.contains("%")))
        short = F.size(F.filter(lines, lambda x: word_count(x) <= 4))
        return F.when(n == 0, 1.0).otherwise(F.greatest(header / n, numeric / n, short / n * 0.6))

    return let(_lines(text), scored)


def authored_confidence(text: Column | str, match: Column | str) -> Column:
    """1 less .45 of the table score (.55 at most), .5 for form text, .25 for a mismatched district."""
    form = let(F.lower(compact(text)), lambda t: contains_any(t, R.TEMPLATE))
    score = 1.0 - F.least(F.lit(0.55), table_like_score(text) * 0.45) - F.when(form, 0.5).otherwise(0.0) - F.when(_col(match) == 0, 0.25).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def useful(text: Column | str) -> Column:
    """Whether a segment is long enough and neither table, form text nor funding summary."""

    def judged(t: Column) -> Column:
        low, score = F.lower(t["c"]), t["s"]
        bad = contains_any(low, R.TEMPLATE + R.FUNDING_SUMMARY) | low.contains(R.BUDGET_REFERENCE)
        soft = (score >= 0.32) & contains_any(low, R.SOFT_TABLE_TAIL)
        return (token_estimate(t["c"]) >= R.MIN_TOKENS) & (score < 0.45) & ~bad & ~soft

    return let(F.struct(compact(text).alias("c"), table_like_score(text).alias("s")), judged)


def clean_line(line: Column | str) -> Column:
    """A line without form headers and tails; empty if nothing of the author's is left."""
    pairs = [(p, "") if isinstance(p, str) else p for p in R.LINE_REMOVALS]
    out = reduce(lambda c, p: strip(F.regexp_replace(c, *p)), pairs, compact(line))
    out = strip(F.regexp_replace(out, R.LINE_TAIL, ""))
    dropped = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in R.LINES_DROPPED])
    return let(out, lambda x: F.when((x == "") | dropped(x) | contains_any(x, R.LINE_MARKERS_DROPPED), F.lit("")).otherwise(x))


def _first_match(line: Column, rules: tuple, longest: int) -> Column:
    """The rule (all but its pattern) that a line matches first, as struct; null for long lines."""
    out = None
    for rule in rules:
        value = F.struct(*[F.lit(x).alias(f"v{k}") for k, x in enumerate(rule[:-1])])
        hit = line.rlike("(?i)" + rule[-1])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.when(F.length(line) <= longest, out)


def page_kinds(pages: DataFrame) -> DataFrame:
    """Pages (doc, page_number, text) with ``kind``: template, budget, table or text.

    From the first template page on, a document's pages are left out.
    """
    low = F.lower(compact("text"))
    hits = lambda t, m: F.size(held(t, m))
    kind = let(
        low,
        lambda t: F.when((F.col("page_number") >= R.TEMPLATE_FROM_PAGE) & (hits(t, R.TEMPLATE) > 0), "template")
        .when((F.col("page_number") <= R.BUDGET_TO_PAGE) & (hits(t, R.BUDGET_OVERVIEW) > 0), "budget")
        .when(hits(t, R.TABLE_PAGE) >= 2, "table")
        .otherwise("text"),
    )
    by = Window.partitionBy("doc").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = pages.withColumn("kind", kind).withColumn("_end", F.max(F.col("kind") == "template").over(by))
    return rows.withColumn("skipped", F.col("_end") | (F.col("kind") != "text")).drop("_end")


def line_events(pages: DataFrame) -> DataFrame:
    """Lines of the kept pages with what each one is: table, section, header, goal, action, prompt, text."""
    rows = page_kinds(pages).where("not skipped").select("doc", "page_number", F.posexplode(_lines("text")).alias("line_index", "raw"))
    low = F.lower("raw")
    starts = reduce(lambda a, b: a | b, [reduce(lambda x, y: x & y, [low.contains(w) for w in words]) for words in R.TABLE_STARTS])
    rows = rows.withColumns({"_table": starts, "line": clean_line("raw")}).where("_table or line <> ''")
    section = _first_match(F.col("line"), R.SECTIONS, R.SECTION_CHARS)
    rows = rows.withColumn("_section", section)
    rows = rows.withColumn("_section", F.when((F.col("line_index") < R.SECTION_LINES) | F.col("_section.v0").isin(*R.ANYWHERE), F.col("_section")))
    short = F.length("line") < 160
    goal = F.col("line").rlike(R.GOAL) & short & ~F.lower("line").contains("analysis")
    prompt = _first_match(F.col("line"), R.PROMPTS, R.PROMPT_CHARS)
    rows = rows.withColumn("_prompt", F.when(word_count("line") >= R.PROMPT_WORDS, prompt["v0"]))
    event = (
        F.when(F.col("_table"), "table")
        .when(F.col("_section").isNotNull(), "section")
        .when(F.col("line").rlike(R.TABLE_HEADER), "header")
        .when(goal, "goal")
        .when(F.col("line").rlike(R.ACTION) & short, "action")
        .when(F.col("_prompt").isNotNull(), "prompt")
        .otherwise("text")
    )
    return rows.withColumn("event", event)


def segments(pages: DataFrame) -> DataFrame:
    """Narrative segments: the lines between two events, with the section, prompt and goal they stand in.

    Windows run over the lines of one document, which bounds them.
    """
    by = Window.partitionBy("doc").orderBy("page_number", "line_index")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    e = F.col("event")
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    rows = line_events(pages).withColumns(
        {
            "_s": last(F.when(e == "section", F.col("_section"))),
            "goal_number": F.coalesce(last(F.when(e == "goal", F.regexp_extract("line", R.GOAL, 1))), F.lit("")),
            "prompt_label": F.coalesce(last(F.when(e == "prompt", F.col("_prompt")).when(e.isin("section", "goal", "action"), "")), F.lit("")),
            "_skip": F.coalesce(last(F.when(e == "table", True).when(e.isin("section", "prompt"), False)), F.lit(False)),
            "segment": F.sum(F.when(e.isin("table", "section", "goal", "action", "prompt"), 1).otherwise(0)).over(so_far),
        }
    )
    # a goal before any section opens the goals
    rows = rows.withColumns(
        {
            "section_type": F.coalesce("_s.v0", F.when(F.col("goal_number") != "", "goals_actions"), F.lit("unknown")),
            "section_path": F.coalesce("_s.v1", F.when(F.col("goal_number") != "", "Goals and Actions"), F.lit("Unknown")),
        }
    )
    rows = rows.where((e == "text") & ~F.col("_skip") & (F.col("section_type") != "unknown"))
    state = ["section_type", "section_path", "prompt_label", "goal_number"]
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "line_index", "line"))), lambda x: x["line"])
    out = rows.groupBy("doc", "segment", *state).agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), texts.alias("_l"))
    out = out.where(~((F.col("section_type") == "goals_actions") & (F.col("prompt_label") == "")))
    out = out.withColumns({"text": normal_lines(F.array_join("_l", "\n")), "action_number": F.lit("")}).drop("_l")
    return out.where(useful("text")).withColumn("chunk_kind", chunk_kind("section_type", "prompt_label", "action_number"))


def structured_segments(goals: DataFrame, actions: DataFrame) -> DataFrame:
    """Goals and actions of the flat tables as segments; source pages give their page range."""
    pages = page_range("source_pages")
    common = lambda path, label, action: [F.lit("goals_actions").alias("section_type"), F.lit(path).alias("section_path"), F.lit(label).alias("prompt_label"), clean("goal_number").alias("goal_number"), action.alias("action_number"), F.lit(label).alias("chunk_kind"), pages["first"].alias("page_start"), pages["last"].alias("page_end")]
    both = F.concat_ws("\n\n", filled(compact("title")), filled(compact("description")))
    g = goals.where(F.trim(F.coalesce("description", F.lit(""))) != "").select(F.col("cds_code").alias("doc"), F.col("goal_id").alias("segment"), *common("Structured Goal", "goal_description", F.lit("")), compact("description").alias("text"))
    a = actions.where(both != "").select(F.col("cds_code").alias("doc"), F.col("action_id").alias("segment"), *common("Structured Action", "action_description", clean("action_number")), both.alias("text"))
    return g.unionByName(a)


def chunk_kind(section: str, prompt: str, action: str) -> Column:
    return F.when(F.coalesce(F.col(action), F.lit("")) != "", "action_description").otherwise(F.coalesce(filled(prompt), F.col(section)))


def text_units(text: Column | str) -> Column:
    """array<string>: paragraphs (long ones as sentences), else lines, else sentences."""
    none = lambda xs: F.filter(xs, lambda x: x != "")
    paragraphs = none(F.transform(F.split(_col(text), r"\n\s*\n"), compact))
    pieces = lambda p: F.when(token_estimate(p) > R.MAX_TOKENS, none(F.split(p, SENTENCES))).otherwise(F.array(p))
    lines = none(F.transform(F.split(_col(text), "\n"), compact))
    sentences = none(F.split(compact(text), SENTENCES))
    cut = lambda u: F.when(F.size(u["p"]) > 1, F.flatten(F.transform(u["p"], pieces))).when(F.size(u["l"]) > 1, u["l"]).otherwise(u["s"])
    return let(F.struct(paragraphs.alias("p"), lines.alias("l"), sentences.alias("s")), cut)


_STATE = "struct<cur:array<string>,tokens:int,out:array<string>>"


def packed(units: Column | str) -> Column:
    """array<string>: units packed greedily into bodies of up to MAX_TOKENS, with overlap.

    A body is closed when the next unit would exceed the most, or when it reaches the target. The
    last units of a closed body, up to OVERLAP_TOKENS, open the next one; a body that isn't useful
    is dropped and hands nothing on.
    """
    none = F.array().cast("array<string>")
    total = lambda us: F.aggregate(us, F.lit(0), lambda a, u: a + token_estimate(u))
    made = lambda us: normal_lines(F.regexp_replace(F.array_join(us, "\n\n"), R.CHUNK_TAIL, ""))
    state = lambda cur, tokens, out: F.struct(cur.alias("cur"), tokens.cast("int").alias("tokens"), out.alias("out")).cast(_STATE)

    def overlap(us: Column) -> Column:
        # units from the end on, until they reach the overlap
        keep = F.filter(F.sequence(F.lit(1), F.size(us)), lambda i: total(F.slice(us, i + 1, F.greatest(F.size(us) - i, F.lit(0)))) < R.OVERLAP_TOKENS)
        return F.slice(us, F.coalesce(F.array_min(keep), F.size(us)), F.size(us))

    def closed(s: Column) -> Column:
        def ended(body: Column) -> Column:
            rest = overlap(s["cur"])
            return F.when(body == "", s).when(useful(body), state(rest, total(rest), F.array_append(s["out"], body))).otherwise(state(none, F.lit(0), s["out"]))

        return let(made(s["cur"]), ended)

    def step(s: Column, unit: Column) -> Column:
        n = token_estimate(unit)
        before = F.when((F.size(s["cur"]) > 0) & (s["tokens"] + n > R.MAX_TOKENS), closed(s)).otherwise(s)
        added = let(before, lambda b: state(F.array_append(b["cur"], unit), b["tokens"] + n, b["out"]))
        return let(added, lambda a: F.when(a["tokens"] >= R.TARGET_TOKENS, closed(a)).otherwise(a))

    def end(s: Column) -> Column:
        last = lambda body: F.when((F.size(s["cur"]) > 0) & useful(body), F.array_append(s["out"], body)).otherwise(s["out"])
        return let(made(s["cur"]), last)

    return F.aggregate(_col(units), state(none, F.lit(0), none), step, end)


def chunks(segs: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of segments with ids, breadcrumb, search text, tokens and confidence.

    ``documents``: doc, cds_code, county, district, school_year, source_path, pdf_url, district_name_match.
    """
    rows = segs.join(documents, "doc").select("*", F.posexplode(packed(text_units("text"))).alias("chunk_index", "body_text")).drop("text")
    rows = rows.withColumn("text_hash", short_hash("body_text", 24))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = lambda *cs: F.concat_ws("|", *[text(c) for c in cs])
    rows = rows.withColumn("section_id", short_hash(joined("cds_code", "section_type", "section_path", "goal_number", "action_number"), 20))
    rows = rows.withColumn("chunk_id", short_hash(joined("cds_code", "section_id", "page_start", "page_end", "chunk_index", "text_hash"), 24))
    labelled = lambda name, c: F.when(filled(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c)))
    crumbs = F.concat_ws(" | ", F.concat(F.lit("District: "), text("district")), F.concat(F.lit("County: "), text("county")), F.concat(F.lit("Section: "), text("section_path")), labelled("Goal", "goal_number"), labelled("Action", "action_number"), labelled("Prompt", "prompt_label"))
    rows = rows.withColumn("search_text", F.concat(crumbs, F.lit("\n\n"), F.col("body_text")))
    return rows.withColumns({"token_count": token_estimate("search_text"), "authored_confidence": authored_confidence("body_text", "district_name_match")})


def section_rollup(chunks: DataFrame, attributes: list[str]) -> DataFrame:
    """Per section: attributes of its first chunk, page range and number of chunks."""
    order = F.struct("page_start", "chunk_index", "chunk_id")
    return chunks.groupBy("section_id").agg(*[F.min_by(c, order).alias(c) for c in attributes], F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count("*").alias("chunk_count"))


def corpus_totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("doc").alias("documents"), F.countDistinct("section_id").alias("sections"), F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def needs_ocr(pages: DataFrame) -> DataFrame:
    """doc, needs_ocr: documents whose pages hold too little text, by characters or words of four letters."""
    t = compact("text")
    by = pages.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length(t)).alias("chars"), F.sum(F.regexp_count(t, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{4,}"))).alias("words"))
    n, chars, words = F.col("n"), F.col("chars"), F.col("words")
    return by.select("doc", (((n > 5) & (chars < 1000)) | ((n > 20) & (words < n * 8)) | ((chars > 10000) & (words < chars * 0.01))).alias("needs_ocr"))


def ocr_score(text: Column | str) -> Column:
    """How much a text reads like a plan: occurrences of its terms and a fortieth of its words."""

    def scored(t: Column) -> Column:
        terms = [(F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w) for w in R.OCR_TERMS]
        return reduce(lambda a, b: a + b, terms) + F.regexp_count(t, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{4,}")) / 40

    return let(F.lower(compact(text)), scored)


def embedding_text(longest: int = 24_000) -> Column:
    """What is embedded of a chunk: breadcrumb parts that aren't blank, then the text, cut to a length."""
    part = lambda name, c: F.when(filled(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c)))
    head = F.concat_ws("\n", part("District", "district"), part("County", "county"), part("Section", "section_path"), part("Goal", "goal_number"), part("Action", "action_number"))
    body = F.coalesce(filled("body_text"), filled("search_text"), F.lit(""))
    return F.left(F.concat_ws("\n\n", F.nullif(head, F.lit("")), body), F.lit(longest))


def exported(chunks: DataFrame) -> DataFrame:
    """Chunks with a text, with source_document_id (the file's name) and district_doc_id (code and name)."""
    some = filled("search_text").isNotNull() | filled("body_text").isNotNull()
    name = F.element_at(F.split(F.coalesce("source_path", F.lit("")), "/"), -1)
    rows = chunks.where(some & (F.trim("chunk_id") != "")).withColumn("source_document_id", name)
    return rows.withColumn("district_doc_id", F.concat_ws(":", "cds_code", "source_document_id"))
