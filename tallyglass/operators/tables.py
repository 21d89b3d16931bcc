"""Tables of plans (one row of cells each) to goals, metrics and actions.

Rows: doc, page, table_no, row_no, cells (array<string>). What kind a table is and where its columns
lie follows from the first four rows; a row without an id continues the record before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.numeric import contributing, currency, measurement
from tallyglass.functions.text import compact, let, normal_lines, without_continued

# How ids of goals and records look.
GOAL_ID = r"^\d+(?:\.\d+)?[A-Za-z]?$"
RECORD_ID = r"^[A-Za-z]?\d+[A-Za-z]?(?:\([A-Za-z]?\d+[A-Za-z]?\)|\.[A-Za-z]?\d*[A-Za-z]?)*$"
GOAL_TOKEN = r"(?i)(?:equity multiplier\s+)?(?:broad|focus)?\s*goal\s*(\d+(?:\.\d+)?[A-Za-z]?)"
HEAD_ROWS = 4
#: What cells that ``compact`` leaves as they are don't hold, joined by \0.
_NOT_ALL_PLAIN = r"[^ -~\x00]|  |^ | $| \x00|\x00 "

_GOAL_HEADS = ("goal #", "description", "type of goal")
_ACTION_HEADS = ("action #", "action title", "title", "description", "total funds", "contributing")
_METRIC_HEADS = ("metric #", "metric", "baseline", "year 1 outcome", "year 2 outcome")


def goal_number(c: Column) -> Column:
    """The goal a cell names: the whole cell as id, or the number behind the word goal; else null."""
    return let(compact(c), lambda t: F.when(t.rlike(GOAL_ID), t).otherwise(F.nullif(F.regexp_extract(t, GOAL_TOKEN, 1), F.lit(""))))


def _low(cells: Column) -> Column:
    """The compacted cells in lower case. Cells that are all plain, the usual case, are told by one scan of the row."""
    plain = F.transform(cells, lambda c: F.lower(F.coalesce(c, F.lit(""))))
    return F.when(F.array_join(cells, "\0").rlike(_NOT_ALL_PLAIN), F.transform(cells, lambda c: F.lower(compact(c)))).otherwise(plain)


def header_row(cells: Column, kind: Column) -> Column:
    """Whether a row repeats the column names of its kind; rows without text count."""
    return _names_columns(_low(cells), kind)


def _names_columns(low: Column, kind: Column) -> Column:
    hits = lambda low, names, more: F.size(F.filter(low, lambda c: c.isin(*names) | more(c)))
    no = lambda c: F.lit(False)
    is_head = lambda low: (
        F.when(F.size(low) == 0, True)
        .when(kind == "goal", hits(low, _GOAL_HEADS, no) >= 2)
        .when(kind == "action", hits(low, _ACTION_HEADS, lambda c: c.contains("planned expenditures") | c.contains("contributing to increased or improved services")) >= 3)
        .when(kind == "metric", hits(low, _METRIC_HEADS, lambda c: c.startswith("target for year 3") | c.startswith("desired outcome") | c.startswith("current difference")) >= 3)
        .otherwise(False)
    )
    return let(F.filter(low, lambda c: c != ""), is_head)


def _kind(head: Column) -> Column:
    has = lambda *ws: reduce(lambda a, b: a & b, [head.contains(w) for w in ws])
    action = has("action #") & ((has("action title") & (has("total funds") | has("planned expenditures"))) | has("title", "description", "total funds"))
    metric = has("metric", "baseline") & has("year 1")
    return F.when(has("goal #", "description"), "goal").when(action, "action").when(metric, "metric")


def padded(rows: DataFrame, dealt: bool = False) -> DataFrame:
    """Rows of one table with equally many cells: short ones are filled with empty texts.

    They are dealt by document, as records are made, so that a table's and a document's rows are shuffled once.
    """
    if not dealt:
        rows = rows.repartition("doc")
    width = F.max(F.size("cells")).over(Window.partitionBy("doc", "page", "table_no"))
    return rows.withColumn("_w", width).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("_w") - F.size("cells")))).drop("_w")


#: A test of a lower-cased column name, and the place where a table without such a column usually has it.
Place = tuple[Callable[[Column], Column], int | None]


def typed(rows: DataFrame, **places: Place) -> DataFrame:
    """Body rows with ``kind`` and ``heads``: map of lower-cased column name -> its last place.

    ``places`` add the last place of a column that passes a test. All are worked out once for a table, at its first row.
    """
    by = Window.partitionBy("doc", "page", "table_no").orderBy("row_no")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_low", _low(F.col("cells"))).withColumn("_r", F.row_number().over(by))
    rows = rows.withColumn("_top", F.collect_list(F.when(F.col("_r") <= HEAD_ROWS, F.struct("_r", F.col("_low").alias("c")))).over(whole))
    top = F.sort_array("_top")
    rows = rows.withColumn("_kind", F.when(F.col("_r") == 1, let(F.array_join(F.transform(top, lambda t: F.array_join(t["c"], " ")), " | "), _kind)))
    named = F.flatten(F.transform(top, lambda t: F.filter(F.transform(t["c"], lambda c, i: F.struct(c.alias("k"), i.alias("v"))), lambda e: e["k"] != "")))
    first = lambda c: F.when(F.col("_kind").isNotNull(), c)
    made = {"heads": first(F.map_from_entries(let(named, _lasts)))}
    if places:
        # most cells are no column's name: they go before names are compared with each other
        some = let(F.filter(named, lambda e: reduce(lambda a, b: a | b, [test(e["k"]) for test, _ in places.values()])), _lasts)
        made["_places"] = first(let(some, lambda es: F.struct(*[_place(es, *p).alias(n) for n, p in places.items()])))
    rows = rows.withColumns(made)
    rows = rows.withColumns({n: F.first(c, ignorenulls=True).over(whole) for n, c in {"kind": "_kind", **{n: n for n in made}}.items()}).where("kind is not null")
    rows = rows.where(~_names_columns(F.col("_low"), F.col("kind"))).drop("_r", "_top", "_low", "_kind")
    return rows.select("*", "_places.*").drop("_places") if places else rows


def _lasts(entries: Column) -> Column:
    """The last entry of each key."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))


def _place(entries: Column, test: Callable[[Column], Column], default: int | None) -> Column:
    """The last of the places of header cells that pass a test, else the usual place."""
    found = F.transform(F.filter(entries, lambda e: test(e["k"])), lambda e: e["v"])
    return F.coalesce(F.array_max(found), F.lit(default).cast("int"))


def _cell(place: str) -> Column:
    return F.coalesce(F.get("cells", F.col(place)), F.lit(""))


def goals(rows: DataFrame) -> DataFrame:
    own = typed(rows, _description=(_equals("description"), 1), _type=(_equals("type of goal"), 2))
    own = own.where("kind = 'goal'").withColumn("goal_number", goal_number(F.get("cells", F.lit(0))))
    own = own.where("goal_number is not null")
    return own.select("doc", "page", "table_no", "row_no", "goal_number", _cell("_description").alias("description"), _cell("_type").alias("goal_type"), F.array("page").alias("source_pages"))


def _records(own: DataFrame, starts: Column, fields: list[str], firsts: list[str]) -> DataFrame:
    """Rows grouped to records: a start row and the rows that continue it, fields joined by lines."""
    by = Window.partitionBy("doc").orderBy("page", "table_no", "row_no")
    own = own.withColumn("_start", starts).withColumn("_rec", F.sum(F.when(F.col("_start"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_rec > 0")
    order = F.struct("page", "table_no", "row_no")
    # a window, not a grouping: that would pack the rows of each record twice, though none has to move
    record = Window.partitionBy("doc", "_rec").orderBy("page", "table_no", "row_no")
    rows = own.select("doc", "_rec", F.struct(order.alias("o"), *firsts, *fields).alias("_x"), F.row_number().over(record).alias("_n"), "page", "table_no", "row_no")
    rows = rows.withColumn("_x", F.sort_array(F.collect_list("_x").over(record.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).where("_n = 1")
    lines = lambda c: F.array_join(F.filter(F.col(f"_x.{c}"), lambda v: v != ""), "\n")
    text = lambda c: F.when(F.size("_x") == 1, F.coalesce(F.get(f"_x.{c}", F.lit(0)), F.lit(""))).otherwise(lines(c))
    return rows.select("doc", "_rec", *[F.get(f"_x.{c}", F.lit(0)).alias(c) for c in firsts], *[text(c).alias(c) for c in fields], F.sort_array(F.array_distinct("_x.o.page")).alias("source_pages"))


def metrics(rows: DataFrame) -> DataFrame:
    """Metrics with their measurement cells parsed; a named row with values starts one without id."""
    places = {
        "metric_name": (lambda k: k == "metric", 1),
        "baseline_raw": (lambda k: (k == "baseline") | k.startswith("baseline "), 2),
        "year_1_outcome_raw": (lambda k: k.contains("year 1 outcome") & ~k.contains("current difference"), 3),
        "year_2_outcome_raw": (lambda k: k.contains("year 2 outcome"), 4),
        "year_3_target_raw": (lambda k: k.contains("target for year 3") | k.contains("desired outcome"), 5),
        "current_difference_from_baseline_raw": (lambda k: k.contains("current difference"), 6),
    }
    own = typed(rows, **{f"_{n}": p for n, p in places.items()}).where("kind = 'metric'").select(
        "doc", "page", "table_no", "row_no",
        F.coalesce(F.get(F.filter("cells", lambda c: c.rlike(RECORD_ID)), F.lit(0)), F.lit("")).alias("metric_number"),
        *[_cell(f"_{n}").alias(n) for n in places],
    )
    texts = list(places)
    some = reduce(lambda a, b: a | b, [F.col(c) != "" for c in texts[1:]])
    own = own.where((F.col("metric_number") != "") | (F.col("metric_name") != "") | some)
    out = _records(own, (F.col("metric_number") != "") | ((F.col("metric_name") != "") & some), texts, ["metric_number"])
    number = F.coalesce(F.nullif("metric_number", F.lit("")), F.concat(F.lit("metric_"), F.col("_rec").cast("string")))
    return out.select("doc", number.alias("metric_number"), *texts, measurement("baseline_raw").alias("baseline"), measurement("year_1_outcome_raw").alias("year_1_outcome"), measurement("year_3_target_raw").alias("year_3_target"), "source_pages")


_FUNDS = ("lcff funds", "total personnel", "total non-personnel", "other state funds", "local funds", "federal funds")


def actions(rows: DataFrame) -> DataFrame:
    """Actions with funds and contributing flag; the goal is the row's own where the table names it."""
    places = {
        "_goal": (lambda k: k.isin("goal #", "goal"), None),
        "_number": (lambda k: k.contains("action #"), 0),
        "_title": (lambda k: k.contains("action title") | (k == "title"), 1),
        "_description": (_equals("description"), None),
        "_contributing": (lambda k: k.contains("contributing to increased or improved services") | (k == "contributing"), None),
        "_funds": (lambda k: k.contains("total funds") | k.contains("planned expenditures"), None),
        **{f"_funds{i}": (_equals(n), None) for i, n in enumerate(_FUNDS)},
    }
    own = typed(rows, **places).where("kind = 'action'")
    money = F.coalesce(*[F.when(currency(_cell(p)).isNotNull(), _cell(p)) for p in places if p.startswith("_funds")], F.lit(""))
    own = own.select(
        "doc", "page", "table_no", "row_no",
        goal_number(_cell("_goal")).alias("goal_number"),
        normal_lines(_cell("_number")).alias("action_number"),
        normal_lines(_cell("_title")).alias("title"),
        normal_lines(_cell("_description")).alias("description"),
        money.alias("total_funds_raw"),
        normal_lines(_cell("_contributing")).alias("contributing_raw"),
    )
    out = _records(own, F.col("action_number").rlike(RECORD_ID), ["title", "description", "total_funds_raw", "contributing_raw"], ["action_number", "goal_number"])
    return out.select("doc", "goal_number", "action_number", without_continued("title").alias("title"), "description", "total_funds_raw", "contributing_raw", currency("total_funds_raw").alias("total_funds"), contributing("contributing_raw").alias("contributing"), "source_pages")


def _equals(name: str):
    return lambda k: k == name


def candidate_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc, page_number, text) with a table header, and their neighbours; all of a document without."""
    hit = let(F.lower(compact("text")), _kind).isNotNull()
    by = Window.partitionBy("doc").orderBy("page_number")
    rows = pages.withColumn("_hit", hit.cast("int"))
    rows = rows.withColumns({"_near": F.max("_hit").over(by.rowsBetween(-1, 1)), "_any": F.max("_hit").over(Window.partitionBy("doc"))})
    return rows.where("_near = 1 or _any = 0").drop("_hit", "_near", "_any")


def plan_metadata(pages: DataFrame, fallback: str = "doc") -> DataFrame:
    """doc, district_name, school_year from the first four pages; the document's name where none is found."""
    first = pages.where("page_number <= 4").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n").alias("_t"))
    get = lambda p: F.nullif(compact(F.regexp_extract("_t", p, 1)), F.lit(""))
    name = F.coalesce(get(r"(?s)Local Educational Agency \(LEA\) Name:\s*(.+?)\s*CDS Code:"), get(r"(?s)Local Control and Accountability Plan for\s+(.+?)\s+Page \d+ of \d+"), F.col(fallback).cast("string"))
    year = F.coalesce(get(r"School Year:\s*([0-9-]+)"), get(r"\b(20\d{2}-\d{2}|20\d{2}-20\d{2})\b"))
    return first.select("doc", name.alias("district_name"), year.alias("school_year"))


def assembled(meta: DataFrame, goals: DataFrame, actions: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per document with counts and warnings; documents without goals carry a warning."""
    count = lambda df, n: df.groupBy("doc").agg(F.count("*").alias(n))
    out = meta
    for df, n in ((goals, "goal_count"), (metrics, "metric_count"), (actions, "action_count")):
        out = out.join(count(df, n), "doc", "left")
    out = out.fillna(0, ["goal_count", "metric_count", "action_count"])
    warn = [F.when(F.col(f"{k}_count") == 0, F.lit(f"No {k}s were extracted.")) for k in ("goal", "metric", "action")]
    return out.withColumn("extraction_warnings", F.array_compact(F.array(*warn)))
