"""One object over a set of tables, with the engine's queries as methods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.config import TOPICS, Topic
from tallyglass.plans import directory, inverted, opportunities, reports, retrieval

NEEDED = ("districts", "documents", "actions", "goals", "metrics", "indicators")


@dataclass
class Engine:
    """``tables``: districts, documents, actions, goals, metrics, indicators, and for the other
    methods chunks, embeddings, profiles, contacts. ``embed`` turns a query into a vector;
    ``index`` answers the text leg of searches in place of a scan of the chunks."""

    tables: dict[str, DataFrame]
    embed: Callable[[str], list[float]] | None = None
    scorer: Callable[[list[dict]], dict[object, float]] | None = None
    index: inverted.Index | None = None
    topics: dict[str, Topic] = field(default_factory=lambda: dict(TOPICS))

    @classmethod
    def open(cls, spark: SparkSession, root: str, names: tuple[str, ...] = (*NEEDED, "chunks", "embeddings", "profiles", "contacts"), **options: object) -> Engine:
        """The tables of a folder that ``sinks.write_tables`` has written; missing ones are left out."""
        found = {}
        for name in names:
            try:
                found[name] = spark.read.parquet(f"{root}/{name}")
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return cls(found, **options)

    def find_opportunities(self, topic: str | Topic = "chronic_absenteeism", outcome_trend: str = "worsening", rank_by: str = "strict_action_funds", limit: int = 25, **options: object) -> DataFrame:
        return opportunities.find_opportunities(self.tables, topic, outcome_trend, rank_by, limit=opportunities.clamped(limit, 1, 100), **options)

    def account_brief(self, cds_code: object, topic: str | Topic = "chronic_absenteeism", action_limit: int = 6) -> dict[str, DataFrame]:
        return opportunities.account_brief(self.tables, cds_code, topic, opportunities.clamped(action_limit, 1, 20))

    def declining_report(self, n: int = 3) -> dict[str, DataFrame]:
        return {"summary": reports.declining_summary(self.tables), "candidates": reports.declining_candidates(self.tables), "evidence": reports.declining_evidence(self.tables, n)}

    def plan_documents(self, **options: object) -> DataFrame:
        return directory.plan_documents(self.tables["documents"], **options)

    def contacts(self, **options: object) -> DataFrame:
        return directory.directory_contacts(self.tables["profiles"], self.tables["contacts"], self.tables["districts"], **options)

    def district_context(self, cds_code: object) -> tuple[DataFrame, DataFrame]:
        return directory.district_context(self.tables["actions"], self.tables["chunks"], cds_code)

    def declining_cohort(self, indicator: str = "chronic_absenteeism") -> DataFrame:
        return reports.declining(self.tables["indicators"], indicator).select("cds_code").distinct()

    def search(self, query: str, limit: int = 10, cohort: DataFrame | None = None, **filters: object) -> DataFrame:
        """Narrative search. If the embedding fails, the text leg answers alone."""
        vector = None
        if self.embed is not None:
            try:
                vector = self.embed(query)
            except Exception:  # noqa: BLE001  an outside model may fail in any way
                vector = None
        return retrieval.search(self.tables["chunks"], self.tables["embeddings"], query, vector, limit, values=filters, cohort=cohort, scorer=self.scorer, lexical=self.index and partial(inverted.bm25, self.index))

    def get_chunk(self, chunk_id: object) -> DataFrame:
        """A chunk with its neighbours."""
        one = self.tables["chunks"].where(F.col("chunk_id") == chunk_id).select("section_id")
        section = self.tables["chunks"].join(one, "section_id", "left_semi")
        return retrieval.with_neighbours(retrieval.neighbours(section), chunk_id)

    def stats(self) -> DataFrame:
        return retrieval.collection_stats(self.tables["chunks"])

    def explain(self, topic: str = "chronic_absenteeism") -> dict[str, object]:
        """How a topic is matched and ranked."""
        of = opportunities.as_topic(topic)
        return {"indicator": of.indicator, "group": of.group, "lower_is_better": of.lower_is_better, "terms": list(of.terms), "strict_title_terms": list(of.strict), "rankings": list(opportunities.RANKINGS), "narrative_query": of.narrative_query}
