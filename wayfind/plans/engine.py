"""The engine: the query tools of the model as methods that return DataFrames."""

from __future__ import annotations

import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import summaries as sm
from wayfind.operators import usage
from wayfind.plans import hybrid, search
from wayfind.plans.query import clamp_int, clean_query
from wayfind.sources import logs
from wayfind.sources.config import Settings, resolve_mode
from wayfind.sources.index import SearchIndex, index_health
from wayfind.sources.profile import Profile


class Engine:
    """Search tools over one index, with an optional usage log."""

    def __init__(
        self, index: SearchIndex, settings: Settings | None = None, profile: Profile | None = None, rules: list[dict] | None = None,
        log_folder: str | None = None,
    ) -> None:
        self.index, self.settings, self.profile = index, settings or Settings(), profile or Profile()
        self.rules, self.log_folder = rules or [], log_folder

    @property
    def spark(self) -> SparkSession:
        return self.index.spark

    # -- tools -----------------------------------------------------------------

    def health_check(self, listing: DataFrame) -> DataFrame:
        return index_health(self.index, listing)

    def search_context(self, query: str, max_results: int = 8) -> search.Answer:
        return search.keyword_search(self.index, query, self.settings, self.profile, clamp_int(max_results, 8, 1, 25))

    def find_related_files(self, query: str, max_results: int = 20) -> search.Answer:
        files = clamp_int(max_results, 20, 1, 40)
        return search.keyword_search(self.index, query, self.settings, self.profile, max(10, min(50, files * 2)), files)

    def find_code_locations(self, query: str, max_results: int = 8) -> hybrid.HybridAnswer:
        files = clamp_int(max_results, 8, 1, 25)
        return self.search_context_hybrid(query, max_files=files)

    def search_context_hybrid(self, query: str, max_files: int | None = None, mode: str | None = None) -> hybrid.HybridAnswer:
        chosen = resolve_mode(self.settings, mode)
        return hybrid.hybrid_search(
            self.index, clean_query(query), self.settings, self.profile, self.rules, chosen,
            clamp_int(max_files, self.settings.max_files, 1, 40),
        )

    def get_module_summary(self, module: str, pack: str | None = None, max_results: int = 12) -> dict[str, DataFrame]:
        return self._summary(sm.module_documents(self.index.documents, module, pack, clamp_int(max_results, 12, 1, 50)))

    def get_pack(self, pack: str, module: str | None = None, max_results: int = 20) -> dict[str, DataFrame]:
        return self._summary(sm.pack_documents(self.index.documents, pack, module, clamp_int(max_results, 20, 1, 50)))

    def _summary(self, docs: DataFrame) -> dict[str, DataFrame]:
        return {
            "documents": docs.select("rank", "doc_id", "source", "source_type", "module", "pack"),
            "source_files": sm.summary_files(docs, self.index.doc_files),
            "facts": sm.summary_facts(docs),
            "summary": sm.summary_texts(docs),
        }

    def get_usage_summary(self, events: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
        """All statistics of a usage log, one DataFrame each."""
        rated = usage.rated_events(events, outcomes)
        every = usage.all_outcomes(events, outcomes)
        graded = usage.graded_events(rated)
        return {
            "totals": usage.totals(events, every),
            "mode_stats": usage.mode_stats(rated),
            "code_location_stats": usage.tool_stats(rated),
            "event_counts": usage.counts(events, ["tool", "log_source"]),
            "outcome_counts": usage.counts(every, ["outcome", "failure_reason"]),
            "quality_counts": usage.counts(graded, ["risk_state", "action_label", "quality_grade", "follow_up", "ai_flagged"]),
            "quality_breakdown": usage.quality_breakdown(graded),
            "missed_files": usage.missed_files(events, outcomes),
            "failed_queries": usage.failed_queries(rated),
            "low_confidence": usage.low_confidence(events),
            "recent_events": usage.recent(graded),
        }

    def write_usage_summary(self, events: DataFrame, outcomes: DataFrame, folder: str) -> None:
        """The usage summary as files, one folder per statistic."""
        sm.write_statistics(self.get_usage_summary(events, outcomes), folder)

    def record_outcome(self, event_id: str, outcome: str, **details: Any) -> DataFrame:
        """Validated outcome row; appended to the log if the engine has one."""
        row = {
            "outcome_id": f"out_{uuid.uuid4().hex[:16]}", "event_id": event_id, "outcome": outcome,
            "used_suggested_files": int(details.get("used_suggested_files", 0)), "extra_files_read": int(details.get("extra_files_read", 0)),
            "needed_extra_search": bool(details.get("needed_extra_search", False)), "missed_files": list(details.get("missed_files") or []),
            "failure_reason": details.get("failure_reason", "none"), "notes": details.get("notes", ""),
        }
        schema = (
            "outcome_id string, event_id string, outcome string, used_suggested_files int, extra_files_read int, "
            "needed_extra_search boolean, missed_files array<string>, failure_reason string, notes string"
        )
        valid = logs.valid_outcomes(self.spark.createDataFrame([row], schema)).withColumn("ts", F.current_timestamp())
        if self.log_folder:
            logs.append_log(valid, f"{self.log_folder}/outcomes")
        return valid

    # -- event rows ------------------------------------------------------------

    def event_row(self, tool: str, query: str, answer: search.Answer | hybrid.HybridAnswer, latency_ms: int) -> DataFrame:
        """Log row of an answer: counts, first ten files, delivered characters."""

        def size(df: DataFrame):
            return df.agg(F.count(F.lit(1)).alias("n")).scalar().cast("int")

        files = answer.files.where(F.col("rank") < 10)
        listed = files.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("f")).scalar()
        delivered = answer.code_blocks.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).scalar()
        mixed = isinstance(answer, hybrid.HybridAnswer)
        return self.spark.range(1).select(
            F.lit(f"evt_{uuid.uuid4().hex[:16]}").alias("event_id"), F.current_timestamp().alias("ts"), F.lit(tool).alias("tool"),
            F.lit(query).alias("query"), F.lit(latency_ms).alias("latency_ms"), answer.confidence.select("confidence").scalar().alias("confidence"),
            F.lit("hybrid_hash" if mixed and answer.mode != "keyword" else "keyword").alias("retrieval_mode"),
            size(answer.files).alias("files_returned"), size(answer.symbols).alias("symbol_hits_returned"),
            size(answer.locations).alias("location_hints_returned"), size(answer.dependencies).alias("dependency_chain_returned"),
            size(answer.related).alias("related_files_returned"), size(answer.code_blocks).alias("code_blocks_returned"),
            (size(answer.primary_owner) > 0).alias("primary_owner_present"), listed.alias("top_files"), delivered.alias("context_chars"),
        )

    def call(self, tool: str, arguments: dict[str, Any]) -> dict[str, Any]:
        """Dispatch by tool name; a bad argument gives an error record instead of an exception."""
        tools = {
            "search_context": self.search_context, "find_related_files": self.find_related_files,
            "find_code_locations": self.find_code_locations, "search_context_hybrid": self.search_context_hybrid,
            "get_module_summary": self.get_module_summary, "get_graph_pack": self.get_pack,
        }
        began = time.perf_counter()
        try:
            if tool not in tools:
                raise ValueError(f"Unknown tool: {tool}")
            answer = tools[tool](**arguments)
        except (ValueError, TypeError) as error:
            return {"error": str(error), "tool": tool}
        latency = int((time.perf_counter() - began) * 1000)
        if self.log_folder and isinstance(answer, (search.Answer, hybrid.HybridAnswer)):
            logs.append_log(self.event_row(tool, str(arguments.get("query", "")), answer, latency), f"{self.log_folder}/events")
        return {"tool": tool, "answer": answer, "latency_ms": latency}

    def replay(self, questions: list[str], mode: str | None = None) -> DataFrame:
        """Ranked files of a question file (short by nature), one search after the other."""
        rows = None
        for number, question in enumerate(questions):
            files = self.search_context_hybrid(question, mode=mode).files
            part = files.select(F.lit(number).alias("question_no"), F.lit(question).alias("question"), "rank", "path", "score")
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], "question_no int, question string, rank int, path string, score double")
        return rows
