"""Quality model of logged events: risk, evidence grade, follow-up, proof state, retrieval mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions.paths import base_name, slashed


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def event_mode() -> Column:
    """Retrieval mode of an event: logged mode, else derived from the tool and its backend."""
    mode = F.trim(_text("retrieval_mode"))
    return (
        F.when(mode.isin("semantic", "semantic_hash"), "hybrid_semantic")
        .when(mode != "", mode)
        .when(
            F.col("tool") == "search_context_hybrid",
            F.when(F.lower(_text("embedding_backend")) == "sentence-transformers", "hybrid_semantic").otherwise("hybrid_hash"),
        )
        .when(F.col("tool").isin(*C.KEYWORD_TOOLS), "keyword")
        .otherwise("other")
    )


def is_retrieval() -> Column:
    return event_mode().isin("keyword", "hybrid_hash", "hybrid_semantic")


def inferred_outcome() -> Column:
    """Outcome of an event nobody rated, from ordered signals; null if there is none."""
    check = F.upper(_text("analysis_relevance_check"))
    return (
        F.when(check == "FAILED", "failed")
        .when(check == "PARTIAL", "partial")
        .when(_n("files_returned") == 0, "failed")
        .when(_flag("analysis_parse_incomplete"), "partial")
        .when((_n("gap_searches_fired") > 0) & ~_flag("primary_owner_present"), "partial")
    )


def gap_log_near(gap_time: Column, seconds: int = C.GAP_WINDOW_SECONDS) -> Column:
    """Whether an event lies within the time band around the latest gap log."""
    apart = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(gap_time.cast("timestamp")))
    return F.coalesce(apart <= seconds * 1_000_000, F.lit(False))


def single_root(paths: Column) -> Column:
    """The top-level folder of the first ten paths if at least eight share it and there is no other."""
    roots = F.transform(
        F.filter(F.slice(paths, 1, 10), lambda p: F.contains(p, F.lit("/"))),
        lambda p: F.substring_index(F.lower(slashed(p)), "/", 1),
    )
    return F.when((F.size(roots) >= 8) & (F.size(F.array_distinct(roots)) == 1), F.element_at(roots, 1))


def with_risk(
    events: DataFrame, gap_time: Column | None = None, gaps_fired: Column | None = None, gap_files: Column | None = None
) -> DataFrame:
    """Adds risk_state, action_label, risk_reasons, owner_strength, evidence_strength.

    ``events`` carries the outcome columns outcome, inferred, used_suggested_files,
    extra_files_read and failure_reason (null where there is no outcome).
    """
    confidence = F.coalesce("confidence", F.lit(0.0))
    check = F.upper(_text("analysis_relevance_check"))
    symbols, locations, edges = _n("symbol_hits_returned"), _n("location_hints_returned"), _n("dependency_chain_returned")
    fired, added, owner = _n("gap_searches_fired"), _n("gap_files_added"), _flag("primary_owner_present")
    outcome, used = _text("outcome"), _n("used_suggested_files")
    failed = (outcome == "failed") & ~_flag("inferred")
    near = gap_log_near(gap_time) & (gaps_fired > 0) if gap_time is not None else F.lit(False)
    near_added = near & (gap_files > 0) if gap_files is not None else F.lit(False)
    gap = ((fired > 0) & (added <= 0)) | (near & ~near_added)
    root = single_root(F.col("top_files"))
    good = (
        (confidence >= 0.65) & owner & (symbols >= 20) & (locations >= 8) & (edges >= 5) & (fired == 0) & (outcome != "failed")
    )
    used_well = (outcome == "success") & (used >= 3) & owner & (confidence >= 0.50) & (fired == 0)
    miss = failed | (check == "FAILED") | (confidence < 0.30) | (~owner & (symbols < 5))
    unparsed = _flag("analysis_parse_error") | _flag("analysis_parse_incomplete")
    ladder = (
        (miss, "likely_retrieval_miss", "improve query/profile"),
        (unparsed, "needs_review", "review AI output"),
        (check == "PARTIAL", "needs_review", "review owner files"),
        (gap, "likely_graph_gap", "improve graph pack"),
        (good | used_well, "likely_good", "trust result"),
    )

    def first_of(index: int, default: str) -> Column:
        chain = None
        for rule in ladder:
            chain = F.when(rule[0], rule[index]) if chain is None else chain.when(rule[0], rule[index])
        return chain.otherwise(default)

    confirmed = used_well & ~(miss | unparsed | (check == "PARTIAL") | gap | good)
    reasons = (
        (failed, F.lit("logged_failed")),
        (check.isin("FAILED", "PARTIAL", "PASSED"), F.concat(F.lit("ai_relevance_"), F.lower(check))),
        (_text("analysis_confidence") != "", F.concat(F.lit("ai_confidence:"), F.lower("analysis_confidence"))),
        (_flag("analysis_parse_error"), F.lit("ai_parse_error")),
        (_flag("analysis_parse_incomplete") & ~_flag("analysis_parse_error"), F.lit("ai_parse_incomplete")),
        (~_text("failure_reason").isin("", "none"), F.concat(F.lit("failure_reason:"), F.col("failure_reason"))),
        (confidence < 0.40, F.lit("low_confidence")),
        ((confidence >= 0.40) & (confidence < 0.55), F.lit("medium_confidence")),
        (_n("files_returned") <= 3, F.lit("few_files")),
        (~owner, F.lit("no_primary_owner")),
        (symbols < 8, F.lit("weak_symbol_coverage")),
        (locations < 4, F.lit("weak_location_coverage")),
        (edges < 3, F.lit("weak_dependency_coverage")),
        (fired > 0, F.lit("gap_search_fired")),
        ((fired > 0) & (added > 0), F.lit("gap_search_added_files")),
        ((fired > 0) & (added <= 0), F.lit("gap_search_found_nothing")),
        ((outcome == "success") & (used == 0) & (_n("extra_files_read") == 0), F.lit("logged_success_but_zero_usage")),
        (root.isNotNull(), F.concat(F.lit("single_root_heavy_top_files:"), root)),
        (near, F.lit("latest_gap_log_present")),
        (near_added, F.lit("latest_gap_log_added_files")),
        (confirmed, F.lit("ai_confirmed_usage")),
    )
    owner_strength = (
        F.when(owner & (confidence >= 0.65), "strong").when(~owner, "weak").otherwise("medium")
    )
    evidence = (
        F.when((symbols >= 20) & (locations >= 8) & (edges >= 5), "strong")
        .when((symbols >= 8) & (locations >= 4), "medium")
        .otherwise("weak")
    )
    return events.select(
        "*",
        first_of(1, "needs_review").alias("risk_state"),
        first_of(2, "review owner files").alias("action_label"),
        F.array_compact(F.array(*[F.when(c, text) for c, text in reasons])).alias("risk_reasons"),
        owner_strength.alias("owner_strength"),
        evidence.alias("evidence_strength"),
        gap.alias("graph_gap_suspected"),
    )


def evidence_badges() -> Column:
    owner = _flag("primary_owner_present")
    badges = (
        (owner, "owner_found"),
        (_n("code_blocks_returned") > 0, "real_code_verified"),
        (_n("symbol_hits_returned") >= 8, "symbols_present"),
        (_n("location_hints_returned") >= 4, "location_hints_present"),
        (_n("dependency_chain_returned") >= 3, "dependency_chain_present"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in badges]))


def quality_grade() -> Column:
    """strong with all five badges, needs_review without owner or code, else moderate."""
    weak = ~_flag("primary_owner_present") | (_n("code_blocks_returned") == 0)
    return F.when(weak, "needs_review").when(F.size(evidence_badges()) >= 5, "strong").otherwise("moderate")


def follow_up(grade: Column, risk: Column, outcome: Column, flagged: Column, proof: Column) -> Column:
    """What to do about an event, limited by its evidence first."""
    missed = flagged | F.coalesce(outcome, F.lit("")).isin("partial", "failed") | F.coalesce(proof, F.lit("")).isin(
        "confirmed_miss", "confirmed_graph_gap"
    )
    moderate = (
        F.when(missed, "Review").when(risk == "likely_good", "None").when(risk == "likely_graph_gap", "Graph gap")
        .when(risk == "likely_retrieval_miss", "Investigate").otherwise("Review")
    )
    weak = (
        F.when(risk == "likely_graph_gap", "Graph gap")
        .when(risk.isin("likely_retrieval_miss", "needs_review"), "Investigate").otherwise("Review")
    )
    strong = F.when(missed, "Review").otherwise("None")
    return F.when(grade == "strong", strong).when(grade == "moderate", moderate).otherwise(weak)


def proof_states(
    events: DataFrame, audits: DataFrame, benchmark: DataFrame, repo_files: DataFrame, pack_files: DataFrame
) -> DataFrame:
    """(event_id, proof_state): what a benchmark proves about an event; null without audit or benchmark.

    ``audits``: event_id, question, verdict, top_files.  ``benchmark``: question,
    owner_files, expected_pack, modules.  ``repo_files``: name (lower), path.
    ``pack_files``: module, pack, name (lower).  All steps are equi joins on
    exploded names.
    """
    # of several audits of an event the greatest verdict counts, whatever order they are read in
    by_event = audits.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.max(F.struct("verdict", "top_files")).alias("by_event"))
    by_question = audits.groupBy(F.col("question").alias("query")).agg(
        F.max_by(F.struct("verdict", "top_files"), F.coalesce(F.col("event_id").cast("string"), F.lit(""))).alias("by_question")
    )
    joined = (
        events.select("event_id", "query")
        .join(by_event, "event_id", "left")
        .join(by_question, "query", "left")
        .join(benchmark.withColumnRenamed("question", "query").withColumn("known", F.lit(True)), "query", "left")
        .withColumn("audit", F.coalesce("by_event", "by_question"))
        .where(F.col("audit").isNotNull() | F.col("known"))
    )
    owners = joined.select("event_id", "expected_pack", "modules", F.explode_outer("owner_files").alias("owner")).withColumn(
        "name", F.lower("owner")
    )
    in_repo = owners.join(repo_files.select("name").distinct(), "name", "left_semi")
    exists = in_repo.select("event_id").distinct().withColumn("owner_exists", F.lit(True))
    packed = (
        in_repo.select("event_id", "name", F.col("expected_pack").alias("pack"), F.explode("modules").alias("module"))
        .join(pack_files.select("module", "pack", "name").distinct(), ["module", "pack", "name"], "left_semi")
        .select("event_id", "name").distinct()
    )
    top = joined.select("event_id", F.explode("audit.top_files").alias("f")).select(
        "event_id", F.lower(base_name(slashed(F.col("f")))).alias("name")
    )
    covered = packed.select("event_id").distinct().withColumn("in_pack", F.lit(True))
    returned = packed.join(top.distinct(), ["event_id", "name"], "left_semi").select("event_id").distinct().withColumn(
        "returned", F.lit(True)
    )
    full = joined.join(exists, "event_id", "left").join(covered, "event_id", "left").join(returned, "event_id", "left")
    verdict = F.coalesce("audit.verdict", F.lit(""))
    state = (
        F.when(F.col("owner_exists").isNull(), "invalid_benchmark")
        .when((F.coalesce("expected_pack", F.lit("")) != "") & F.col("in_pack").isNull(), "confirmed_graph_gap")
        .when(verdict.isin("exact", "strong_pass"), "confirmed_good")
        .when(verdict.isin("partial", "weak_partial"), "confirmed_partial")
        .otherwise("confirmed_miss")
    )
    return full.select("event_id", state.alias("proof_state"), F.coalesce("returned", F.lit(False)).alias("owner_returned"))
