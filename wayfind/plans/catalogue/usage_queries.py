"""Usage-log queries: outcomes, quality model, missed files, statistics, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.operators import quality as q
from wayfind.operators import usage as u
from wayfind.plans.catalogue.registry import query
from wayfind.sources.starschema import StarTables, sql_in, with_ctes
from wayfind.streaming import windows as win

LOG = ["event_log", "outcomes"]
_GUESS = """CASE WHEN analysis_relevance_check = 'FAILED' THEN 'failed' WHEN analysis_relevance_check = 'PARTIAL' THEN 'partial' WHEN files_returned = 0 THEN 'failed'
  WHEN analysis_parse_incomplete THEN 'partial' WHEN gap_searches_fired > 0 AND NOT primary_owner_present THEN 'partial' END"""
_MODE = f"""CASE WHEN retrieval_mode IN ('semantic','semantic_hash') THEN 'hybrid_semantic' WHEN retrieval_mode <> '' THEN retrieval_mode
  WHEN tool = 'search_context_hybrid' THEN CASE WHEN embedding_backend = 'sentence-transformers' THEN 'hybrid_semantic' ELSE 'hybrid_hash' END
  WHEN tool IN {sql_in(C.KEYWORD_TOOLS)} THEN 'keyword' ELSE 'other' END"""
RATED = {
    "last": "SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts DESC, outcome_id DESC) = 1",
    "rated": f"""SELECT e.*, coalesce(l.outcome, CASE WHEN l.event_id IS NULL THEN {_GUESS} END) AS outcome, l.event_id IS NULL AND ({_GUESS}) IS NOT NULL AS inferred,
  CASE WHEN l.event_id IS NOT NULL THEN used_suggested_files WHEN ({_GUESS}) IS NOT NULL THEN files_returned END AS used_suggested_files,
  CASE WHEN l.event_id IS NOT NULL THEN extra_files_read WHEN ({_GUESS}) IS NOT NULL THEN 0 END AS extra_files_read,
  CASE WHEN l.event_id IS NOT NULL THEN failure_reason WHEN ({_GUESS}) IS NOT NULL THEN 'none' END AS failure_reason, {_MODE} AS mode
  FROM event_log e LEFT JOIN last l USING (event_id)""",
    "everything": f"""SELECT event_id, ts, outcome, used_suggested_files, extra_files_read, needed_extra_search, failure_reason, false AS inferred FROM outcomes
  UNION ALL SELECT event_id, ts, outcome, used_suggested_files, extra_files_read, gap_searches_fired > 0, 'none', true FROM rated WHERE inferred""",
}


def rated_events(t: StarTables) -> DataFrame:
    return u.rated_events(t.event_log(), t.outcomes())


@query(
    "last_outcome_per_event",
    with_ctes(LOG, "SELECT event_id, outcome_id, outcome, failure_reason FROM last", RATED),
)
def last_outcome_per_event(t: StarTables) -> DataFrame:
    """Latest outcome of every rated event."""
    return u.last_outcomes(t.outcomes()).select("event_id", "outcome_id", "outcome", "failure_reason")


@query(
    "rated_events",
    with_ctes(LOG, "SELECT event_id, outcome, inferred, used_suggested_files, extra_files_read, failure_reason FROM rated", RATED),
)
def rated(t: StarTables) -> DataFrame:
    """Every event with its recorded or inferred outcome."""
    return rated_events(t).select("event_id", "outcome", "inferred", "used_suggested_files", "extra_files_read", "failure_reason")


@query("inferred_outcomes", with_ctes(LOG, "SELECT event_id, outcome, used_suggested_files, gap_searches_fired > 0 AS needed_extra_search FROM rated WHERE inferred", RATED))
def inferred_outcomes(t: StarTables) -> DataFrame:
    """Outcomes deduced for unrated events."""
    return u.inferred_outcomes(t.event_log(), t.outcomes()).select("event_id", "outcome", "used_suggested_files", "needed_extra_search")


@query("event_mode", with_ctes(["event_log"], f"SELECT {_MODE} AS mode, tool, count(*) AS n FROM event_log GROUP BY ALL"))
def event_mode(t: StarTables) -> DataFrame:
    """Events per normalised retrieval mode and tool."""
    return t.event_log().groupBy(q.event_mode().alias("mode"), "tool").agg(F.count(F.lit(1)).alias("n"))


_GAP_SQL = {
    "gap": "SELECT max(ts) AS ts FROM events WHERE event_type = 'error'",
    "risk0": f"""SELECT rated.*, coalesce(confidence, 0.0) AS c, abs(epoch_us(rated.ts) - epoch_us(gap.ts)) <= 900000000 AS near FROM rated, gap""",
    "risk1": """SELECT *, (gap_searches_fired > 0 AND gap_files_added <= 0) OR near AS gap_suspected,
  (outcome = 'failed' AND NOT inferred) IS TRUE OR analysis_relevance_check IS NOT DISTINCT FROM 'FAILED' OR c < 0.30 OR (NOT primary_owner_present AND symbol_hits_returned < 5) AS miss,
  analysis_parse_error OR analysis_parse_incomplete AS unparsed, analysis_relevance_check IS NOT DISTINCT FROM 'PARTIAL' AS part,
  c >= 0.65 AND primary_owner_present AND symbol_hits_returned >= 20 AND location_hints_returned >= 8 AND dependency_chain_returned >= 5 AND gap_searches_fired = 0 AND outcome IS DISTINCT FROM 'failed' AS good,
  (outcome = 'success') IS TRUE AND coalesce(used_suggested_files,0) >= 3 AND primary_owner_present AND c >= 0.50 AND gap_searches_fired = 0 AS used_well FROM risk0""",
    "risk": """SELECT *, CASE WHEN miss THEN 'likely_retrieval_miss' WHEN unparsed THEN 'needs_review' WHEN part THEN 'needs_review' WHEN gap_suspected THEN 'likely_graph_gap' WHEN good OR used_well THEN 'likely_good' ELSE 'needs_review' END AS risk_state,
  CASE WHEN miss THEN 'improve query/profile' WHEN unparsed THEN 'review AI output' WHEN part THEN 'review owner files' WHEN gap_suspected THEN 'improve graph pack' WHEN good OR used_well THEN 'trust result' ELSE 'review owner files' END AS action_label,
  CASE WHEN primary_owner_present AND c >= 0.65 THEN 'strong' WHEN NOT primary_owner_present THEN 'weak' ELSE 'medium' END AS owner_strength,
  CASE WHEN symbol_hits_returned >= 20 AND location_hints_returned >= 8 AND dependency_chain_returned >= 5 THEN 'strong' WHEN symbol_hits_returned >= 8 AND location_hints_returned >= 4 THEN 'medium' ELSE 'weak' END AS evidence_strength,
  array_to_string(list_filter([CASE WHEN (outcome = 'failed' AND NOT inferred) THEN 'logged_failed' END, 'ai_relevance_' || lower(analysis_relevance_check), 'ai_confidence:' || lower(analysis_confidence),
   CASE WHEN analysis_parse_error THEN 'ai_parse_error' WHEN analysis_parse_incomplete THEN 'ai_parse_incomplete' END, CASE WHEN failure_reason <> 'none' THEN 'failure_reason:' || failure_reason END,
   CASE WHEN c < 0.40 THEN 'low_confidence' WHEN c < 0.55 THEN 'medium_confidence' END, CASE WHEN files_returned <= 3 THEN 'few_files' END, CASE WHEN NOT primary_owner_present THEN 'no_primary_owner' END,
   CASE WHEN symbol_hits_returned < 8 THEN 'weak_symbol_coverage' END, CASE WHEN location_hints_returned < 4 THEN 'weak_location_coverage' END, CASE WHEN dependency_chain_returned < 3 THEN 'weak_dependency_coverage' END,
   CASE WHEN gap_searches_fired > 0 THEN 'gap_search_fired' END, CASE WHEN gap_searches_fired > 0 THEN CASE WHEN gap_files_added > 0 THEN 'gap_search_added_files' ELSE 'gap_search_found_nothing' END END,
   CASE WHEN outcome = 'success' AND coalesce(used_suggested_files,0) = 0 AND coalesce(extra_files_read,0) = 0 THEN 'logged_success_but_zero_usage' END, CASE WHEN near THEN 'latest_gap_log_present' END,
   CASE WHEN used_well AND NOT (miss OR unparsed OR part OR gap_suspected OR good) THEN 'ai_confirmed_usage' END], lambda x: x IS NOT NULL), '|') AS reasons FROM risk1""",
}
_BADGES = """CAST(primary_owner_present AS INT) + CAST(code_blocks_returned > 0 AS INT) + CAST(symbol_hits_returned >= 8 AS INT) + CAST(location_hints_returned >= 4 AS INT) + CAST(dependency_chain_returned >= 3 AS INT)"""
_GRADED = {
    "graded": f"""SELECT *, CASE grade WHEN 'strong' THEN CASE WHEN missed THEN 'Review' ELSE 'None' END
   WHEN 'moderate' THEN CASE WHEN missed THEN 'Review' WHEN risk_state = 'likely_good' THEN 'None' WHEN risk_state = 'likely_graph_gap' THEN 'Graph gap' WHEN risk_state = 'likely_retrieval_miss' THEN 'Investigate' ELSE 'Review' END
   ELSE CASE WHEN risk_state = 'likely_graph_gap' THEN 'Graph gap' WHEN risk_state IN ('likely_retrieval_miss','needs_review') THEN 'Investigate' ELSE 'Review' END END AS follow_up FROM (
  SELECT *, (NOT inferred AND outcome IN ('partial','failed')) IS TRUE AS missed, (NOT inferred AND outcome IN ('partial','failed') AND failure_reason <> 'none') IS TRUE AS ai_flagged,
    CASE WHEN NOT primary_owner_present OR code_blocks_returned = 0 THEN 'needs_review' WHEN {_BADGES} >= 5 THEN 'strong' ELSE 'moderate' END AS grade, {_BADGES} AS badges FROM risk)"""
}


def gap_log(t: StarTables) -> dict:
    """The latest gap log: the last error event stands for it (one row, scalar subquery)."""
    latest = t.read("events").where(F.col("event_type") == "error").agg(F.max("ts").alias("ts")).scalar()
    return {"gap_time": latest, "gaps_fired": F.lit(1), "gap_files": F.lit(0)}


@query(
    "risk_state",
    with_ctes(LOG, "SELECT event_id, risk_state, action_label, owner_strength, evidence_strength, gap_suspected, reasons FROM risk", {**RATED, **_GAP_SQL}),
)
def risk_state(t: StarTables) -> DataFrame:
    """Risk state and reasons of every event."""
    return q.with_risk(rated_events(t), **gap_log(t)).select(
        "event_id", "risk_state", "action_label", "owner_strength", "evidence_strength",
        F.col("graph_gap_suspected").alias("gap_suspected"), F.array_join("risk_reasons", "|").alias("reasons"),
    )


@query(
    "gap_window_900s",
    with_ctes(["event_log"], "SELECT event_id FROM event_log, (SELECT max(ts) AS g FROM events WHERE event_type = 'error') WHERE abs(epoch_us(ts) - epoch_us(g)) <= 900000000"),
)
def gap_window_900s(t: StarTables) -> DataFrame:
    """Events within fifteen minutes of the latest gap log (time-band match)."""
    return t.event_log().where(q.gap_log_near(gap_log(t)["gap_time"])).select("event_id")


@query(
    "quality_grade",
    with_ctes(LOG, "SELECT event_id, grade, CAST(badges AS INTEGER) AS badges, follow_up, ai_flagged FROM graded", {**RATED, **_GAP_SQL, **_GRADED}),
)
def quality_grade(t: StarTables) -> DataFrame:
    """Evidence grade, follow-up and AI flag of every event."""
    graded = u.graded_events(rated_events(t), **gap_log(t))
    return graded.select(
        "event_id", F.col("quality_grade").alias("grade"), F.size("evidence_badges").alias("badges"), "follow_up", "ai_flagged"
    )


@query(
    "quality_breakdown",
    with_ctes(
        LOG,
        f"SELECT grade, rn, event_id FROM (SELECT grade, event_id, row_number() OVER (PARTITION BY grade ORDER BY ts DESC, event_id DESC) AS rn FROM graded WHERE mode <> 'other') WHERE rn <= {C.QUALITY_BREAKDOWN_CAP}",
        {**RATED, **_GAP_SQL, **_GRADED},
    ),
)
def quality_breakdown(t: StarTables) -> DataFrame:
    """Latest fifty retrieval events of every grade."""
    rows = u.quality_breakdown(u.graded_events(rated_events(t), **gap_log(t)))
    return rows.select(F.col("quality_grade").alias("grade"), F.col("rn").cast("bigint"), "event_id")


@query(
    "quality_counts",
    with_ctes(
        LOG,
        """SELECT 'risk_state' AS metric, risk_state AS value, count(*) AS n FROM graded GROUP BY ALL UNION ALL SELECT 'action_label', action_label, count(*) FROM graded GROUP BY ALL
UNION ALL SELECT 'quality_grade', grade, count(*) FROM graded GROUP BY ALL UNION ALL SELECT 'follow_up', follow_up, count(*) FROM graded GROUP BY ALL
UNION ALL SELECT 'ai_flagged', CASE WHEN ai_flagged THEN 'true' ELSE 'false' END, count(*) FROM graded GROUP BY ALL""",
        {**RATED, **_GAP_SQL, **_GRADED},
    ),
)
def quality_counts(t: StarTables) -> DataFrame:
    """Counts of every quality measure in one pass."""
    graded = u.graded_events(rated_events(t), **gap_log(t))
    return u.counts(graded, ["risk_state", "action_label", "quality_grade", "follow_up", "ai_flagged"])


@query(
    "log_counts",
    with_ctes(
        LOG,
        """SELECT 'tool' AS metric, tool AS value, count(*) AS n FROM event_log GROUP BY ALL UNION ALL SELECT 'log_source', log_source, count(*) FROM event_log GROUP BY ALL
UNION ALL SELECT 'outcome', outcome, count(*) FROM everything GROUP BY ALL UNION ALL SELECT 'failure_reason', failure_reason, count(*) FROM everything GROUP BY ALL""",
        RATED,
    ),
)
def log_counts(t: StarTables) -> DataFrame:
    """Events per tool and source, outcomes per value and reason."""
    events = u.counts(t.event_log(), ["tool", "log_source"])
    outcomes = u.counts(u.all_outcomes(t.event_log(), t.outcomes()), ["outcome", "failure_reason"])
    return events.unionByName(outcomes)


def _sql_pct(x: str) -> str:
    return f"round(coalesce({x}, 0.0)::DOUBLE * 100, 2)"


def _sql_avg(x: str) -> str:
    return f"round(coalesce(avg({x}), 0.0)::DOUBLE, 2)"


_METRICS = f"""count(outcome) AS outcome_count, count(*) FILTER (outcome = 'success') AS success_count, count(*) FILTER (outcome = 'partial') AS partial_count, count(*) FILTER (outcome = 'failed') AS failed_count,
  {_sql_pct("count(*) FILTER (outcome = 'success') / nullif(count(outcome),0)")} AS success_rate_percent, {_sql_avg('confidence')} AS average_confidence,
  {_sql_pct('count(*) FILTER (primary_owner_present) / nullif(count(*),0)')} AS primary_owner_rate_percent, {_sql_avg('symbol_hits_returned')} AS average_symbol_hits,
  {_sql_avg('location_hints_returned')} AS average_location_hints, {_sql_avg('dependency_chain_returned')} AS average_dependency_hints"""


@query(
    "mode_stats",
    with_ctes(
        LOG,
        f"""SELECT m.mode, count(event_id) AS event_count, {_METRICS}, {_sql_avg('files_returned')} AS average_files_returned, {_sql_avg('vector_candidate_count')} AS average_vector_candidates,
  {_sql_avg('suppressed_vector_count')} AS average_suppressed_vectors, {_sql_pct('sum(suppressed_vector_count) / nullif(sum(vector_candidate_count),0)')} AS suppression_rate_percent
FROM (VALUES ('keyword'),('hybrid_hash'),('hybrid_semantic'),('other')) m(mode) LEFT JOIN rated ON rated.mode = m.mode GROUP BY m.mode""",
        RATED,
    ),
)
def mode_stats(t: StarTables) -> DataFrame:
    """Counts, rates and averages per retrieval mode."""
    return u.mode_stats(rated_events(t))


@query(
    "tool_stats",
    with_ctes(LOG, f"SELECT count(*) AS call_count, {_METRICS}, {_sql_avg('related_files_returned')} AS average_related_files, {_sql_avg('code_blocks_returned')} AS average_code_blocks FROM rated WHERE tool = 'find_code_locations'", RATED),
)
def tool_stats(t: StarTables) -> DataFrame:
    """The same measures for the code-location tool."""
    return u.tool_stats(rated_events(t))


@query(
    "usage_totals",
    with_ctes(
        LOG,
        f"""SELECT * FROM (SELECT count(*) AS total_tool_calls, count(*) FILTER (mode <> 'other') AS total_retrieval_calls, CAST(sum(gap_searches_fired) AS BIGINT) AS total_gap_searches, CAST(sum(gap_files_added) AS BIGINT) AS total_gap_files_added,
  {_sql_pct('count(*) FILTER (gap_searches_fired > 0) / count(*)')} AS gap_search_rate_percent, {_sql_avg('confidence')} AS average_confidence,
  {_sql_avg(f'CASE WHEN tool IN {sql_in(C.FILE_LIST_TOOLS)} THEN files_returned END')} AS average_files_returned FROM rated),
 (SELECT count(*) AS total_outcomes, count(*) FILTER (inferred) AS total_inferred_outcomes, {_sql_pct("count(*) FILTER (outcome = 'success') / count(*)")} AS success_rate_percent,
  {_sql_pct("count(*) FILTER (outcome = 'partial') / count(*)")} AS partial_rate_percent, {_sql_pct("count(*) FILTER (outcome = 'failed') / count(*)")} AS failed_rate_percent,
  {_sql_avg('used_suggested_files')} AS average_used_suggested_files, {_sql_avg('extra_files_read')} AS average_extra_files_read, count(*) FILTER (needed_extra_search) AS extra_search_count,
  {_sql_pct('1.0 - sum(used_suggested_files + extra_files_read) / sum(used_suggested_files + extra_files_read + 10)')} AS file_read_reduction_percent FROM everything)""",
        RATED,
    ),
)
def usage_totals(t: StarTables) -> DataFrame:
    """Overall rates, averages and the file-read reduction."""
    return u.totals(t.event_log(), u.all_outcomes(t.event_log(), t.outcomes()))


_CHARS = "SELECT path, 500 + length(path) * 100 AS chars FROM (SELECT DISTINCT unnest(top_files) AS path FROM event_log)"
_SAVED = {
    "chars": _CHARS,
    "saved": """SELECT event_id, context_chars, CAST(sum(chars) AS BIGINT) AS baseline_chars FROM (
  SELECT event_id, context_chars, unnest(top_files) AS path FROM event_log WHERE context_chars IS NOT NULL) JOIN chars USING (path) GROUP BY ALL""",
}


def file_sizes(t: StarTables) -> DataFrame:
    paths = t.event_log().select(F.explode("top_files").alias("path")).distinct()
    return paths.withColumn("chars", (F.length("path") * 100 + 500).cast("bigint"))


@query("context_savings", with_ctes(["event_log"], "SELECT event_id, context_chars, baseline_chars, round(100.0::DOUBLE * (1 - context_chars / baseline_chars), 1) AS saved_percent FROM saved", _SAVED))
def context_savings(t: StarTables) -> DataFrame:
    """Delivered against full-file characters for every event of the log."""
    return u.context_savings(t.event_log(), file_sizes(t))


@query(
    "overall_savings",
    with_ctes(
        ["event_log"],
        """SELECT count(*) AS sample_size, CAST(sum(context_chars) AS BIGINT) AS total_delivered_chars, CAST(sum(baseline_chars) AS BIGINT) AS total_baseline_chars,
  round(greatest(0.0, least(99.9, 100.0 * (1 - sum(context_chars) / sum(baseline_chars))))::DOUBLE, 2) AS overall_saved_percent FROM saved""",
        _SAVED,
    ),
)
def overall_savings(t: StarTables) -> DataFrame:
    """Ratio of sums over the recent sample."""
    return u.overall_savings(u.context_savings(t.event_log(), file_sizes(t)))


@query(
    "missed_file_resolution",
    with_ctes(
        LOG,
        """SELECT m.outcome_id, m.file, CASE WHEN r.event_id IS NULL THEN 'open_or_not_retested' ELSE 'resolved_by_later_search' END AS status, r.event_id AS resolved_by_event
FROM (SELECT outcome_id, ts, unnest(missed_files) AS file FROM outcomes) m ASOF LEFT JOIN (
  SELECT min(event_id) AS event_id, ts, file FROM (SELECT event_id, ts, unnest(top_files) AS file FROM event_log) GROUP BY ts, file) r ON m.file = r.file AND m.ts < r.ts""",
    ),
)
def missed_file_resolution(t: StarTables) -> DataFrame:
    """As-of join: first later event that returned a missed file."""
    return u.missed_files(t.event_log(), t.outcomes())


@query("recent_events", with_ctes(["event_log"], f"SELECT event_id, tool FROM event_log ORDER BY ts DESC, event_id DESC LIMIT {C.RECENT_LIST_CAP}"))
def recent_events(t: StarTables) -> DataFrame:
    """The latest thousand events."""
    return u.recent(t.event_log()).select("event_id", "tool")


@query(
    "last_n_per_mode",
    with_ctes(["event_log"], f"SELECT mode, rn, event_id FROM (SELECT event_id, {_MODE} AS mode, row_number() OVER (PARTITION BY {_MODE} ORDER BY ts DESC, event_id DESC) AS rn FROM event_log) WHERE rn <= 10"),
)
def last_n_per_mode(t: StarTables) -> DataFrame:
    """Latest ten events of every mode."""
    from wayfind.operators.skew import top_per_key

    rows = top_per_key(t.event_log().withColumn("mode", q.event_mode()), ["mode"], [F.desc("ts"), F.desc("event_id")], 10)
    return rows.select("mode", F.col("rn").cast("bigint"), "event_id")


@query("low_confidence", with_ctes(["event_log"], f"SELECT event_id, round(confidence, 9) AS confidence FROM event_log WHERE confidence < 0.25 ORDER BY ts, event_id LIMIT {C.LOW_CONFIDENCE_CAP}"))
def low_confidence(t: StarTables) -> DataFrame:
    """Earliest searches under the confidence threshold."""
    return u.low_confidence(t.event_log()).select("event_id", F.round("confidence", 9).alias("confidence"))


@query("failed_queries", with_ctes(LOG, f"SELECT event_id, query, tool, failure_reason FROM rated WHERE outcome = 'failed' ORDER BY ts DESC, event_id DESC LIMIT {C.RECENT_LIST_CAP}", RATED))
def failed_queries(t: StarTables) -> DataFrame:
    """Latest failed queries."""
    return u.failed_queries(rated_events(t)).select("event_id", "query", "tool", "failure_reason")


_PROOF_SQL = {
    "bench": "SELECT 'q' || item_id || ' view' AS question, ['f' || item_id || '.cs', 'f' || (item_id + 60) || '.cs'] AS owner_files, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'p' || (item_id % 4) END AS expected_pack, ['m0','m1'] AS modules FROM benchmark",
    "audit": "SELECT event_id, query AS question, ['exact','partial','missed','strong_pass'][event_id % 4 + 1] AS verdict, top_files FROM event_log WHERE tool = 'search_context' AND log_source = 'main'",
    "repo": "SELECT DISTINCT lower(split_part(f,'/',-1)) AS name FROM (SELECT unnest(top_files) AS f FROM event_log) WHERE suffix(f,'.cs')",
    "packed": "SELECT name, CASE WHEN CAST(regexp_extract(name,'\\d+') AS INT) % 2 = 0 THEN 'm0' ELSE 'm1' END AS module, 'p' || (CAST(regexp_extract(name,'\\d+') AS INT) % 5) AS pack FROM repo",
    "byq": "SELECT question AS query, arg_max(verdict, CAST(event_id AS VARCHAR)) AS verdict, arg_max(top_files, CAST(event_id AS VARCHAR)) AS top_files FROM audit GROUP BY question",
    "pj": """SELECT e.event_id, coalesce(a.verdict, bq.verdict, '') AS verdict, coalesce(a.top_files, bq.top_files) AS top_files, b.owner_files, coalesce(b.expected_pack,'') AS expected_pack, b.modules
  FROM event_log e LEFT JOIN audit a USING (event_id) LEFT JOIN byq bq USING (query) LEFT JOIN bench b ON e.query = b.question WHERE coalesce(a.verdict, bq.verdict) IS NOT NULL OR b.question IS NOT NULL""",
    "own": "SELECT event_id, unnest(owner_files) AS name, expected_pack, modules FROM pj",
    "own_repo": "SELECT own.* FROM own JOIN repo USING (name)",
    "own_pack": "SELECT DISTINCT event_id, name FROM (SELECT event_id, name, expected_pack, unnest(modules) AS module FROM own_repo) o JOIN packed p USING (name, module) WHERE p.pack = o.expected_pack",
    "ret": "SELECT DISTINCT event_id FROM own_pack JOIN (SELECT event_id, lower(split_part(unnest(top_files),'/',-1)) AS name FROM pj) USING (event_id, name)",
}


@query(
    "proof_state",
    with_ctes(
        ["event_log"],
        """SELECT event_id, CASE WHEN event_id NOT IN (SELECT event_id FROM own_repo) THEN 'invalid_benchmark' WHEN expected_pack <> '' AND event_id NOT IN (SELECT event_id FROM own_pack) THEN 'confirmed_graph_gap'
  WHEN verdict IN ('exact','strong_pass') THEN 'confirmed_good' WHEN verdict IN ('partial','weak_partial') THEN 'confirmed_partial' ELSE 'confirmed_miss' END AS proof_state, event_id IN (SELECT event_id FROM ret) AS owner_returned FROM pj""",
        _PROOF_SQL,
    ),
)
def proof_state(t: StarTables) -> DataFrame:
    """What the question set and an audit prove about every event."""
    events = t.event_log()
    item = F.col("item_id")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"), F.lit(".cs"))
    bench = t.read("benchmark").select(
        F.concat(F.lit("q"), item.cast("string"), F.lit(" view")).alias("question"),
        F.array(name(item), name(item + 60)).alias("owner_files"),
        F.when(item % 3 == 0, "").otherwise(F.concat(F.lit("p"), (item % 4).cast("string"))).alias("expected_pack"),
        F.array(F.lit("m0"), F.lit("m1")).alias("modules"),
    )
    verdicts = F.array(*[F.lit(v) for v in ("exact", "partial", "missed", "strong_pass")])
    audits = events.where((F.col("tool") == "search_context") & (F.col("log_source") == "main")).select(
        "event_id", F.col("query").alias("question"), F.element_at(verdicts, (F.col("event_id") % 4 + 1).cast("int")).alias("verdict"), "top_files"
    )
    repo = (
        events.select(F.explode("top_files").alias("path")).where(F.col("path").endswith(".cs")).distinct()
        .select(F.lower(F.substring_index("path", "/", -1)).alias("name"), "path")
    )
    number = F.regexp_extract("name", r"\d+", 0).cast("int")
    packed = repo.select(
        "name", F.when(number % 2 == 0, "m0").otherwise("m1").alias("module"), F.concat(F.lit("p"), (number % 5).cast("string")).alias("pack")
    )
    return q.proof_states(events, audits, bench, repo, packed)


# --------------------------------------------------------------------------
# Event-time windows in batch form (engine capability, not part of the original model)
# --------------------------------------------------------------------------


@query(
    "tumbling_windows",
    "SELECT event_type, epoch_ms(date_trunc('day', ts)) // 1000 AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def tumbling_windows(t: StarTables) -> DataFrame:
    """Daily windows per event type."""
    return win.tumbling(t.read("events"), "1 day", ["event_type"]).select(
        "event_type", F.unix_seconds("start").alias("start_s"), "n", F.round("total", 4).alias("total")
    )


@query(
    "sliding_windows",
    """SELECT event_type, s AS start_s, count(*) AS n FROM (SELECT event_type, unnest([epoch_ms(date_trunc('hour', ts)) // 1000, epoch_ms(date_trunc('hour', ts)) // 1000 - 3600]) AS s FROM events) GROUP BY ALL""",
)
def sliding_windows(t: StarTables) -> DataFrame:
    """Two-hour windows every hour per event type."""
    return win.sliding(t.read("events"), "2 hours", "1 hour", ["event_type"]).select("event_type", F.unix_seconds("start").alias("start_s"), "n")


@query(
    "session_windows",
    """SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sid""",
)
def session_windows(t: StarTables) -> DataFrame:
    """Sessions with a thirty-minute gap per user."""
    return win.sessions(t.read("events"), "30 minutes", ["user_id"]).select("user_id", F.unix_micros("start").alias("start_us"), "n")
