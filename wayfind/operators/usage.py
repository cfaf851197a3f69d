"""Usage statistics: outcome resolution, missed files, savings, counters, recent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions.paths import slashed
from wayfind.operators import quality
from wayfind.operators.skew import ranked_top

OUTCOME_COLUMNS = ["outcome_id", "outcome", "used_suggested_files", "extra_files_read", "failure_reason"]


def last_outcomes(outcomes: DataFrame) -> DataFrame:
    """Latest outcome of every event (an aggregate, not a per-key sort)."""
    rank = F.struct("ts", "outcome_id")
    columns = [c for c in outcomes.columns if c != "event_id"]
    picked = outcomes.groupBy("event_id").agg(F.max_by(F.struct(*columns), rank).alias("o"))
    return picked.select("event_id", "o.*")


def inferred_outcomes(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes deduced for events nobody rated."""
    unrated = events.join(outcomes.select("event_id").distinct(), "event_id", "left_anti")
    guess = quality.inferred_outcome()
    fired = F.coalesce("gap_searches_fired", F.lit(0))
    return unrated.where(guess.isNotNull()).select(
        F.concat(F.lit("inferred_"), F.col("event_id").cast("string")).alias("outcome_id"),
        "event_id",
        "ts",
        guess.alias("outcome"),
        F.coalesce("files_returned", F.lit(0)).cast("int").alias("used_suggested_files"),
        F.lit(0).alias("extra_files_read"),
        (fired > 0).alias("needed_extra_search"),
        F.lit("none").alias("failure_reason"),
        F.array().cast("array<string>").alias("missed_files"),
    )


def all_outcomes(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("inferred", F.lit(False)).unionByName(
        inferred_outcomes(events, outcomes).withColumn("inferred", F.lit(True))
    )


def rated_events(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every event with its deciding outcome: the last recorded one, else the inferred one."""
    recorded = last_outcomes(outcomes).select("event_id", *OUTCOME_COLUMNS)
    joined = events.join(recorded, "event_id", "left")
    guess = quality.inferred_outcome()
    open_event = F.col("outcome_id").isNull()
    return joined.select(
        *events.columns,
        F.when(open_event, guess).otherwise(F.col("outcome")).alias("outcome"),
        (open_event & guess.isNotNull()).alias("inferred"),
        F.when(open_event & guess.isNotNull(), F.coalesce("files_returned", F.lit(0)).cast("int"))
        .otherwise(F.col("used_suggested_files")).alias("used_suggested_files"),
        F.when(open_event & guess.isNotNull(), F.lit(0)).otherwise(F.col("extra_files_read")).alias("extra_files_read"),
        F.when(open_event & guess.isNotNull(), F.lit("none")).otherwise(F.col("failure_reason")).alias("failure_reason"),
    )


# --------------------------------------------------------------------------
# As-of: first later event that returned a missed file
# --------------------------------------------------------------------------


def first_later(
    left: DataFrame, right: DataFrame, key: str, keys: list[str], payload: list[str], bucket_seconds: int = 3600
) -> DataFrame:
    """For every left row the first right row of the same key that is strictly later.

    Time is cut into buckets.  Right rows are reduced to the first row per instant
    and, per (key, bucket), to the bucket's first row; a left row looks for a later
    row in its own bucket and else takes the first row of the next filled bucket.
    A hot key is thereby spread over its time buckets: no task sorts all rows of a
    key, and no row is paired with every later one.  Both frames carry ``ts``.
    """
    width = F.lit(bucket_seconds * 1_000_000)

    def micros(df: DataFrame) -> DataFrame:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        return df.withColumn("_at", at).withColumn("_bucket", F.floor(at / width))

    rows = micros(right).select(key, "_at", "_bucket", F.struct(*payload).alias("_row"))
    instants = rows.groupBy(key, "_bucket", "_at").agg(F.min("_row").alias("_row"))
    heads = instants.groupBy(key, "_bucket").agg(F.min(F.struct("_at", "_row")).alias("_head"))
    probes = micros(left)
    # one row per (key, bucket) on either side: the window below runs over buckets, not over rows
    filled = heads.select(key, "_bucket", "_head").unionByName(
        probes.select(key, "_bucket").distinct().withColumn("_head", F.lit(None).cast(heads.schema["_head"].dataType))
    ).groupBy(key, "_bucket").agg(F.max("_head").alias("_head"))
    ahead = Window.partitionBy(key).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    following = filled.select(key, "_bucket", F.first("_head", ignorenulls=True).over(ahead).alias("_next"))
    # inside a bucket: left and right rows in one time order, the next right row for every left row
    tagged = probes.select(key, "_bucket", "_at", F.struct(*keys).alias("_left"), F.lit(None).cast(heads.schema["_head"].dataType["_row"].dataType).alias("_row")).unionByName(
        instants.select(key, "_bucket", "_at", F.lit(None).cast(probes.select(F.struct(*keys).alias("x")).schema["x"].dataType).alias("_left"), "_row")
    )
    later = Window.partitionBy(key, "_bucket").orderBy("_at").rangeBetween(1, Window.unboundedFollowing)
    found = F.first(F.when(F.col("_row").isNotNull(), F.struct("_at", "_row")), ignorenulls=True).over(later)
    inside = tagged.withColumn("_hit", found).where(F.col("_left").isNotNull())
    joined = inside.join(following, [key, "_bucket"], "left")
    hit = F.coalesce("_hit", "_next")
    return joined.select(key, "_left.*", hit["_row"].alias("_row")).select(
        key, *keys, *[F.col(f"_row.{c}").alias(f"next_{c}") for c in payload]
    )


def missed_files(events: DataFrame, outcomes: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Every missed file of an outcome and the first later event that returned it, if any.

    Where a time is missing nothing says that the event was earlier: an outcome without time is resolved by the first event with
    the file, and an event without time resolves what no dated event does.
    """
    wanted = outcomes.select("outcome_id", "ts", F.explode(F.array_distinct("missed_files")).alias("file")).withColumn(
        "file", F.lower(slashed(F.col("file")))
    )
    returned = events.select("event_id", "ts", F.explode(F.array_distinct("top_files")).alias("file")).withColumn(
        "file", F.lower(slashed(F.col("file")))
    )
    dated = first_later(wanted.where("ts is not null"), returned.where("ts is not null"), "file", ["outcome_id"], ["event_id"], bucket_seconds)
    dated = dated.select("outcome_id", "file", "next_event_id", F.lit(True).alias("_dated"))
    undated = wanted.where("ts is null").select("outcome_id", "file", F.lit(None).cast(dated.schema["next_event_id"].dataType).alias("next_event_id"), F.lit(False).alias("_dated"))
    found = returned.groupBy("file").agg(
        F.min_by("event_id", F.struct(F.col("ts").isNull(), "ts", "event_id")).alias("_any"), F.min(F.when(F.col("ts").isNull(), F.col("event_id"))).alias("_undated")
    )
    rows = dated.unionByName(undated).join(found, "file", "left")
    resolved = rows.withColumn("next_event_id", F.coalesce("next_event_id", F.when(~F.col("_dated"), F.col("_any")), "_undated"))
    status = F.when(F.col("next_event_id").isNull(), "open_or_not_retested").otherwise("resolved_by_later_search")
    return resolved.select("outcome_id", "file", status.alias("status"), F.col("next_event_id").alias("resolved_by_event"))


# --------------------------------------------------------------------------
# Aggregates
# --------------------------------------------------------------------------


def percent(value: Column) -> Column:
    return F.round(F.coalesce(value, F.lit(0.0)) * 100, 2)


def average(column: str | Column) -> Column:
    return F.round(F.coalesce(F.avg(column), F.lit(0.0)), 2)


def _share(condition: Column, over: Column | None = None) -> Column:
    total = F.count(F.lit(1)) if over is None else F.count(F.when(over, 1))
    return percent(F.count(F.when(condition, 1)) / F.nullif(total, F.lit(0)))


def _outcome_metrics() -> list[Column]:
    rated = F.col("outcome").isNotNull()
    return [
        F.count(F.when(rated, 1)).alias("outcome_count"),
        *[F.count(F.when(F.col("outcome") == o, 1)).alias(f"{o}_count") for o in C.OUTCOME_VALUES],
        _share(F.col("outcome") == "success", rated).alias("success_rate_percent"),
        average("confidence").alias("average_confidence"),
        _share(F.col("primary_owner_present")).alias("primary_owner_rate_percent"),
        average(F.coalesce("symbol_hits_returned", F.lit(0))).alias("average_symbol_hits"),
        average(F.coalesce("location_hints_returned", F.lit(0))).alias("average_location_hints"),
        average(F.coalesce("dependency_chain_returned", F.lit(0))).alias("average_dependency_hints"),
    ]


def mode_stats(rated: DataFrame) -> DataFrame:
    """One row per retrieval mode; the four fixed modes are present even without events."""
    vectors, dropped = F.sum("vector_candidate_count"), F.sum("suppressed_vector_count")
    stats = rated.groupBy(quality.event_mode().alias("mode")).agg(
        F.count(F.lit(1)).alias("event_count"),
        *_outcome_metrics(),
        average(F.coalesce("files_returned", F.lit(0))).alias("average_files_returned"),
        average(F.coalesce("vector_candidate_count", F.lit(0))).alias("average_vector_candidates"),
        average(F.coalesce("suppressed_vector_count", F.lit(0))).alias("average_suppressed_vectors"),
        percent(dropped / F.nullif(vectors, F.lit(0))).alias("suppression_rate_percent"),
    )
    fixed = rated.sparkSession.createDataFrame([(m,) for m in C.RETRIEVAL_MODES], "mode string")
    missing = fixed.join(stats.select("mode"), "mode", "left_anti")
    blanks = [F.lit(0).cast(t).alias(c) for c, t in stats.dtypes if c != "mode"]
    return stats.unionByName(missing.select("mode", *blanks))


def tool_stats(rated: DataFrame, tool: str = "find_code_locations") -> DataFrame:
    """The same measures for one tool, in one row."""
    return rated.where(F.col("tool") == tool).agg(
        F.count(F.lit(1)).alias("call_count"),
        *_outcome_metrics(),
        average(F.coalesce("related_files_returned", F.lit(0))).alias("average_related_files"),
        average(F.coalesce("code_blocks_returned", F.lit(0))).alias("average_code_blocks"),
    )


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value, n) for several columns in one pass; the rows are expanded map-side only."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns
    ])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.metric", "p.value").agg(F.count(F.lit(1)).alias("n"))


def totals(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Overall rates and averages in one row."""
    listing = F.when(F.col("tool").isin(*C.FILE_LIST_TOOLS), F.coalesce("files_returned", F.lit(0)))
    fired = F.coalesce("gap_searches_fired", F.lit(0))
    of_events = events.agg(
        F.count(F.lit(1)).alias("total_tool_calls"),
        F.count(F.when(quality.is_retrieval(), 1)).alias("total_retrieval_calls"),
        F.sum(fired).alias("total_gap_searches"),
        F.sum(F.coalesce("gap_files_added", F.lit(0))).alias("total_gap_files_added"),
        _share(fired > 0).alias("gap_search_rate_percent"),
        average("confidence").alias("average_confidence"),
        average(listing).alias("average_files_returned"),
    )
    used, extra = F.coalesce("used_suggested_files", F.lit(0)), F.coalesce("extra_files_read", F.lit(0))
    read = F.sum(used + extra)
    of_outcomes = outcomes.agg(
        F.count(F.lit(1)).alias("total_outcomes"),
        F.count(F.when(F.col("inferred"), 1)).alias("total_inferred_outcomes"),
        *[_share(F.col("outcome") == o).alias(f"{o}_rate_percent") for o in C.OUTCOME_VALUES],
        average(used).alias("average_used_suggested_files"),
        average(extra).alias("average_extra_files_read"),
        F.count(F.when(F.col("needed_extra_search"), 1)).alias("extra_search_count"),
        percent(F.lit(1.0) - read / F.nullif(F.sum(used + extra + 10), F.lit(0))).alias("file_read_reduction_percent"),
    )
    # two one-row frames, put side by side
    left = of_events.withColumn("_one", F.lit(1))
    return left.join(of_outcomes.withColumn("_one", F.lit(1)), "_one").drop("_one")


def context_savings(events: DataFrame, file_chars: DataFrame, window: int | None = None) -> DataFrame:
    """Delivered versus full-file characters, one row per event, over the whole log.

    ``window`` restricts it to that many latest events (``SAVINGS_SAMPLE_WINDOW`` is the usual recent sample).
    """
    if window is not None:
        events = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(window)
    measured = events.where(F.col("context_chars").isNotNull())
    paths = measured.select("event_id", "context_chars", F.explode("top_files").alias("path"))
    sized = paths.join(file_chars.select("path", "chars"), "path", "left")
    per_event = sized.groupBy("event_id", "context_chars").agg(F.sum(F.coalesce("chars", F.lit(0))).alias("baseline_chars"))
    saved = F.round(F.lit(100.0) * (1 - F.col("context_chars") / F.col("baseline_chars")), 1)
    return per_event.where(F.col("baseline_chars") > 0).withColumn("saved_percent", saved)


def overall_savings(rows: DataFrame) -> DataFrame:
    delivered, baseline = F.sum("context_chars"), F.sum("baseline_chars")
    ratio = F.lit(100.0) * (1 - delivered / F.nullif(baseline, F.lit(0)))
    return rows.agg(
        F.count(F.lit(1)).alias("sample_size"),
        delivered.alias("total_delivered_chars"),
        baseline.alias("total_baseline_chars"),
        F.round(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(99.9), ratio)), F.lit(0.0)), 2).alias("overall_saved_percent"),
    )


def recent(df: DataFrame, limit: int = C.RECENT_LIST_CAP) -> DataFrame:
    """The latest rows, newest first (take-ordered)."""
    return df.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def graded_events(rated: DataFrame, proof: DataFrame | None = None, **gap: Column) -> DataFrame:
    """Every event with risk, grade, badges, follow-up and AI flag."""
    risky = quality.with_risk(rated, **gap)
    recorded = F.when(~F.col("inferred"), F.col("outcome"))
    flagged = recorded.isin("partial", "failed") & ~F.lower(F.trim(F.coalesce("failure_reason", F.lit("")))).isin("", "none")
    with_proof = risky.join(proof, "event_id", "left") if proof is not None else risky.withColumn("proof_state", F.lit(None).cast("string"))
    graded = with_proof.withColumn("quality_grade", quality.quality_grade()).withColumn(
        "ai_flagged", F.coalesce(flagged, F.lit(False))
    )
    return graded.select(
        "*",
        quality.evidence_badges().alias("evidence_badges"),
        quality.follow_up(F.col("quality_grade"), F.col("risk_state"), recorded, F.col("ai_flagged"), F.col("proof_state")).alias("follow_up"),
        quality.is_retrieval().alias("is_retrieval"),
    )


def quality_breakdown(graded: DataFrame, limit: int = C.QUALITY_BREAKDOWN_CAP) -> DataFrame:
    """Latest retrieval events of every grade."""
    from wayfind.operators.skew import top_per_key

    return top_per_key(graded.where("is_retrieval"), ["quality_grade"], [F.desc("ts"), F.desc("event_id")], limit)


def low_confidence(events: DataFrame, limit: int = C.LOW_CONFIDENCE_CAP, below: float = 0.25) -> DataFrame:
    """Earliest events under the confidence threshold."""
    return ranked_top(events.where(F.col("confidence") < below), [F.asc("ts"), F.asc("event_id")], limit)


def failed_queries(rated: DataFrame, limit: int = C.RECENT_LIST_CAP) -> DataFrame:
    return recent(rated.where(F.col("outcome") == "failed"), limit)
