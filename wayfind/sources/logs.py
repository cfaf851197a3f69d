"""Event and outcome logs: schemas, batch and streaming readers, validated appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind import constants as C

EVENT_SCHEMA = (
    "event_id string, timestamp string, tool string, query string, arguments string, latency_ms int, confidence double, "
    "retrieval_mode string, rag_used boolean, embedding_backend string, vector_candidate_count int, suppressed_vector_count int, "
    "files_returned int, symbol_hits_returned int, location_hints_returned int, dependency_chain_returned int, related_files_returned int, "
    "code_blocks_returned int, primary_owner_present boolean, top_files array<string>, gap_searches_fired int, gap_files_added int, "
    "context_chars bigint, analysis_relevance_check string, analysis_confidence string, analysis_parse_incomplete boolean, "
    "analysis_parse_error boolean, ranking_profile string"
)
OUTCOME_SCHEMA = (
    "outcome_id string, event_id string, timestamp string, outcome string, used_suggested_files int, extra_files_read int, "
    "needed_extra_search boolean, missed_files array<string>, missed_file_count int, failure_reason string, notes string"
)


def _timed(df: DataFrame, source: str) -> DataFrame:
    """ISO text becomes a timestamp; an unreadable time is null, not an error."""
    return df.withColumn("ts", F.try_to_timestamp("timestamp")).withColumn("log_source", F.lit(source))


def read_log(spark: SparkSession, pattern: str, schema: str, source: str = "main") -> DataFrame:
    """JSON lines of all months; malformed lines are dropped."""
    return _timed(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern), source)


def read_tagged(spark: SparkSession, sources: dict[str, str], schema: str) -> DataFrame:
    """Several log folders united, each row tagged with its source."""
    parts = [read_log(spark, pattern, schema, name) for name, pattern in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stream_log(spark: SparkSession, folder: str, schema: str, source: str = "main", max_files: int = 1000) -> DataFrame:
    """The same log as a stream of appended files."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("mode", "DROPMALFORMED").json(folder)
    return _timed(raw, source)


def append_log(rows: DataFrame, folder: str) -> None:
    """Append, partitioned by month (the month columns are derived from ``ts``)."""
    dated = rows.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    dated.write.mode("append").partitionBy("year", "month").json(folder)


def valid_outcomes(rows: DataFrame, note_chars: int | None = None) -> DataFrame:
    """Normalised outcomes; a value outside the allowed sets fails the job.  Notes are kept whole unless ``note_chars`` is given."""
    notes = F.coalesce("notes", F.lit(""))
    outcome = F.lower(F.trim("outcome"))
    reason = F.lower(F.trim(F.coalesce("failure_reason", F.lit("none"))))

    def checked(value: Column, allowed: tuple[str, ...], name: str) -> Column:
        message = F.concat(F.lit(f"{name} must be one of {', '.join(allowed)}: "), value)
        return F.when(value.isin(*allowed), value).otherwise(F.raise_error(message).cast("string"))

    return rows.select(
        *[c for c in rows.columns if c not in (
            "outcome", "failure_reason", "used_suggested_files", "extra_files_read", "notes", "missed_file_count", "needed_extra_search")],
        checked(outcome, C.OUTCOME_VALUES, "outcome").alias("outcome"),
        checked(reason, C.FAILURE_REASONS, "failure_reason").alias("failure_reason"),
        F.greatest(F.lit(0), F.coalesce("used_suggested_files", F.lit(0))).alias("used_suggested_files"),
        F.greatest(F.lit(0), F.coalesce("extra_files_read", F.lit(0))).alias("extra_files_read"),
        F.coalesce("needed_extra_search", F.lit(False)).alias("needed_extra_search"),
        (notes if note_chars is None else F.substring(notes, 1, note_chars)).alias("notes"),
        F.coalesce(F.size("missed_files"), F.lit(0)).alias("missed_file_count"),
    )


def keyed_rows(spark: SparkSession, path: str | list[str], schema: str, key: str, multi_line: bool = True) -> DataFrame:
    """JSON side input; the last row of a key wins, in the order of file names and of rows within a file.

    A large file of JSON lines is read in splits: a row is placed by its file, the start of its split and its number in
    the task, which grows along the split.  Rows without key drop out.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).option("mode", "DROPMALFORMED").json(path)
    columns = [c for c in rows.columns if c != key]
    placed = rows.where(F.col(key).isNotNull()).select("*", place.alias("_place"))
    return placed.groupBy(key).agg(F.max_by(F.struct(*columns), "_place").alias("r")).select(key, "r.*")


def load_rules(spark: SparkSession, paths: list[str]) -> list[dict]:
    """Ranking rules of all rule files in order; rules are configuration, so they are read on the driver."""
    import json
    import os

    rules: list[dict] = []
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as handle:
                rules += json.load(handle).get("semantic_rules") or []
    return rules
