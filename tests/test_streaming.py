"""Streams give what the batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.operators import usage
from wayfind.sources.logs import OUTCOME_SCHEMA, read_log, stream_log
from wayfind.sources.starschema import StarTables
from wayfind.streaming import outcomes as so
from wayfind.streaming import windows as win
from wayfind.streaming.logs import start_counts

SF = "/root/testdata/sf0.001"


def run(frame, mode, name, tmp_path):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_windows_stream_equals_batch(spark, tmp_path):
    events = StarTables(spark, SF).read("events")
    folder = str(tmp_path / "events")
    events.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(win.tumbling(stream, "1 day", ["event_type"], "40 days"), "complete", "tumbling", tmp_path)
    want = win.tumbling(events, "1 day", ["event_type"])
    key = ["event_type", "start", "n"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_repeated_deliveries_are_dropped(spark, tmp_path):
    events = StarTables(spark, SF).read("events").select("event_id", "ts", "value")
    folder = str(tmp_path / "twice")
    events.unionByName(events).repartition(2).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(win.distinct_events(stream, ["event_id"], "40 days"), "append", "distinct_rows", tmp_path)
    assert got.count() == events.count()


def test_late_outcomes_stream_equals_batch(spark, tmp_path):
    tables = StarTables(spark, SF)
    events, outcomes = tables.event_log(), tables.outcomes()
    rows = so.tagged_rows(events, outcomes)
    folder = str(tmp_path / "rows")
    # outcomes arrive before, with and after their events
    rows.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    updates = []
    query = so.latest_outcomes(stream).writeStream.outputMode("update").foreachBatch(
        lambda df, epoch: updates.extend((epoch, r["event_id"], r["outcome"], r["inferred"]) for r in df.collect())
    ).option("checkpointLocation", str(tmp_path / "late")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    last = {event: (outcome, inferred) for _, event, outcome, inferred in sorted(updates, key=lambda u: u[0])}
    rated = usage.rated_events(events, outcomes).where(F.col("outcome").isNotNull())
    assert last == {str(r["event_id"]): (r["outcome"], r["inferred"]) for r in rated.collect()}


def test_counts_stream(spark, tmp_path):
    tables = StarTables(spark, SF)
    folder = str(tmp_path / "log")
    log = tables.event_log()
    log.write.parquet(folder)
    seen = {}
    query = start_counts(
        spark.readStream.schema(log.schema).parquet(folder), ["tool"],
        lambda df, epoch: seen.update({r["tool"]: r["n"] for r in df.collect()}), str(tmp_path / "cp"), None,
    )
    query.awaitTermination(120)
    assert seen == {r["tool"]: r["count"] for r in log.groupBy("tool").count().collect()}


def test_malformed_lines_are_dropped(spark, tmp_path):
    good = '{"outcome_id":"o1","event_id":"e1","timestamp":"2024-01-01T10:00:00Z","outcome":"success","missed_files":["a"]}'
    (tmp_path / "outcomes_2024_01.jsonl").write_text(good + "\n{ broken\n\n" + good.replace("o1", "o2").replace("2024-01-01T10:00:00Z", "soon") + "\n")
    rows = read_log(spark, str(tmp_path / "outcomes*.jsonl"), OUTCOME_SCHEMA, "test").orderBy("outcome_id").collect()
    assert [(r["outcome_id"], r["ts"] is None, r["log_source"]) for r in rows] == [("o1", False, "test"), ("o2", True, "test")]
    assert stream_log(spark, str(tmp_path), OUTCOME_SCHEMA).isStreaming
