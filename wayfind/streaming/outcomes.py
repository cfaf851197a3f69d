"""Late outcomes as a stateful stream: the latest outcome of every event, whenever it arrives.

An outcome has no deadline, so a stream-stream outer join (which needs a
watermark) would lose late ones.  State is one small row per event and may be
given a time to live; the batch view (``operators.usage``) stays authoritative.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "event_id string, outcome string, outcome_id string, inferred boolean"
STATE = "guess string, seen_event boolean, at long, outcome string, outcome_id string"


def tagged_rows(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Both logs in one shape: events carry the inferred outcome, outcomes their time."""
    from wayfind.operators.quality import inferred_outcome

    left = events.select(
        F.col("event_id").cast("string"), F.lit("event").alias("kind"), inferred_outcome().alias("outcome"),
        F.lit(None).cast("string").alias("outcome_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    right = outcomes.select(
        F.col("event_id").cast("string"), F.lit("outcome").alias("kind"), "outcome", "outcome_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    return left.unionByName(right)


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    guess, seen, at, outcome, outcome_id = state.get if state.exists else (None, False, -1, None, None)
    for rows in batches:
        events = rows[rows["kind"] == "event"]
        if len(events):
            seen, guess = True, events["outcome"].iloc[-1]
        rated = rows[rows["kind"] == "outcome"].sort_values(["at", "outcome_id"])
        if len(rated):
            last = rated.iloc[-1]
            if (last["at"], last["outcome_id"]) > (at, outcome_id or ""):
                at, outcome, outcome_id = int(last["at"]), last["outcome"], last["outcome_id"]
    state.update((guess, seen, at, outcome, outcome_id))
    value = outcome if outcome is not None else guess
    if value is not None:
        yield pd.DataFrame({
            "event_id": [key[0]], "outcome": [value], "outcome_id": [outcome_id], "inferred": [outcome is None],
        })


def latest_outcomes(rows: DataFrame) -> DataFrame:
    """Stream of updates: the current outcome of an event after each batch that touches it."""
    return rows.groupBy("event_id").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
