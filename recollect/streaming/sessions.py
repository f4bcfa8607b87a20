"""Streaming forms: the event log by windows, progress frames and per-key session state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.operators.events import frames

STATE = "turn_count bigint, observation_count bigint, last_prompt string"
OUT = "conv_id bigint, turn_count bigint, observation_count bigint, last_prompt string"


def event_windows(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and type, late rows bounded by a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def progress(spans: DataFrame) -> DataFrame:
    return frames(spans)


def session_state(turns: DataFrame) -> DataFrame:
    """Counters and last prompt of each conversation, updated with every batch; state lapses after a day without turns."""

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turns_, seen, last = state.get if state.exists else (0, 0, None)
        for part in rows:
            part = part.sort_values("turn")
            turns_ += int((part["role"] == "user").sum())
            seen += int((part["role"] == "assistant").sum())
            prompts = part.loc[part["role"] == "user", "text"]
            last = prompts.iloc[-1] if len(prompts) else last
        state.update((turns_, seen, last))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame({"conv_id": [key[0]], "turn_count": [turns_], "observation_count": [seen], "last_prompt": [last]})

    return turns.groupBy("conv_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
