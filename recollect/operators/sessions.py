"""Conversations and sessions in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.scalar import never_recalls, strip, summary_text


def distill(turns: DataFrame) -> DataFrame:
    """A user turn with the assistant turn right after it, as one text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w)).where("role = 'user' AND next_role = 'assistant'")
    return paired.select("conv_id", "turn", F.concat(F.lit("User: "), F.substring("text", 1, 500), F.lit("\nAssistant: "), F.substring("reply", 1, 1000)).alias("content"))


def counters(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turn_count"), F.count_if(F.col("role") == "assistant").alias("observation_count"))


def gate(turns: DataFrame) -> DataFrame:
    """User turns with whether recall fires: not blank, trivial or a command, and not the prompt recalled last (both stripped).

    A prompt that may recall either fires or repeats the one recalled last, so that one is always the previous prompt that
    may recall, and a lag over those alone is the fold over the session."""
    w = Window.partitionBy("conv_id", "able").orderBy("turn")
    users = turns.where("role = 'user'").select("conv_id", "turn", strip(F.col("text")).alias("prompt"), (~never_recalls(F.col("text"))).alias("able"))
    return users.select("conv_id", "turn", (F.col("able") & ~F.coalesce(F.lag("prompt").over(w) == F.col("prompt"), F.lit(False))).alias("fires"))


def topic_gate(prompts: DataFrame, session: str, order: str, vector: str, threshold: float = 0.7) -> DataFrame:
    """`prompts` with `fires`: the first of a session, and each whose cosine with the one recalled last is below `threshold`.

    Feedback makes this a fold: sessions are dealt over tasks and read in order, holding one vector at a time."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for frame in frames:
            fires = []
            for key, vec in zip(frame[session], frame[vector]):
                v = np.asarray(vec, dtype=np.float64)
                norm = 0.0 if key != now or last is None else float(np.linalg.norm(v) * np.linalg.norm(last))
                fired = key != now or last is None or (float(v @ last) / norm if norm else 0.0) < threshold
                fires.append(fired)
                now, last = key, v if fired else last
            yield frame.assign(fires=fires)

    return prompts.repartition(session).sortWithinPartitions(session, order).mapInPandas(scan, T.StructType([*prompts.schema.fields, T.StructField("fires", T.BooleanType())]))


def strategies(turns: DataFrame) -> DataFrame:
    """Whether recall fires for user turns under the strategies that need no vectors."""
    return gate(turns).select("conv_id", "turn", F.lit(False).alias("session_only"), F.col("fires").alias("every_prompt"))


def summaries(turns: DataFrame) -> DataFrame:
    """conv_id and the text kept at the end of a session; sessions without an answer keep none."""
    answered = F.col("role") == "assistant"
    ended = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.count_if(F.col("role") == "tool").alias("observations"), F.max_by(F.when(answered, F.col("text")), F.when(answered, F.col("turn"))).alias("last"))
    return ended.where("coalesce(last, '') <> ''").select("conv_id", summary_text(F.col("turns"), F.col("observations"), F.col("last")).alias("content"))
