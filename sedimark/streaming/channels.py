"""Streams of events: windowed tallies with late data, and the state of each channel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

STATE = "ewma double, failures bigint, seen bigint"
OUT = "user_id bigint, ewma double, failures bigint, circuit_open boolean, seen bigint"


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of event tables. With a checkpoint a restarted query resumes behind the files it has finished."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tallies(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n and value of windows; rows later than the watermark are dropped, as the stream's contract says."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def channel_states(events: DataFrame, seed: float = 15.0, alpha: float = 0.3, opens_at: int = 3) -> DataFrame:
    """The smoothed value, the failures in a row and whether the circuit is open, of each user after each batch.

    The state of a user is three numbers, however many events there are. Within a batch events are folded in order of time.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ewma, failures, seen = state.get if state.exists else (seed, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind, value in zip(rows["event_type"], rows["value"]):
            ewma = alpha * value + (1 - alpha) * ewma
            failures = failures + 1 if kind == "error" else 0
            seen += 1
        state.update((ewma, failures, seen))
        yield pd.DataFrame({"user_id": [key[0]], "ewma": [ewma], "failures": [failures], "circuit_open": [failures >= opens_at], "seen": [seen]})

    return events.select("user_id", "ts", "event_id", "event_type", "value").groupBy("user_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
