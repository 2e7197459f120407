"""Streams of usage events: windowed roll-ups and a rate limiter that forgets refused requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.runtime import scratch_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream with an event-time column at."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    return stream.parquet(f"{folder}/{name}*").withColumn("at", F.col("ts").cast("timestamp"))


def rollup(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; a window closes when the watermark has passed it."""
    return events.withWatermark("at", late).groupBy(F.window("at", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def admitted(events: DataFrame, limit: int, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, admitted): at most ``limit`` admitted requests of a user in any ``seconds``.

    State is the times of the admitted requests of the last window, so it is
    bounded by the limit; refused requests leave no trace.  Once the watermark has
    passed a user's last window, the user's state is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values(["second", "event_id"])
            verdict = []
            for t in pdf["second"]:
                recent = [x for x in recent if x > t - seconds]
                verdict.append(len(recent) < limit)
                if verdict[-1]:
                    recent.append(float(t))
            yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "admitted": verdict})
        state.update((recent,))
        if recent:
            end = int((recent[-1] + seconds) * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("at", late).select("user_id", "event_id", "at", (F.unix_micros("at") / 1e6).alias("second"))
    return rows.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, event_id bigint, admitted boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result.

    Appended rows are written as Parquet; a complete result is taken from its last
    batch.  Progress is kept in the shared folder.
    """
    spark = stream.sparkSession
    out, log = scratch_path(spark, "stream"), scratch_path(spark, "stream-log")
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", log)
        q.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
