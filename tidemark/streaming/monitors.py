"""Streaming queries; each is a function from a (streaming or static) DataFrame to one, so that the same
code runs as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.corpus import redact

PROGRESS_SCHEMA = "seq long, run_id string, type string, model_id string, label string, status string, completed int, total int"


def run_progress(events: DataFrame) -> DataFrame:
    """(run_id, total, completed, label, status): the latest state of each run; update or complete mode.
    State is one row per run."""
    model = F.col("type") == "model"
    return events.groupBy("run_id").agg(
        F.max_by("total", "seq").alias("total"), F.coalesce(F.max(F.when(model, F.col("completed"))), F.lit(0)).alias("completed"),
        F.max_by("label", F.when(model, F.col("seq"))).alias("label"), F.max_by("status", F.when(model, F.col("seq"))).alias("status"),
    )


def redacted_stream(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Arriving documents redacted, with their hits; append mode, no state."""
    return redact(docs, text_col)


def event_windows(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours", group: str = "event_type") -> DataFrame:
    """(window_start, group, events, null_values, last_ts) per tumbling window; rows later than the
    watermark are dropped from a stream, and windows behind it leave the state."""
    kind = events.schema["ts"].dataType.simpleString()  # watermarks need a time with zone; results keep the given type
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy(F.window("ts", window), group)
    out = w.agg(F.count("*").alias("events"), F.count_if(F.col("value").isNull()).alias("null_values"), F.max("ts").alias("last_ts"))
    return out.select(F.col("window.start").cast(kind).alias("window_start"), group, "events", "null_values", F.col("last_ts").cast(kind).alias("last_ts"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "2 hours", group: str = "user_id") -> DataFrame:
    """(group, session_start, session_end, events, null_values): stretches of events less than ``gap`` apart; the end is that of
    the last event. In a stream a session comes out, and leaves the state, once the watermark has passed it by ``gap``."""
    kind = events.schema["ts"].dataType.simpleString()
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), group)
    out = w.agg(F.count("*").alias("events"), F.count_if(F.col("value").isNull()).alias("null_values"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select(group, F.col("first").cast(kind).alias("session_start"), F.col("last").cast(kind).alias("session_end"), "events", "null_values")


def stalled_runs(progress: DataFrame, patience_s: int, watermark: str = "2 hours") -> DataFrame:
    """(run_id, last_ts) of each stretch of more than ``patience_s`` seconds in which an unfinished run made no progress.
    ``progress(run_id, ts, finished)`` is a stream; a run's state is one time, set off by a timer, and leaves when the
    run finishes or is told as stalled. A run that goes on after that can stall again. Events behind the watermark
    are dropped. Of events at one time one that is finished counts last; rows without a run or time are left out."""
    kind = progress.schema["ts"].dataType.simpleString()
    patience = patience_s * 1_000_000

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stalled = []
        if state.hasTimedOut:
            stalled.append(state.get[0])
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            rows = sorted((int(us), bool(done)) for f in frames for us, done in zip(f["us"], f["finished"], strict=True))
            for us, done in rows:
                if last is not None and us - last > patience:
                    stalled.append(last)
                last = None if done else max(us, last or us)
            until = None if last is None else (last + patience) // 1000
            if until is not None and until >= state.getCurrentWatermarkMs():
                state.update((last,))
                state.setTimeoutTimestamp(until + 1)
            else:
                if last is not None:
                    stalled.append(last)
                if state.exists:
                    state.remove()
        yield pd.DataFrame({"run_id": [key[0]] * len(stalled), "us": stalled})

    rows = progress.filter("run_id is not null and ts is not null").select("run_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("finished", F.lit(False)).alias("finished"))
    rows = rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", watermark)
    told = rows.groupBy("run_id").applyInPandasWithState(follow, "run_id string, us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("run_id", F.timestamp_micros("us").cast(kind).alias("last_ts"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, and stop. ``complete`` and ``update`` results are written per
    micro-batch by replacing the table."""
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    q.awaitTermination()
