"""Sessions and screening over streams of turns and events."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.config import SETTINGS
from docloom.functions import guardrails as gr
from docloom.sources.files import scratch_root

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files of a folder as a stream, event time as ``ts``."""
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def read_table(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The whole table at ``path``, one file or a folder of part files, as a stream, event time as ``ts``."""
    # A path that is a pattern may be one file; a plain one has to be a folder.
    exact = re.sub(r"([\\*?\[\]{}])", r"\\\1", path[:-1]) + f"[{path[-1]}]"
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(exact)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Sessions by idle gap with their bounds and counts.

    Rows later than the watermark are lost and state older than it is dropped,
    in every output mode; with ``late`` None all rows count, in any order.
    """
    return (
        (events if late is None else events.withWatermark("ts", late))
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value")
    )


def tumbling_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"), "event_type")
        .agg(F.count("*").alias("n_events"))
        .select(F.col("w.start").alias("start"), "event_type", "n_events")
    )


def screened_turns(turns: DataFrame, column: str = "text") -> DataFrame:
    """Turns of a stream with their verdicts: stateless, so the batch expressions serve."""
    return gr.screen(turns, column)


def rolling_memory(turns: DataFrame, keep: int = 10) -> DataFrame:
    """The last ``keep`` non-blank messages of each conversation, updated with every batch of turns."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            for r in batch.sort_values("turn").itertuples():
                if (r.text or "").strip():
                    held.append(f"{r.role}\t{r.text.strip()}")
        held = held[-keep:]
        state.update((held,))
        yield pd.DataFrame({"conv_id": [key[0]], "n": [len(held)], "messages": [held]})

    return turns.groupBy("conv_id").applyInPandasWithState(
        update, "conv_id bigint, n int, messages array<string>", "messages array<string>", "update", "NoTimeout"
    )


def session_memory(turns: DataFrame, keep: int = SETTINGS.memory_max_messages, ttl_s: int = SETTINGS.session_ttl_s, late: str = "10 minutes") -> DataFrame:
    """The last ``keep`` non-blank messages of each live session of ``turns`` (``session_id, turn, ts, role, text``).

    A session that was idle for over ``ttl_s`` seconds begins anew with its next
    turn; its state leaves once the watermark is past that time. Turns count in
    the order of ``ts`` and ``turn`` inside a batch, blank ones keep a session
    alive; those later than the watermark are lost. Each batch gives a row for
    each session it touches: ``session_id, last_seen, n, messages``. How many
    sessions stay is a global order, which ``memory.live_sessions`` makes of
    ``last_seen``.
    """
    out = "session_id string, last_seen timestamp, n int, messages array<string>"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, held = state.get if state.exists else (None, [])
        held = list(held)
        turns_now = pd.concat(list(batches)).sort_values(["ts", "turn"], kind="stable")
        for r in turns_now.itertuples():
            at = r.ts.value // 1000
            if seen is not None and at - seen > ttl_s * 1_000_000:
                held = []
            seen = at if seen is None else max(seen, at)
            said = (r.text or "").strip()
            held = [*held, f"{r.role}\t{said}"][-keep:] if said else held
        state.update((seen, held))
        # The first moment at which any further turn would find the session idle for too long.
        state.setTimeoutTimestamp(max(seen // 1000 + ttl_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "last_seen": [pd.Timestamp(seen, unit="us")], "n": [len(held)], "messages": [held]})

    live = turns.select("session_id", "turn", "ts", "role", "text").where("session_id is not null and ts is not null").withWatermark("ts", late)
    return live.groupBy("session_id").applyInPandasWithState(update, out, "last_seen bigint, messages array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def append_sessions(events: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", late: str = "10 minutes"):
    """Start a stream that appends sessions to a Parquet table as the watermark closes them; closed ones leave the state."""
    closed = session_counts(events, gap, late)
    return closed.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


def sessions_of_folder(spark: SparkSession, path: str) -> DataFrame:
    """All sessions of a folder's events table, by running the stream to its end.

    Output is complete and no watermark is set, so every event counts whatever
    files it lies in and whatever order they are read in. Executors write each
    batch's result to the shared folder; the last one is read back.
    """
    root = f"{scratch_root(spark)}/docloom-sessions-{uuid.uuid4().hex}"

    def write(sessions: DataFrame, number: int) -> None:
        sessions.write.mode("overwrite").parquet(f"{root}/batch={number}")

    counted = session_counts(read_table(spark, f"{path}/events.parquet"), late=None)
    query = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # there was no file to read
        return spark.createDataFrame([], counted.schema)
    return spark.read.schema(counted.schema).parquet(f"{root}/batch={query.lastProgress['batchId']}")
