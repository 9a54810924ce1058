"""Run logs as streams: progress, last results and runs that have fallen silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.ground_truth import EVENT


def read_events(spark: SparkSession, folder: str, schema: str = EVENT, files_a_batch: int = 1000) -> DataFrame:
    """Event files as they appear; a writer finishes a file and then moves it here, as files are read once and whole."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def progress(events: DataFrame) -> DataFrame:
    """Running counts by run and status of finished artifacts, for update mode."""
    return events.where("event = 'result'").groupBy("run_id", "status").agg(F.count("*").alias("n"))


def windowed_throughput(events: DataFrame, time: str = "started_at", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Results by window of event time; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col(time).cast("timestamp")).withWatermark("ts", late)
    return timed.where("event = 'result'").groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"), F.avg("inference_seconds").alias("mean_seconds"))


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps of a run the artifact it has started last; a time-out reports it."""
    if state.hasTimedOut:
        (artifact,) = state.get
        state.remove()
        yield pd.DataFrame({"run_id": [key[0]], "artifact_id": [artifact], "status": ["timeout"]})
        return
    open_ = state.get[0] if state.exists else ""
    rows = pd.concat(list(batches)).sort_values("started_at", kind="stable", na_position="first")
    done = rows[rows["event"] == "result"]
    for event, artifact in zip(rows["event"], rows["artifact_id"], strict=True):
        open_ = artifact if event == "start" else "" if artifact == open_ else open_
    if open_:
        state.update((open_,))
        state.setTimeoutDuration(_watch.silence_ms)
    elif state.exists:
        state.remove()
    if len(done):
        yield pd.DataFrame({"run_id": [key[0]] * len(done), "artifact_id": done["artifact_id"].tolist(), "status": done["status"].tolist()})


def watch_runs(events: DataFrame, silence_ms: int = 60_000) -> DataFrame:
    """(run_id, artifact_id, status): results as they come, and timeout for an artifact that was started and has no result within silence_ms. Events of a batch are taken by started_at."""

    def watch(key, batches, state):
        _watch.silence_ms = silence_ms
        yield from _watch(key, batches, state)

    return events.groupBy("run_id").applyInPandasWithState(watch, "run_id string, artifact_id string, status string", "artifact string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drain(spark: SparkSession, folder: str, checkpoint: str, table: str) -> DataFrame:
    """Reads all files there now, once, into a table of the catalogue, from where the checkpoint left off; the last result of each artifact."""
    events = read_events(spark, folder).withColumn("file", F.col("_metadata.file_name"))
    events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table).awaitTermination()
    results = spark.table(table).where("event = 'result'")
    return results.groupBy("run_id", "artifact_id").agg(F.max_by("status", F.struct("started_at", "file")).alias("status"))
