"""Run events as a stream: the same states as the batch operators, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import CARRIED, RUN_KEYS, latest_model_state, stage_durations

EVENT_SCHEMA = ("run_id string, sequence bigint, ts timestamp_ntz, target string, model_id string, stage string, "
                "status string, fit_seconds double, predict_seconds double")


def read_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def model_states(events: DataFrame, carried=CARRIED, keys=RUN_KEYS) -> DataFrame:
    """The table of ``latest_model_state`` kept up to date, for ``update`` mode.

    State is one row per model run: its newest event and, for each carried field, the newest event that has it.  All are maxima by
    sequence, so events that come late, again or in any order leave the same state.
    """
    return latest_model_state(events, carried, keys)


def stage_states(events: DataFrame) -> DataFrame:
    """The table of ``stage_durations`` kept up to date, for ``update`` mode; the state of a run is the first time of each stage and the last event."""
    return stage_durations(events)


def finished_counts(events: DataFrame) -> DataFrame:
    """Models that have reached success or failed, per run.

    The state of a run is the set of its finished models; a run has as many as
    its model grid, whatever the number of events.
    """
    done = F.col("status").isin("success", "failed")
    models = F.collect_set(F.struct("target", "model_id"))
    return events.where(done).groupBy("run_id").agg(F.size(models).alias("completed"))


def follow(events: DataFrame, sink, checkpoint: str, mode: str = "update", once: bool = True) -> StreamingQuery:
    """Send every micro-batch to ``sink(df, batch_id)``.  The checkpoint is the cursor: a restart goes on after it."""
    writer = events.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
