"""Incremental runs. The stream source's checkpoint replaces "items after a time":
every run with ``availableNow`` handles what arrived since the last one."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowloom.operators.actions import Action, build_receipts, run_action
from rowloom.functions.ids import receipt_stream_id, stream_item_id
from rowloom.functions.inputs import bind_inputs
from rowloom.operators.jobs import resolve_jobs, split_cancelled, validate_jobs
from rowloom.sinks.receipts import write_batch_receipts

log = logging.getLogger(__name__)


def read_new_files(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Streaming read of a folder, or of a pattern such as ``{name}.parquet`` that may
    match single files; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Hand every available micro-batch to ``each`` and stop; how many rows came after their
    watermark, by which stateful steps leave them out."""
    query = (
        df.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    late = sum(state["numRowsDroppedByWatermark"] for said in query.recentProgress for state in said["stateOperators"])
    if late:
        log.warning("%d rows came after their watermark and were left out", late)
    return late


def bind_stream_items(events: DataFrame, jobs: DataFrame, fields: Column, event_key: str | None = None) -> DataFrame:
    """Events of the jobs' streams with bound inputs, one row per (job, event).

    Jobs are checked as in a whole run: only valid stream jobs that aren't cancelled take
    part. ``event_key`` is a number that tells events of one millisecond apart; without it
    the time is the only key, and a later event of the same time takes the place.
    """
    kind = None if "job_type" in jobs.columns else "run_on_stream"
    checked = validate_jobs(resolve_jobs(jobs, kind)).filter(F.col("reject_reason").isNull())
    going, _cancelled = split_cancelled(checked.filter(F.col("job_type") == "run_on_stream"))
    side = going.select(
        F.col("object_id").alias("job_id"), "hostname", "username", "stream_id", "input_data"
    )
    joined = events.withColumnRenamed("object_id", "event_object_id") if "object_id" in events.columns else events
    joined = joined.join(side, "stream_id", "inner")
    return joined.select(
        "job_id",
        receipt_stream_id(F.col("hostname"), F.col("username"), F.col("job_id")).alias("receipt_stream"),
        stream_item_id(F.col("stream_id"), F.col("timestamp")).alias("item_id"),
        "hostname",
        "username",
        "timestamp",
        F.col(event_key or "timestamp").cast("bigint").alias("seq"),
        bind_inputs(
            F.col("input_data"), fields, {"stream_id": F.col("stream_id"), "timestamp": F.col("timestamp")}
        ).alias("inputs"),
    ).withColumnRenamed("receipt_stream", "stream_id")


def run_on_stream_incremental(
    events: DataFrame,
    jobs: Callable[[], DataFrame],
    action: Action,
    fields: Column,
    out: str,
    checkpoint: str,
    event_key: str | None = None,
    repeats_within: str | None = None,
) -> int:
    """Run an action on every new event of the jobs' streams and write receipts; how many events
    came too late to be handled.

    ``jobs`` is read again at every micro-batch, so a job cancelled meanwhile gets
    no more items. Receipts carry the item's own time and go to a folder per batch,
    so a replay after a lost executor or a restart leaves one receipt per item. The write is
    where the actions run: if it fails, the batch fails and is handled again.

    ``repeats_within`` (such as "1 hour") is how far apart in their own time copies of one event,
    by stream and ``event_key`` or time, may arrive: the first is handled, in whatever file
    or run the others come. An event that is older than all seen by more than that is late: it
    is counted, as nothing is remembered that far back. Without it every event is handled.
    """
    if repeats_within is not None:
        key = ["stream_id", event_key or "timestamp"]
        timed = events.withColumn("_time", F.timestamp_millis("timestamp")).withWatermark("_time", repeats_within)
        events = timed.dropDuplicatesWithinWatermark(key).drop("_time")

    def each(batch: DataFrame, batch_id: int) -> None:
        bound = bind_stream_items(batch, jobs(), fields, event_key)
        results = run_action(bound, action, hostname=F.col("hostname"), username=F.col("username"))
        write_batch_receipts(build_receipts(results, F.col("timestamp")), out, batch_id)

    return drain(events, each, checkpoint)


def live_counts(receipts: DataFrame, out: str, checkpoint: str) -> None:
    """Keep counters per job current while receipts arrive.

    The state is one small row per job. Each batch writes the jobs that changed;
    ``read_live_counts`` takes the newest row of each.
    """
    counts = receipts.groupBy("job_id").agg(
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
    )
    drain(counts, lambda batch, batch_id: _write(batch, out, batch_id), checkpoint, mode="update")


def _write(batch: DataFrame, out: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def read_live_counts(spark: SparkSession, out: str) -> DataFrame:
    newest = spark.read.parquet(out).groupBy("job_id").agg(
        F.max_by(F.struct("success_count", "error_count"), "batch_id").alias("_c")
    )
    return newest.select("job_id", "_c.success_count", "_c.error_count")
