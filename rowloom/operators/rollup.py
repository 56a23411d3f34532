"""Roll-ups of receipts.

All are plain aggregates: each task first folds its own rows to one per key, so a
job with a third of all receipts sends one small row per task through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.schemas import EMPTY_MESSAGES


def job_counts(receipts: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Succeeded and failed items per job."""
    return receipts.groupBy(*keys).agg(
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.count(F.lit(1)).alias("n"),
    )


def action_counts(action_receipts: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Succeeded and failed action calls per job; one item may make several calls."""
    return action_receipts.groupBy(*keys).agg(
        F.count_if(F.col("success")).alias("action_success_count"),
        F.count_if(~F.col("success")).alias("action_error_count"),
    )


def noun(job_type: Column) -> Column:
    return F.when(job_type == "run_on_files", F.lit("files")).otherwise(F.lit("items"))


def final_status(counts: DataFrame, what: Column | None = None) -> DataFrame:
    """Status, message and percent of jobs that had items."""
    what = F.lit("items") if what is None else what
    good, bad = F.col("success_count"), F.col("error_count")
    text = F.when(
        (bad > 0) & (good == 0), F.concat(F.lit("All "), bad.cast("string"), F.lit(" "), what, F.lit(" failed"))
    ).when(
        bad > 0,
        F.concat(bad.cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" "), what, F.lit(" failed")),
    )
    return counts.withColumns(
        {
            "status": F.when((bad > 0) & (good == 0), F.lit("FAILED")).otherwise(F.lit("SUCCEEDED")),
            "error_message": text,
            "percent": F.lit(100),
        }
    )


def finish_jobs(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """Final row of every job, including jobs without items.

    ``counts`` has one row per job at most, so this joins two small tables. A job
    without items succeeds with a message and leaves counters and percent unset.
    """
    finals = final_status(
        jobs.select("object_id", "job_type").join(
            counts.withColumnRenamed("job_id", "object_id"), "object_id", "left"
        ),
        noun(F.col("job_type")),
    )
    empty = F.col("n").isNull()
    message = F.lit(None).cast("string")
    for kind, text in EMPTY_MESSAGES.items():
        message = F.when(F.col("job_type") == kind, F.lit(text)).otherwise(message)
    return finals.select(
        "object_id",
        "job_type",
        F.when(empty, F.lit("SUCCEEDED")).otherwise(F.col("status")).alias("status"),
        F.when(empty, message).otherwise(F.col("error_message")).alias("error_message"),
        F.when(~empty, F.col("percent")).alias("percent"),
        "success_count",
        "error_count",
    )


def empty_jobs(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """Final rows of the jobs that had no items."""
    return finish_jobs(jobs, counts).filter(F.col("percent").isNull())


def trigger_stats(receipts: DataFrame, keys: Sequence[str], tie: str = "seq") -> DataFrame:
    """Run and error counts, last run, last error and last receipt per trigger."""
    at = F.struct("timestamp", tie)
    failed = ~F.col("success")
    return receipts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(failed).alias("error_count"),
        F.max("timestamp").alias("last_run_at"),
        F.max(F.when(failed, F.col("timestamp"))).alias("last_err_at"),
        F.max_by("error_message", F.when(failed, at)).alias("last_err_message"),
        F.max_by("object_id", at).alias("last_object_id"),
        F.max_by("success", at).alias("last_success"),
    )


def latest_receipt(receipts: DataFrame, keys: Sequence[str], tie: str = "seq") -> DataFrame:
    """Newest receipt per key, as whole rows."""
    rest = [c for c in receipts.columns if c not in keys]
    newest = receipts.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("timestamp", tie)).alias("_last")
    )
    return newest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def cost_rollup(receipts: DataFrame, keys: Sequence[str] = ("job_id", "user_id")) -> DataFrame:
    """Sum of receipt cost. Summed as decimal, so the result does not depend on the
    order in which tasks finish."""
    return receipts.groupBy(*keys).agg(
        F.sum(F.col("cost").cast("decimal(18,6)")).cast("double").alias("total_cost"),
        F.count("cost").alias("costed"),
    )
