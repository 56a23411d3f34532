"""Job records: type, validation, cancellation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.inputs import truthy_fallback
from rowloom.functions.validate import is_blank
from rowloom.schemas import CANCELLED_MESSAGE, JOB_TYPES, SINGLETON


def resolve_jobs(
    jobs: DataFrame,
    forced_type: str | None = None,
    collection_owner: str | None = None,
    stream_id: str | None = None,
) -> DataFrame:
    """Add ``declared_type`` and ``job_type`` and fill empty sources by fallbacks.

    The forced type wins over the stored one, which wins over singleton. A type
    nobody knows runs as singleton.
    """
    declared = F.lit(forced_type) if forced_type else F.coalesce(F.col("job_type"), F.lit(SINGLETON))
    kind = F.when(declared.isin(*JOB_TYPES), declared).otherwise(F.lit(SINGLETON))
    resolved = jobs.withColumns({"declared_type": declared, "_kind": kind})
    for name, fallback in (("collection_owner", collection_owner), ("stream_id", stream_id)):
        if name in jobs.columns:
            resolved = resolved.withColumn(
                name, truthy_fallback(F.col(name), F.lit(fallback).cast("string"))
            )
    return resolved.withColumn("job_type", F.col("_kind")).drop("_kind")


def rejection(columns: list[str]) -> Column:
    """Why a job cannot run, or null. Needs resolved job types."""
    def missing(name: str) -> Column:
        if name not in columns:
            return F.lit(True)
        return F.coalesce(F.size(name) <= 0, F.lit(True)) if name == "file_keys" else is_blank(F.col(name))

    reason = F.lit(None).cast("string")
    for kind, name in zip(JOB_TYPES, ("collection_owner", "stream_id", "file_keys")):
        reason = F.when(
            (F.col("job_type") == kind) & missing(name), F.lit(f"{name} is required for {kind}")
        ).otherwise(reason)
    return reason


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """Add ``reject_reason``. Rejected jobs keep their stored status."""
    return jobs.withColumn("reject_reason", rejection(jobs.columns))


def split_cancelled(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs to go on with, cancelled jobs as final rows).

    A cancelled job ends FAILED and keeps the counts it has so far.
    """
    if "request_cancel" not in jobs.columns:
        jobs = jobs.withColumn("request_cancel", F.lit(False))
    asked = F.coalesce(F.col("request_cancel"), F.lit(False))
    cancelled = jobs.filter(asked).withColumns(
        {"status": F.lit("FAILED"), "error_message": F.lit(CANCELLED_MESSAGE)}
    )
    return jobs.filter(~asked), cancelled


def normalise_status(status: Column) -> Column:
    """An undeclared status reads as INITIALIZING."""
    from rowloom.schemas import STATUSES

    return F.when(status.isin(*STATUSES), status).otherwise(F.lit("INITIALIZING"))
