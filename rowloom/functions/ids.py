"""Identifiers: job ids, path ids, item ids and receipt streams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def job_uuid(job_id: Column) -> Column:
    """Text after the last ``/job.``; else after the last ``job.``; else all of it."""
    return (
        F.when(job_id.contains("/job."), F.substring_index(job_id, "/job.", -1))
        .when(job_id.contains("job."), F.substring_index(job_id, "job.", -1))
        .otherwise(job_id)
    )


def split_path(path_id: Column) -> Column:
    """``struct(hostname, username, valid)``; an id of fewer than two parts is invalid."""
    parts = F.split(path_id, "/")
    valid = F.coalesce(F.size(parts) >= 2, F.lit(False))
    return F.struct(
        F.when(valid, F.get(parts, F.lit(0))).alias("hostname"),
        F.when(valid, F.get(parts, F.lit(1))).alias("username"),
        valid.alias("valid"),
    )


def file_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def receipt_stream_id(hostname: Column, username: Column, job_id: Column) -> Column:
    """Stream that holds a job's receipts. A null host stays visible as ``None``."""
    return F.concat(
        F.coalesce(hostname, F.lit("None")), F.lit("/"), F.coalesce(username, F.lit("")),
        F.lit("/stream-run-all."), job_uuid(job_id),
    )


def collection_item_id(pk: Column, object_id: Column) -> Column:
    """Typed columns, where null means the key is absent."""
    return F.coalesce(pk, object_id, F.lit("unknown"))


def document_item_id(fields: Column) -> Column:
    """Open documents, where a present key wins even when its value is null."""
    return (
        F.when(F.map_contains_key(fields, "pk"), F.try_element_at(fields, F.lit("pk")))
        .when(F.map_contains_key(fields, "object_id"), F.try_element_at(fields, F.lit("object_id")))
        .otherwise(F.lit("unknown"))
    )


def stream_item_id(stream_id: Column, timestamp: Column) -> Column:
    return F.concat(stream_id, F.lit("@"), F.coalesce(timestamp.cast("string"), F.lit("unknown")))
