"""Routing of result rows to where they are kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from rowloom.sinks.documents import upsert_into
from rowloom.sinks.files import write_files
from rowloom.sinks.receipts import append_receipts


def route(df: DataFrame, destination: Mapping[str, str]) -> DataFrame | None:
    """Rows as one destination stores them; nothing when it is inactive."""
    kind = destination.get("kind", "INACTIVE")
    if kind == "STREAM":
        return df.withColumn("stream_id", F.lit(destination["stream_id"]))
    if kind == "COLLECTION":
        return df.withColumn("owner", F.lit(destination["owner"]))
    if kind == "FILE":
        return df
    return None


def write_destination(df: DataFrame, destination: Mapping[str, str]) -> str | None:
    """Write rows to a STREAM, a COLLECTION or FILEs; an inactive one writes nothing.

    A COLLECTION keeps the documents it has; those of the same ``object_id`` are replaced.
    Returns the folder written to; that of a COLLECTION is read with ``read_documents``, that of a STREAM with
    ``read_receipts``.
    """
    rows = route(df, destination)
    if rows is None:
        return None
    kind, path = destination["kind"], destination["path"]
    if kind == "STREAM":
        if not append_receipts(rows, path):
            return None
        return path
    if kind == "COLLECTION":
        upsert_into(rows, path)
        return path
    return write_files(rows, path, destination.get("extension", "parquet"))
