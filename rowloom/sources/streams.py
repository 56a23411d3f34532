"""Reading streams: items keyed by (stream_id, timestamp in ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def read_stream(
    events: DataFrame,
    stream_id: str,
    after_timestamp: int | None = None,
    limit: int | None = None,
    tie: str = "object_id",
) -> DataFrame:
    """Read of one stream, oldest first: items after a time, if one is given, and at most
    ``limit``, if one is given. A limit keeps that many rows in each task before any is moved."""
    wanted = events.filter(F.col("stream_id") == stream_id)
    if after_timestamp is not None:
        wanted = wanted.filter(F.col("timestamp") > after_timestamp)
    ordered = wanted.orderBy("timestamp", tie)
    return ordered if limit is None else ordered.limit(limit)


def stream_events(
    events: DataFrame, stream_id: str | None = None, etype: str | None = None, session_id: str | None = None
) -> DataFrame:
    """Events of a stream by type and session; a missing argument selects all.

    Only filters, so it serves a table and a ``readStream`` source alike.
    """
    wanted: Column = F.lit(True)
    for name, value in (("stream_id", stream_id), ("etype", etype), ("session_id", session_id)):
        if value is not None:
            wanted = wanted & (F.col(name) == value)
    return events.filter(wanted)
