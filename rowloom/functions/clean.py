"""Clean-up of nested JSON documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F, types as T


def _sweep(found: dict):
    """Called by the JSON reader for every object, innermost first."""
    if found.get("type") == "Buffer" and "data" in found:
        return None
    if found.get("byval", 0) is None:
        del found["byval"]
    return found


@F.pandas_udf(T.StringType())
def strip_buffers(documents: pd.Series) -> pd.Series:
    """Replace encoded buffers by null and drop ``byval`` keys left null.

    Documents nest to any depth, which no built-in function can walk, so this runs
    on Arrow batches in Python. Text that is not JSON gives null.
    """

    def clean(text):
        try:
            swept = json.loads(text, object_hook=_sweep)
        except (TypeError, ValueError):
            return None
        return json.dumps(swept, separators=(",", ":"), ensure_ascii=False)

    return documents.map(clean)
