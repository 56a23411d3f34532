"""Files: key lists of jobs, and selection of files that start a trigger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowloom.functions.ids import file_name
from rowloom.functions.validate import match_glob


def explode_files(jobs: DataFrame, keep: Sequence[str] = ("object_id",)) -> DataFrame:
    """One row per file of each job: ``seq`` from 1 in list order, ``n`` in total."""
    return jobs.select(
        *keep, F.size("file_keys").alias("n"), F.posexplode("file_keys").alias("_pos", "key")
    ).select(
        *keep, (F.col("_pos") + 1).cast("bigint").alias("seq"), F.col("n").cast("bigint").alias("n"), "key"
    )


def file_selected(key: Column, prefix: str, patterns: Sequence[str] = (), recursive: bool = False) -> Column:
    """Under the prefix, direct child unless recursive, name or key matching any pattern.

    A pattern is tested on the part after the prefix and on the file name. No
    pattern selects every file.
    """
    rest = F.substring(key, F.lit(len(prefix) + 1), F.length(key))
    chosen = key.startswith(prefix)
    if not recursive:
        chosen = chosen & ~rest.contains("/")
    if patterns:
        chosen = chosen & (match_glob(rest, *patterns) | match_glob(file_name(key), *patterns))
    return chosen


def file_events(
    files: DataFrame, prefix: str, patterns: Sequence[str] = (), recursive: bool = False, key: str = "key"
) -> DataFrame:
    return files.filter(file_selected(F.col(key), prefix, patterns, recursive))
