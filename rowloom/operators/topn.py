"""First n rows of each group when one group may hold most of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SPREAD = 64


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, position: str = "seq"
) -> DataFrame:
    """Keep the first ``n`` rows of each group and number them from 1.

    Two rounds: the first ranks within (group, slice of the input splits), so a hot
    group is spread over many tasks; the second sees at most ``SPREAD * n`` rows of
    a group. Both rounds drop rows before their shuffle (partial window limit).
    The slice is the input split a row came from, so the partial limit of one task
    still works on whole groups. ``df`` should thus not have been shuffled by the
    keys before.
    """
    sliced = df.withColumn("_slice", F.spark_partition_id() % SPREAD)
    near = Window.partitionBy(*keys, "_slice").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        sliced.withColumn("_near", F.row_number().over(near))
        .filter(F.col("_near") <= n)
        .drop("_near", "_slice")
        .withColumn(position, F.row_number().over(whole))
        .filter(F.col(position) <= n)
    )
