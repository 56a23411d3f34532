"""Reading collections: all documents that share an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowloom.functions.ids import collection_item_id


def scan_collection(items: DataFrame, owner: str) -> DataFrame:
    """Documents of one owner. The filter reaches the scan, and prunes folders when
    the table is partitioned by owner."""
    return items.filter(F.col("owner") == owner)


def exclude_jobs(items: DataFrame) -> DataFrame:
    """Drop job records that share the owner; a row without ``pk`` is kept."""
    return items.filter(~F.contains(F.coalesce(F.col("pk"), F.lit("")), F.lit("/job.")))


def multi_get(documents: DataFrame, keys: DataFrame, key: str = "object_id") -> tuple[DataFrame, DataFrame]:
    """(documents found, keys that do not exist). ``keys`` may repeat a key; copies
    are folded before the join, so a key asked for very often is no hot key."""
    wanted = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    found = documents.join(wanted, key, "left_semi")
    missing = wanted.join(documents.select(key), key, "left_anti")
    return found, missing


def union_pages(*pages: DataFrame) -> DataFrame:
    """Concatenate result pages, one row per item.

    A page may repeat rows of an earlier one. Rows with no key at all cannot be
    told apart, so they are all kept. Copies are dropped map-side first, so a key
    repeated many times costs one row per task in the shuffle.
    """
    every = pages[0]
    for page in pages[1:]:
        every = every.unionByName(page, allowMissingColumns=True)
    keyed = every.withColumn("_key", F.coalesce(F.col("pk"), F.col("object_id")))
    unique = keyed.filter(F.col("_key").isNotNull()).dropDuplicates(["_key"])
    return unique.unionByName(keyed.filter(F.col("_key").isNull())).drop("_key")


def with_item_id(items: DataFrame) -> DataFrame:
    return items.withColumn("item_id", collection_item_id(F.col("pk"), F.col("object_id")))
