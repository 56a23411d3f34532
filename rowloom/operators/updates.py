"""Write-back of outputs to the rows they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowloom.functions.inputs import overlay
from rowloom.schemas import FIELDS

NO_ID = "unknown"  # fixed value: the id of an item that has none


def derive_mappings(scripts: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, source, target) from each script's first UPDATE_VALUES node.

    A link into that node maps an output to a field; empty names drop; a repeated
    source keeps its last link. Node and link lists are walked inside the row: a
    script is one record, so nothing is shuffled.
    """
    update_nodes = F.filter("nodes", lambda n: n.getField("ntype") == "UPDATE_VALUES")
    update_id = F.get(F.transform(update_nodes, lambda n: n.getField("unique_id")), F.lit(0))
    links = F.filter(
        "links",
        lambda link: (link.getField("target") == F.col("_update"))
        & (F.coalesce(link.getField("sourceHandle"), F.lit("")) != "")
        & (F.coalesce(link.getField("targetHandle"), F.lit("")) != ""),
    )
    later = F.filter(
        F.transform(
            "_links",
            lambda link, i: F.struct(
                link.getField("sourceHandle").alias("source"),
                link.getField("targetHandle").alias("target"),
                F.exists(
                    F.slice("_links", i + 2, F.size("_links")),
                    lambda other: other.getField("sourceHandle") == link.getField("sourceHandle"),
                ).alias("replaced"),
            ),
        ),
        lambda m: ~m.getField("replaced"),
    )
    return (
        scripts.select(key, "links", update_id.alias("_update"))
        .filter(F.col("_update").isNotNull())
        .select(key, links.alias("_links"))
        .select(key, F.explode(later).alias("_m"))
        .select(key, F.col("_m.source").alias("source"), F.col("_m.target").alias("target"))
    )


def planned_updates(
    results: DataFrame, key: str = "item_id", order: str = "completed_at",
    outputs: str = "outputs", mappings: str = "mappings",
) -> DataFrame:
    """(key, ``_updates`` map) to apply to each item.

    ``results`` holds succeeded items with their outputs and the mappings of their
    script. A field is set when the output key is present, even to null. Several
    results on one item apply in ``order``, field by field.
    """
    present = F.filter(
        F.transform(
            mappings,
            lambda m, i: F.struct(
                m.getField("target").alias("target"),
                F.try_element_at(F.col(outputs), m.getField("source")).alias("value"),
                F.struct(F.col(order).alias("at"), i.alias("pos")).alias("ord"),
                F.map_contains_key(F.col(outputs), m.getField("source")).alias("present"),
            ),
        ),
        lambda u: u.getField("present"),
    )
    changes = results.select(key, F.explode(present).alias("_u")).select(
        key, F.col("_u.target").alias("target"), F.col("_u.value").alias("value"), F.col("_u.ord").alias("ord")
    )
    last = changes.groupBy(key, "target").agg(F.max_by("value", "ord").alias("value"))
    # one entry per distinct target field, so a group is as small as a script
    return last.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("target", "value"))).cast(FIELDS).alias("_updates")
    )


def update_back(
    items: DataFrame, results: DataFrame, key: str = "item_id", order: str = "completed_at",
    fields: str = "fields",
) -> DataFrame:
    """Items with outputs of succeeded runs set on their fields.

    Adds ``updated``. A result whose item is gone changes nothing, nor does one of an item
    without an id: such items share a stand-in for one, and are not written to. The join key
    is the item id, unique in ``items``, so neither side has a hot key.
    """
    updates = planned_updates(results.filter(F.col(key) != NO_ID), key, order)
    return (
        items.join(updates, key, "left")
        .withColumn("updated", F.col("_updates").isNotNull())
        .withColumn(
            fields, F.when(F.col("updated"), overlay(F.col(fields), F.col("_updates"))).otherwise(F.col(fields))
        )
        .drop("_updates")
    )


def missing_items(items: DataFrame, results: DataFrame, key: str = "item_id") -> DataFrame:
    """Keys of results whose item does not exist: a warning, not a failure."""
    known = items.select(key).filter(F.col(key) != NO_ID)
    return results.select(key).distinct().join(known, key, "left_anti")
