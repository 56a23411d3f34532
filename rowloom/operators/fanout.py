"""Fan-out: one row per (job, item) with position and total.

Nothing here numbers a large collection or stream in one task. A position is the rank within
a block plus the sizes of the blocks before it, where a block is a part of the order itself, so
that it never changes a position.

The items of a collection are ordered by a hash of their id, and the first digits of the hash
make even blocks; items without an id share one hash, so they are dealt on by a hash of what
they hold. The items of a stream are ordered by time, which may be anything: all at once, or
none. Their blocks are the ranges of the whole order that Spark's range partitioning draws
from a sample of it, so they are of one size whatever the times are; the ranges are stored,
as another draw would cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowloom.functions.ids import file_name
from rowloom.operators.topn import first_per_group
from rowloom.session import materialise
from rowloom.sources.collections import with_item_id
from rowloom.sources.files import explode_files

#: hex digits that tell the blocks of a collection apart
BLOCK_DIGITS = 3
#: the id of items that have none
NAMELESS = "unknown"


def _numbered(rows: DataFrame, counted: DataFrame, key: str, rank: Column) -> DataFrame:
    """``rows`` with ``seq`` 1..n and ``n`` per ``key``: by ``_block``, and by ``rank`` inside,
    which may use ``_first`` of ``counted``. That has a row per key and block with its ``_size``."""
    whole = Window.partitionBy(key)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.select(
        F.col(key).alias("_key"),
        F.col("_block").alias("_of"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("n"),
        *[c for c in ("_first",) if c in counted.columns],
    )
    same = (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_of"))
    return (
        rows.join(sizes, same)
        .withColumn("seq", (F.col("_before") + rank).cast("bigint"))
        .drop("_key", "_of", "_before", "_first", "_block")
    )


def hash_blocks(items: DataFrame, digits: int, holding: Sequence[str]) -> DataFrame:
    """``_hash`` of each item's id, ``_more`` for items without one, and ``_block``: the first
    digits of the hash, and among items without an id those of a hash of the columns
    ``holding``. Blocks are in the order of (_hash, item_id, _more)."""
    nameless = F.col("item_id") == NAMELESS
    more = F.when(nameless, F.md5(F.to_json(F.struct(*holding)))).otherwise(F.lit(""))
    here, theirs = F.substring("_hash", 1, digits), F.md5(F.lit(NAMELESS))
    side = (
        F.when(here != F.substring(theirs, 1, digits), "")
        .when(nameless, F.concat(F.lit("1"), F.substring("_more", 1, digits)))
        .otherwise(F.when(F.col("_hash") < theirs, "0").otherwise("2"))
    )
    hashed = items.withColumn("_hash", F.md5("item_id")).withColumn("_more", more)
    return hashed.withColumn("_block", F.concat(here, side))


def range_blocks(rows: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` sorted by key and order and stored, with ``_block``, the range a row lies in, and
    ``_at``, which ascends along the order. Rows of equal order are told apart by what they hold."""
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    along = [F.col(key), *order, F.xxhash64(*plain)]
    ranged = rows.repartitionByRange(*along).sortWithinPartitions(*along)
    stored = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    return stored.withColumn("_block", F.shiftright("_at", 33))


def fan_out_collection(
    jobs: DataFrame, items: DataFrame, digits: int = BLOCK_DIGITS, counted: DataFrame | None = None
) -> DataFrame:
    """Every job with every item of its collection, ``seq`` 1..n and total ``n``.

    The store gives a collection in no fixed order. Ours is the hash of the item id, then the
    item id (for items without one, what they hold) and ``object_id``. ``counted`` may give the same items without what was joined
    to them, to be counted more cheaply. Jobs are few beside items; where their side is too
    large to be broadcast, adaptive skew handling splits a hot collection.
    """
    holding = items.columns if counted is None else [c for c in items.columns if c in counted.columns]
    blocked = lambda df: hash_blocks(with_item_id(df), digits, holding)
    narrow = blocked(items if counted is None else counted).groupBy("owner", "_block")
    sizes = narrow.agg(F.count(F.lit(1)).alias("_size"))
    inside = Window.partitionBy("owner", "_block").orderBy("_hash", "item_id", "_more", "object_id")
    ranked = blocked(items).withColumn("_rank", F.row_number().over(inside))
    ranked = _numbered(ranked, sizes, "owner", F.col("_rank")).drop("_hash", "_more", "_rank")
    ranked = ranked.withColumnsRenamed({c: f"item_{c}" for c in items.columns})
    return ranked.join(jobs, F.col("item_owner") == F.col("collection_owner"))


def fan_out_stream(
    jobs: DataFrame,
    events: DataFrame,
    limit: int | None = None,
    after_timestamp: int | None = None,
    tie: str = "object_id",
) -> DataFrame:
    """Every job with the items of its stream in time order; items without a time first.

    Without ``limit`` these are all items, sorted and stored here. With it, each stream enters the join with its
    first ``limit`` rows however long it is. ``n`` is the number of items read.
    """
    wanted = events if after_timestamp is None else events.filter(F.col("timestamp") > after_timestamp)
    if limit is None:
        rows = range_blocks(wanted, "stream_id", [F.col("timestamp"), F.col(tie)], "stream-items")
        sizes = rows.groupBy("stream_id", "_block").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
        first = _numbered(rows, sizes, "stream_id", F.col("_at") - F.col("_first") + 1).drop("_at")
    else:
        first = first_per_group(wanted, ["stream_id"], [F.col("timestamp"), F.col(tie)], limit)
        total = F.count(F.lit(1)).over(Window.partitionBy("stream_id"))
        first = first.withColumn("seq", F.col("seq").cast("bigint")).withColumn("n", total)
    first = first.withColumnsRenamed({c: f"item_{c}" for c in events.columns})
    return first.join(jobs, F.col("item_stream_id") == jobs["stream_id"], "inner")


def fan_out_files(jobs: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Every job with its file keys in list order and the file name."""
    kept = list(keep) if keep else [c for c in jobs.columns if c != "file_keys"]
    return explode_files(jobs, kept).withColumn("filename", file_name(F.col("key")))
