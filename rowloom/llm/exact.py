"""Exact dedup: a minimal perfect hash over the distinct digests of the historical texts.

The digests are dealt to buckets of a few thousand by their own bytes, so that buckets are
even whatever the data; there are enough of them for the history and for the new texts. Each bucket gets a minimal perfect hash (hash and
displace): a slot per digest, holding the full digest and the locator of the row that won.
New texts are grouped first, so each distinct digest is looked up once; a lookup compares
all 32 bytes, because a perfect hash sends strangers to some slot too. Members are repeats
of the winner in the history; the others are grouped among themselves.

Texts are equal when they are after each run of white space became one space. Of equal
texts the row with the smallest id stays; a history row wins over a new one.

Cases: null texts count as empty and are equal to one another. Rows without an id come
last; of rows with the same id and text, one stays. An empty history makes every digest a
nonmember, an empty table an empty result. Other columns don't matter.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowloom.llm.common import SPACE, prepare, unused, whole
from rowloom.session import materialise

#: digests in a bucket of the index, and in a displacement group of a bucket
PER_BUCKET, PER_GROUP = 4_096, 4
#: buckets that a task builds; their rows are few bytes, so size says nothing of the work
PER_TASK = 8
#: displacements tried at once, at first
TRIED = 32

INDEX = "bucket long, displacements binary, digests binary, locators binary"


def digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(whole(text), SPACE, " "), 256))


def _slots(words: np.ndarray, displacement: np.ndarray | int, n: int) -> np.ndarray:
    """Slot of each digest under a displacement; ``words``: (rows, 4) unsigned 64 bits."""
    with np.errstate(over="ignore"):
        x = words[..., 1] + np.asarray(displacement, np.uint64) * (words[..., 2] | np.uint64(1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint64).reshape(-1, 4)


def build_hash(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each group, and the slot of each of the distinct digests.

    A group of one takes any slot that is left; its displacement is that slot, negative.
    """
    words, n = _words(b"".join(digests)), len(digests)
    groups = (words[:, 0] % np.uint64(max(1, ceil(n / PER_GROUP)))).astype(np.int64)
    found, slots = np.zeros(max(1, ceil(n / PER_GROUP)), np.int64), np.full(n, -1, np.int64)
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.diff(groups[order], prepend=-1))
    members = sorted(np.split(order, starts[1:]), key=len, reverse=True)
    taken = np.zeros(n, bool)
    for rows in members:
        if len(rows) == 1:
            break
        begin, tried = 0, TRIED
        while True:  # many displacements at once
            tries = np.arange(begin, begin + tried)
            at = _slots(words[rows], tries[:, None], n)
            ordered = np.sort(at, axis=1)
            fit = ~taken[at].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fit.any():
                break
            begin, tried = begin + tried, min(2 * tried, 1 << 14)
        k = int(fit.argmax())
        taken[at[k]], slots[rows], found[groups[rows[0]]] = True, at[k], tries[k]
    free = iter(np.flatnonzero(~taken))
    for rows in members:
        if len(rows) == 1:
            slots[rows[0]] = next(free)
            found[groups[rows[0]]] = -1 - slots[rows[0]]
    return found, slots


def look_up(words: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    d = displacements[(words[:, 0] % np.uint64(len(displacements))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _slots(words, np.maximum(d, 0), n))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    displacements, slots = build_hash(list(rows["digest"]))
    order = np.argsort(slots)
    return pd.DataFrame(
        {
            "bucket": [rows["bucket"].iloc[0]],
            "displacements": [displacements.tobytes()],
            "digests": [b"".join(rows["digest"].iloc[order])],
            "locators": [rows["locator"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def _probe(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = new[["digest", "win", "size"]].assign(locator=pd.array([pd.NA] * len(new), dtype="Int64"))
    if len(new) and len(index):
        words, slots = _words(b"".join(new["digest"])), _words(index["digests"].iloc[0])
        at = look_up(words, np.frombuffer(index["displacements"].iloc[0], np.int64), len(slots))
        member = (slots[at] == words).all(axis=1)
        won = np.frombuffer(index["locators"].iloc[0], np.int64)[at]
        out["locator"] = pd.array(won, dtype="Int64")
        out.loc[~member, "locator"] = pd.NA
    return out[["digest", "win", "size", "locator"]]


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Index table of ``history`` (digest, win, size): one row per bucket, stored."""
    rows = history.select(_bucket(buckets), "digest", F.col("win.row").alias("locator"))
    rows = rows.repartition(max(1, ceil(buckets / PER_TASK)), "bucket")
    return materialise(rows.groupBy("bucket").applyInPandas(_build, INDEX), "digest-index")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


def group(rows: DataFrame) -> DataFrame:
    """Distinct digests of ``rows`` (digest, id, row) with their winner and number."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    return rows.groupBy("digest").agg(first.alias("win"), F.count(F.lit(1)).alias("size"))


def deduplicate(docs: DataFrame, historical: Column | None = None, id_column="doc_id", text="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, repeat.

    ``historical`` says which rows the index is built from; without it these are the rows
    with ids in the lower half of the range. ``repeat``: found in the history's index.
    """
    spark = prepare(docs.sparkSession)
    if historical is None:
        ends = docs.agg(F.min(id_column), F.max(id_column)).first()
        historical = F.col(id_column) <= F.lit(None if ends[0] is None else ends[0] + (ends[1] - ends[0]) // 2)
    rows = docs.select(
        F.col(id_column).alias("id"),
        digest(text).alias("digest"),
        F.coalesce(historical, F.lit(False)).alias("old"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "digests")
    # both sides share the buckets, so these are as many as the larger side needs
    buckets = max(1, ceil(rows.count() / PER_BUCKET))
    old, new = group(rows.where("old")), group(rows.where("NOT old"))
    index = build_index(old, buckets)
    win = old.schema["win"].dataType.simpleString()
    looked = (
        new.select(_bucket(buckets), "digest", F.to_json("win").alias("win"), "size")
        .groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(_probe, "digest binary, win string, size long, locator long")
        .select("digest", F.from_json("win", win).alias("win"), "size", F.col("locator").isNotNull().alias("repeat"))
    )
    groups = (
        old.withColumn("repeat", F.lit(False))
        .unionByName(looked.withColumn("win", F.when(~F.col("repeat"), F.col("win"))))
        .groupBy("digest")
        .agg(F.min("win").alias("win"), F.sum("size").alias("group_size"), F.max("repeat").alias("repeat"))
    )
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return rows.join(groups, "digest").select(
        F.col("id").alias(id_column),
        F.col("win.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("win.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        (F.col("repeat") & ~F.col("old")).alias("repeat"),
    )


def first_copies(docs: DataFrame, text="text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    name = lambda x: unused(docs, x)
    own, key, at, before = name("digest"), name("key"), name("id"), name("before")
    kept = deduplicate(docs, text=text).where("kept")
    kept = kept.select(F.col("doc_id").alias(at), F.unhex("text_sha256").alias("_kept"))
    kept = kept.withColumn(key, F.xxhash64(at, "_kept")).withColumnRenamed("_kept", name("kept_digest"))
    rows = docs.withColumn(own, digest(text)).withColumn(key, F.xxhash64("doc_id", own))
    same = (F.col("doc_id").eqNullSafe(F.col(at))) & (F.col(own) == F.col(name("kept_digest")))
    rows = rows.join(kept, key).where(same)
    # of rows with the same id and text one stays; the key is the join's, so nothing moves again
    along = Window.partitionBy(key).orderBy("doc_id", own, F.xxhash64(*docs.columns))
    again = F.lag(F.struct("doc_id", own)).over(along).eqNullSafe(F.struct("doc_id", own))
    return rows.withColumn(before, again).where(~F.col(before)).select(*docs.columns)
