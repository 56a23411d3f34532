"""Documents by key: a store of hash buckets with versions.

A store is a folder::

    versions/00000000000000000007.json    what version 7 consists of, a folder per bucket
    data/<write>/__bucket__=12/*.parquet  the documents of one bucket, as one write left them

A document lies in the bucket of its key's hash, so the buckets are even whatever the data.
A write touches the buckets of its keys only: these are read, merged and written anew; of all
others the new version names the folders it had. Files are never changed, so readers keep the
version they began with.

A version becomes visible by one step that fails if another writer took its number (see
``commits``). Of two writers that began from one version, the later thus fails with `Conflict`
and nothing of it is seen; it may begin anew from what the first one left (``retries``).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rowloom.session import scratch_path
from rowloom.sinks.commits import Conflict, Files, numbered

BUCKET = "__bucket__"
#: buckets of a new store; choose them so that one bucket is a good file or a few
BUCKETS = 32


def latest(documents: DataFrame, key: str, order: str | None) -> DataFrame:
    """One document per key: that of the greatest ``order``, or any one. Documents without a
    key are not replaced by each other."""
    rest = [c for c in documents.columns if c != key]
    named = documents.filter(F.col(key).isNotNull())
    if order is None:
        last = named.dropDuplicates([key])
    else:
        last = named.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_doc"))
        last = last.select(key, *[F.col(f"_doc.{c}").alias(c) for c in rest])
    return last.select(*documents.columns).unionByName(documents.filter(F.col(key).isNull()))


def upsert_documents(base: DataFrame, new: DataFrame, key: str = "object_id", order: str | None = None) -> DataFrame:
    """Full replace of the document at a key; insert if absent.

    With ``order``, of several new documents on one key the latest wins; without it
    the keys of ``new`` must be unique.
    """
    if order is not None:
        new = latest(new, key, order)
    kept = base.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.select(*base.columns))


@dataclass(frozen=True)
class Snapshot:
    """One version: how its documents are dealt out, and which write left each bucket."""

    root: str
    version: int
    key: str
    buckets: int
    schema: StructType
    parts: dict[int, str] = field(default_factory=dict)

    def folders(self, of: Iterable[int] | None = None) -> list[str]:
        """Folders of the buckets ``of``, or of all."""
        chosen = sorted(self.parts if of is None else set(of) & set(self.parts))
        return [f"{self.root}/data/{self.parts[b]}/{BUCKET}={b}" for b in chosen]

    def read(self, spark: SparkSession, of: Iterable[int] | None = None) -> DataFrame:
        folders = self.folders(of)
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*folders)


def versions(spark: SparkSession, root: str) -> list[int]:
    return Files(spark, root).numbers(f"{root}/versions")


def current_version(spark: SparkSession, root: str) -> int:
    """The last version under ``root``; 0 if there is none."""
    return max(versions(spark, root), default=0)


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """The last version or a given one; nothing if there is none."""
    version = current_version(spark, root) if version is None else version
    if version == 0:
        return None
    said = json.loads(Files(spark, root).text(_version_file(root, version)))
    parts = {int(b): write for b, write in said["parts"].items()}
    return Snapshot(root, version, said["key"], said["buckets"], StructType.fromJson(said["schema"]), parts)


def read_documents(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    found = snapshot(spark, root, version)
    if found is None:
        raise FileNotFoundError(f"no documents under {root}")
    return found.read(spark)


def _version_file(root: str, version: int) -> str:
    return numbered(f"{root}/versions", version)


def _commit(spark: SparkSession, new: Snapshot) -> int:
    said = {"key": new.key, "buckets": new.buckets, "schema": new.schema.jsonValue(), "parts": new.parts}
    Files(spark, new.root).put_new(_version_file(new.root, new.version), json.dumps(said))
    return new.version


def _bucketed(documents: DataFrame, key: str, buckets: int) -> DataFrame:
    """Documents without a key are dealt by all they hold, as no other write can meet them."""
    whole = F.xxhash64(F.to_json(F.struct(*documents.columns)))
    at = F.when(F.col(key).isNull(), whole).otherwise(F.xxhash64(key))
    return documents.withColumn(BUCKET, F.pmod(at, F.lit(buckets)).cast("int"))


def _write(documents: DataFrame, key: str, buckets: int, folder: str) -> list[int]:
    """Write documents by bucket; the buckets that have any."""
    if BUCKET in documents.columns:
        raise ValueError(f"documents have a column {BUCKET}")
    dealt = _bucketed(documents, key, buckets).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET)
    dealt.write.partitionBy(BUCKET).parquet(folder)
    names = [name for name, _ in Files(documents.sparkSession, folder).names(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))


def save_documents(
    documents: DataFrame,
    root: str,
    key: str = "object_id",
    base: Snapshot | None = None,
    buckets: int | None = None,
) -> int:
    """Write ``documents`` as the whole content of a new version and return its number.

    ``base`` is the version that they were derived from; it fails with `Conflict` if there is
    a later one. Without it this is the version found now.
    """
    spark = documents.sparkSession
    base = base or snapshot(spark, root)
    buckets = buckets or (base.buckets if base else BUCKETS)
    write = uuid.uuid4().hex
    parts = dict.fromkeys(_write(documents, key, buckets, f"{root}/data/{write}"), write)
    schema = StructType.fromJson(documents.schema.jsonValue())
    return _commit(spark, Snapshot(root, base.version + 1 if base else 1, key, buckets, schema, parts))


def upsert_into(
    documents: DataFrame,
    root: str,
    key: str = "object_id",
    order: str | None = None,
    base: Snapshot | None = None,
    buckets: int = BUCKETS,
    retries: int = 0,
) -> int:
    """Upsert into the store under ``root``, made if it isn't there; the new version's number.

    The new documents are computed once. Only buckets that hold one of their keys are read and
    written. ``base`` is the version found now, unless given; if another version was committed
    since, this fails with `Conflict`, or begins anew from that one up to ``retries`` times.
    """
    spark = documents.sparkSession
    base = base or snapshot(spark, root)
    if base is None:
        try:
            return save_documents(latest(documents, key, order), root, key, buckets=buckets)
        except Conflict:
            if not retries:
                raise
            return upsert_into(documents, root, key, order, None, buckets, retries - 1)
    staged = scratch_path(spark, "upsert")
    new = latest(documents, key, order).select(*base.schema.names)
    changed = _write(new, key, base.buckets, staged)
    if not changed:
        return base.version
    new = spark.read.schema(new.schema).parquet(*[f"{staged}/{BUCKET}={b}" for b in changed])
    while True:
        write = uuid.uuid4().hex
        merged = upsert_documents(base.read(spark, changed), new, key)
        written = _write(merged, key, base.buckets, f"{root}/data/{write}")
        parts = {**base.parts, **dict.fromkeys(written, write)}
        try:
            return _commit(spark, Snapshot(root, base.version + 1, key, base.buckets, base.schema, parts))
        except Conflict:
            if not retries:
                raise
            retries, dealt, base = retries - 1, base.buckets, snapshot(spark, root)
            if base.buckets != dealt:
                return upsert_into(new, root, key, None, base, buckets, retries)


def rebucket(spark: SparkSession, root: str, buckets: int) -> int:
    """Deal all documents to another number of buckets, as a new version."""
    base = snapshot(spark, root)
    return save_documents(base.read(spark), root, base.key, base, buckets)


def vacuum(spark: SparkSession, root: str, keep_versions: int = 10, older_than_ms: int = 7 * 86_400_000) -> list[str]:
    """Remove versions before the last ``keep_versions``, and writes that no version left names.

    Writes younger than ``older_than_ms`` stay, as their version may be yet to come. Returns
    the writes removed.
    """
    files, known = Files(spark, root), versions(spark, root)
    for version in known[:-keep_versions]:
        files.delete(_version_file(root, version))
    used = {w for v in known[-keep_versions:] for w in snapshot(spark, root, v).parts.values()}
    now = time.time() * 1000
    gone = [name for name, at in files.names(f"{root}/data") if name not in used and at < now - older_than_ms]
    for name in gone:
        files.delete(f"{root}/data/{name}")
    return sorted(gone)


def merge_documents(new: DataFrame, table: str, key: str = "object_id") -> None:
    """Upsert into a catalog table whose format supports MERGE; only the files that
    hold changed keys are rewritten. Plain parquet tables do not support it."""
    (
        new.alias("new")
        .mergeInto(table, F.col(f"{table}.{key}") == F.col(f"new.{key}"))
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )
