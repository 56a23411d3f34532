"""Receipts and stream items.

A receipts table is a folder of writes and a log of commits::

    data/_write=<write>/bucket=17/*.parquet    receipts of the streams of one bucket, as one write left them
    log/00000000000000000004.json              the fourth commit: which run, which write

A write is seen once its commit is there, in one step. A run that commits again replaces its own
receipts, as readers take the last commit of each run; a write without a commit is never seen.
"""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from rowloom.session import materialise
from rowloom.sinks.commits import Conflict, Files, numbered

log = logging.getLogger(__name__)

BUCKETS = 256
#: the bucket of rows that are no stream's receipts; no reader of the table asks for it
ASIDE = -1


def stream_bucket(stream_id: Column) -> Column:
    """Folder of a stream. A fixed number of folders, where one folder per stream
    would mean millions of small files."""
    return F.pmod(F.xxhash64(stream_id), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Staged:
    """Receipts that are written but not yet seen."""

    path: str
    write: str
    schema: StructType

    @property
    def folder(self) -> str:
        return f"{self.path}/data/_write={self.write}"

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows of this write, also those put aside."""
        return _read(spark, self.path, [self]).drop("bucket")


def _read(spark: SparkSession, path: str, writes: list[Staged]) -> DataFrame:
    """Rows of some writes; columns that only some have are null for the others."""
    fields = {f.name: f for w in writes for f in w.schema.fields}
    folders = [StructField("_write", StringType()), StructField("bucket", IntegerType())]
    reader = spark.read.schema(StructType([*fields.values(), *folders])).option("basePath", f"{path}/data")
    return reader.parquet(*[w.folder for w in writes]).drop("_write")


def stage_receipts(receipts: DataFrame, path: str, aside: Column | None = None) -> Staged:
    """Write receipts under ``path`` without showing them; rows that are ``aside`` never are.

    The rebalance hint lets Spark merge small write tasks and split those of a hot bucket.
    """
    bucket = stream_bucket(F.col("stream_id"))
    if aside is not None:
        bucket = F.when(aside, F.lit(ASIDE)).otherwise(bucket)
    staged = Staged(path.rstrip("/"), uuid.uuid4().hex, StructType.fromJson(receipts.schema.jsonValue()))
    (
        receipts.withColumn("bucket", bucket)
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "stream_id", "timestamp")
        .write.partitionBy("bucket")
        .parquet(staged.folder)
    )
    return staged


def commit_receipts(spark: SparkSession, staged: Staged, run_id: str | None = None) -> int:
    """Show staged receipts as those of a run, in place of what it committed before; the number
    of the commit. Commits of other writers at the same time only change that number."""
    files, folder = Files(spark, staged.path), f"{staged.path}/log"
    said = json.dumps({"run": run_id or staged.write, "write": staged.write, "schema": staged.schema.jsonValue()})
    while True:
        number = max(files.numbers(folder), default=0) + 1
        try:
            files.put_new(numbered(folder, number), said)
            return number
        except Conflict:
            continue


def append_receipts(receipts: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Append the receipts of a run; false (and a log line) if they could not be kept.

    Appending the same run again replaces what it appended before. Without ``run_id`` each
    append is a run of its own. Only keeping them never fails a run: where the write fails,
    the work is done again elsewhere, and if that fails too, its failure is raised.
    """
    spark = receipts.sparkSession
    try:
        commit_receipts(spark, stage_receipts(receipts, path), run_id)
        return True
    except Exception as error:
        materialise(receipts, "receipts-not-kept")
        log.warning("receipts were not written to %s: %s", path, error)
        return False


def write_batch_receipts(receipts: DataFrame, path: str, batch_id: int) -> None:
    """Receipts of one micro-batch in a folder of its own.

    A replayed batch replaces its own folder, so nothing is written twice and the
    cost does not grow with the receipts already there. A failure is raised, so that the
    batch counts as not handled.
    """
    receipts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def committed(spark: SparkSession, path: str) -> list[Staged]:
    """The last write of each run, in the order of their commits."""
    path = path.rstrip("/")
    files, runs = Files(spark, path), {}
    for number in files.numbers(f"{path}/log"):
        said = json.loads(files.text(numbered(f"{path}/log", number)))
        runs.pop(said["run"], None)
        runs[said["run"]] = Staged(path, said["write"], StructType.fromJson(said["schema"]))
    return list(runs.values())


def read_receipts(spark: SparkSession, path: str, stream_id: str | None = None) -> DataFrame:
    """Receipts that were committed; one stream reads one bucket. Columns that only some runs
    have are null for the others."""
    writes = committed(spark, path)
    if not writes:
        raise FileNotFoundError(f"no receipts under {path}")
    receipts = _read(spark, path.rstrip("/"), writes)
    if stream_id is None:
        return receipts.filter(F.col("bucket") >= 0).drop("bucket")
    mine = (F.col("bucket") == stream_bucket(F.lit(stream_id))) & (F.col("stream_id") == stream_id)
    return receipts.filter(mine).drop("bucket")


def stream_put(items: DataFrame, keys: tuple[str, ...] = ("stream_id", "timestamp"), order: str = "seq") -> DataFrame:
    """Put semantics: of several items on one key, the one put last stays.

    An aggregate instead of a window: copies fold map-side, so a key written over
    and over is no hot key, and nothing is sorted.
    """
    rest = [c for c in items.columns if c not in keys]
    last = items.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_item"))
    return last.select(*keys, *[F.col(f"_item.{c}").alias(c) for c in rest])
