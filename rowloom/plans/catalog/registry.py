"""Registration of queries and the inputs they share.

Inputs come twice: as DataFrames derived from the given tables, and as SQL common
table expressions for the check.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowloom.functions.text import epoch_millis
from rowloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


def text(*parts) -> Column:
    """Concatenate columns and literal texts."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


class Tables:
    """The given tables and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]

    def values(self, names: str, *rows: tuple) -> DataFrame:
        """A few fixed rows as a local relation, whose size the planner knows."""
        written = ", ".join(str(row) if len(row) > 1 else f"({row[0]!r})" for row in rows)
        return self.spark.sql(f"SELECT * FROM VALUES {written} AS fixed({names})")

    @cached_property
    def stream_items(self) -> DataFrame:
        """One stream per user and event type."""
        return self._events(text("h1/u", F.col("user_id"), "/stream.", F.col("event_type")))

    @cached_property
    def type_streams(self) -> DataFrame:
        """One stream per event type, long enough for the read limit to matter."""
        return self._events(text("h1/ops/stream.", F.col("event_type")))

    def _events(self, stream_id: Column) -> DataFrame:
        return self.read("events").select(
            stream_id.alias("stream_id"),
            epoch_millis(F.col("ts")).alias("timestamp"),
            F.col("event_id").cast("string").alias("object_id"),
            "event_id", "user_id", "event_type", "value", "props",
        )

    @cached_property
    def collection_items(self) -> DataFrame:
        owner = text("h1/ops/collection.", F.col("source"))
        return self.read("documents").select(
            owner.alias("owner"),
            F.when(F.col("doc_id") % 10 == 0, text("h1/ops/job.", F.col("doc_id")))
            .when(F.col("doc_id") % 10 != 1, F.concat(owner, text(".", F.col("doc_id"))))
            .alias("pk"),
            F.col("doc_id").cast("string").alias("object_id"),
            "doc_id", "lang", "n_chars",
        )

    @cached_property
    def collection_jobs(self) -> DataFrame:
        """One job per source, one on an empty collection and one without a collection."""
        jobs = self.read("documents").select("source").distinct()
        fixed = self.values("source, o", ("none", "h1/ops/collection.none"), ("bad", ""))
        owner = text("h1/ops/collection.", F.col("source"))
        return (
            jobs.withColumn("o", owner)
            .unionByName(fixed)
            .select(
                text("h1/ops/job.", F.col("source")).alias("object_id"),
                F.lit("ops").alias("username"),
                F.lit("h1").alias("hostname"),
                F.lit("run_on_collection").alias("job_type"),
                F.col("o").alias("collection_owner"),
                F.create_map(F.lit("lang"), F.lit("xx"), F.lit("tone"), F.lit("plain")).alias("input_data"),
            )
        )

    @cached_property
    def stream_jobs(self) -> DataFrame:
        """One job per event type, and one on a stream that does not exist."""
        kinds = self.read("events").select("event_type").distinct()
        kinds = kinds.unionByName(self.values("event_type", ("nothing",)))
        return kinds.select(
            text("h1/ops/job.s-", F.col("event_type")).alias("object_id"),
            F.lit("ops").alias("username"),
            F.lit("h1").alias("hostname"),
            F.lit("run_on_stream").alias("job_type"),
            text("h1/ops/stream.", F.col("event_type")).alias("stream_id"),
            F.create_map(F.lit("floor"), F.lit("50")).alias("input_data"),
        )

    @cached_property
    def file_jobs(self) -> DataFrame:
        """One job per hundred pages, with their urls as file keys."""
        keys = self.read("pages").groupBy(F.floor(F.col("page_id") / 100).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("page_id", "url"))).alias("_k")
        )
        return keys.select(
            text("h1/ops/job.f-", F.col("block")).alias("object_id"),
            F.lit("ops").alias("username"),
            F.lit("h1").alias("hostname"),
            F.lit("run_on_files").alias("job_type"),
            F.col("_k.url").alias("file_keys"),
            F.lit("in/").alias("prefix"),
            F.create_map(F.lit("key"), F.lit("hidden"), F.lit("mode"), F.lit("fast")).alias("input_data"),
        )

    @cached_property
    def unnumbered_receipts(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_type").alias("job_id"),
            text("h1/ops/stream-run-all.", F.col("event_type")).alias("stream_id"),
            F.col("event_id").cast("string").alias("object_id"),
            "event_id",
            "user_id",
            epoch_millis(F.col("ts")).alias("timestamp"),
            (F.col("value") >= 50).alias("success"),
            F.when(F.col("value") < 50, text("low value ", F.col("event_id") % 7)).alias("error_message"),
            F.col("value").alias("cost"),
        )

    @cached_property
    def receipts(self) -> DataFrame:
        """Receipts of one job per event type. They are numbered per day of a job, so
        that no job is numbered in one task: rank in the day plus the days before."""
        rows = self.unnumbered_receipts.withColumn("_day", F.floor(F.col("timestamp") / 86_400_000))
        days = rows.groupBy("job_id", "_day").agg(F.count(F.lit(1)).alias("_size"))
        before = Window.partitionBy("job_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
        days = days.select("job_id", "_day", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
        in_day = Window.partitionBy("job_id", "_day").orderBy("timestamp", "event_id")
        return (
            rows.withColumn("_rank", F.row_number().over(in_day))
            .join(days, ["job_id", "_day"])
            .withColumn("seq", (F.col("_before") + F.col("_rank")).cast("bigint"))
            .drop("_day", "_before", "_rank", "event_id")
        )

    @cached_property
    def outputs(self) -> DataFrame:
        return self.read("labels").select(F.col("doc_id").cast("string").alias("object_id"), "quality", "toxic")


MS = "(epoch_us(ts) // 1000)"

STREAM_ITEMS = f"""stream_items AS (
    SELECT 'h1/u' || user_id || '/stream.' || event_type AS stream_id, {MS} AS timestamp,
           CAST(event_id AS VARCHAR) AS object_id, event_id, user_id, event_type, value, props
    FROM events)"""

TYPE_STREAMS = f"""type_streams AS (
    SELECT 'h1/ops/stream.' || event_type AS stream_id, {MS} AS timestamp,
           CAST(event_id AS VARCHAR) AS object_id, event_id, user_id, event_type, value, props
    FROM events)"""

COLLECTION_ITEMS = """collection_items AS (
    SELECT 'h1/ops/collection.' || source AS owner,
           CASE WHEN doc_id % 10 = 0 THEN 'h1/ops/job.' || doc_id
                WHEN doc_id % 10 = 1 THEN NULL
                ELSE 'h1/ops/collection.' || source || '.' || doc_id END AS pk,
           CAST(doc_id AS VARCHAR) AS object_id, doc_id, lang, n_chars
    FROM documents)"""

# items of the collections without job records, with their id
COLLECTION_ROWS = COLLECTION_ITEMS + """, collection_rows AS (
    SELECT *, coalesce(pk, object_id, 'unknown') AS item_id
    FROM collection_items WHERE NOT contains(coalesce(pk, ''), '/job.'))"""

COLLECTION_JOBS = """collection_jobs AS (
    SELECT 'h1/ops/job.' || source AS object_id, 'h1/ops/collection.' || source AS collection_owner
    FROM (SELECT DISTINCT source FROM documents)
    UNION ALL SELECT 'h1/ops/job.none', 'h1/ops/collection.none'
    UNION ALL SELECT 'h1/ops/job.bad', '')"""

RECEIPTS = f"""receipts AS (
    SELECT event_type AS job_id, 'h1/ops/stream-run-all.' || event_type AS stream_id,
           CAST(event_id AS VARCHAR) AS object_id, user_id, {MS} AS timestamp,
           value >= 50 AS success,
           CASE WHEN value < 50 THEN 'low value ' || (event_id % 7) END AS error_message,
           value AS cost,
           row_number() OVER (PARTITION BY event_type ORDER BY {MS}, event_id) AS seq
    FROM events)"""
