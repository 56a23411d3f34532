"""Whole runs from jobs to final rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowloom.functions.inputs import fields_of
from rowloom.plans.catalog.q_actions import LABEL
from rowloom.plans.catalog.q_joins import FAN_OUT
from rowloom.plans.catalog.q_streaming import FLOOR
from rowloom.plans.catalog.registry import COLLECTION_ITEMS, Tables, query
from rowloom.operators.actions import Action, fail, succeed
from rowloom.plans.run import collection_work, run_jobs, store_items
from rowloom.session import scratch_path
from rowloom.sinks.documents import read_documents
from rowloom.operators.actions import build_receipts, run_action
from rowloom.operators.jobs import resolve_jobs, validate_jobs
from rowloom.operators.rollup import finish_jobs, job_counts

CLOCK_MS = 1_750_000_000_000


def labelled_items(t: Tables) -> DataFrame:
    """Collection items whose fields carry their label, where there is one."""
    fields = F.map_filter(
        fields_of({n: F.col(n) for n in ("lang", "n_chars", "quality", "toxic")}), lambda _k, v: v.isNotNull()
    )
    items = t.collection_items.join(t.outputs, "object_id", "left")
    return items.select("owner", "pk", "object_id", fields.alias("fields"))


JOB_ROWS = f"""WITH {FAN_OUT}, done AS (
    SELECT job_id, count(l.doc_id) AS good, count(*) - count(l.doc_id) AS bad, count(*) AS total
    FROM fan_out LEFT JOIN labels l USING (doc_id) GROUP BY job_id)
SELECT j.object_id, 'run_on_collection' AS job_type,
       CASE WHEN bad > 0 AND good = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
       CASE WHEN total IS NULL THEN 'No items found in collection'
            WHEN bad > 0 AND good = 0 THEN 'All ' || bad || ' items failed'
            WHEN bad > 0 THEN bad || ' of ' || total || ' items failed' END AS error_message,
       CASE WHEN total IS NOT NULL THEN 100 END AS percent, good AS success_count, bad AS error_count
FROM collection_jobs j LEFT JOIN done ON done.job_id = j.object_id WHERE j.collection_owner <> ''"""


def label_run(t: Tables) -> DataFrame:
    """Look up the label of every item of every collection and sum up the jobs, as
    one lazy plan: the action is pure, so nothing need be stored in between."""
    jobs = validate_jobs(resolve_jobs(t.collection_jobs)).filter(F.col("reject_reason").isNull())
    results = run_action(collection_work(jobs, labelled_items(t), t.collection_items), LABEL)
    return finish_jobs(jobs, job_counts(build_receipts(results, F.lit(CLOCK_MS))))


@query("label_run", JOB_ROWS)
def _(t: Tables):
    return label_run(t)


@query("run_on_collection", JOB_ROWS)
def _(t: Tables):
    return run_jobs(t.collection_jobs, LABEL, CLOCK_MS, items=labelled_items(t)).jobs


@query("run_on_stream", """
WITH ranked AS (
    SELECT event_type, value >= 50 AS ok,
           row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, CAST(event_id AS VARCHAR)) AS seq
    FROM events),
done AS (
    SELECT event_type, count(*) AS total, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad
    FROM ranked GROUP BY event_type)
SELECT 'h1/ops/job.s-' || event_type AS object_id, 'run_on_stream' AS job_type,
       CASE WHEN bad > 0 AND good = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
       CASE WHEN bad > 0 AND good = 0 THEN 'All ' || bad || ' items failed'
            WHEN bad > 0 THEN bad || ' of ' || total || ' items failed' END AS error_message,
       100 AS percent, good AS success_count, bad AS error_count
FROM done
UNION ALL SELECT 'h1/ops/job.s-nothing', 'run_on_stream', 'SUCCEEDED', 'No items found in stream', NULL, NULL, NULL""")
def _(t: Tables):
    events = t.type_streams.withColumn("fields", fields_of({"value": F.col("value")}))
    return run_jobs(t.stream_jobs, FLOOR, CLOCK_MS, events=events).jobs


def _secure(inputs):
    return F.when(inputs["key"].startswith("https:"), succeed({"filename": inputs["filename"]})).otherwise(
        fail(F.lit("not secure"))
    )


SECURE = Action("file.secure", ("key", "filename"), native=_secure)


@query("run_on_files", """
WITH done AS (
    SELECT page_id // 100 AS block, count(*) AS total, count(*) FILTER (WHERE url LIKE 'https:%') AS good,
           count(*) FILTER (WHERE url NOT LIKE 'https:%') AS bad
    FROM pages GROUP BY 1)
SELECT 'h1/ops/job.f-' || block AS object_id, 'run_on_files' AS job_type,
       CASE WHEN bad > 0 AND good = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
       CASE WHEN bad > 0 AND good = 0 THEN 'All ' || bad || ' files failed'
            WHEN bad > 0 THEN bad || ' of ' || total || ' files failed' END AS error_message,
       100 AS percent, good AS success_count, bad AS error_count
FROM done""")
def _(t: Tables):
    return run_jobs(t.file_jobs, SECURE, CLOCK_MS).jobs


def _size(inputs):
    n = inputs.number("n_chars")
    return F.when(n % 10 == 3, fail(F.lit("no size"))).otherwise(succeed({"size": F.floor(n / 100), "lang": inputs["lang"]}))


SIZE = Action("doc.size", ("n_chars", "lang"), native=_size)


@query("run_writes_back", f"""WITH {COLLECTION_ITEMS}
SELECT coalesce(pk, object_id) AS item_id, n_chars, CASE WHEN done THEN CAST(n_chars // 100 AS VARCHAR) END AS size,
       CASE WHEN done THEN 'xx' END AS said
FROM (SELECT *, NOT contains(coalesce(pk, ''), '/job.') AND n_chars % 10 <> 3 AS done FROM collection_items)""")
def _(t: Tables):
    """Items in a store, run over and written back in one call; those that failed stay as they were."""
    root = scratch_path(t.spark, "items")
    fields = fields_of({"n_chars": F.col("n_chars")})
    store_items(t.collection_items.select("owner", "pk", "object_id", fields.alias("fields")), root)
    links = t.collection_jobs.select("object_id", F.explode(F.array(*[
        F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in (("size", "size"), ("lang", "said"))
    ])).alias("link")).select("object_id", "link.source", "link.target")
    run_jobs(t.collection_jobs, SIZE, CLOCK_MS, items_root=root, mappings=links)
    back = read_documents(t.spark, root)
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return back.select("item_id", field("n_chars").cast("bigint").alias("n_chars"), field("size").alias("size"), field("said").alias("said"))
