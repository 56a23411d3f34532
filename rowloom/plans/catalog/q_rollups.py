from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.progress import job_progress, thin_progress
from rowloom.operators.rollup import (
    cost_rollup, empty_jobs, final_status, job_counts, latest_receipt, trigger_stats,
)
from rowloom.plans.catalog.registry import RECEIPTS, Tables, query, text
from rowloom.session import materialise


@query("job_counts", f"""WITH {RECEIPTS}
SELECT job_id, count(*) FILTER (WHERE success) AS success_count,
       count(*) FILTER (WHERE NOT success) AS error_count, count(*) AS n
FROM receipts GROUP BY job_id""")
def _(t: Tables):
    return job_counts(t.unnumbered_receipts)


# users as jobs; the threshold moves with the user, so some jobs fail wholly, some not at all
FINAL = """counts AS (
    SELECT user_id AS job_id, count(*) AS n, count(*) FILTER (WHERE value >= (user_id % 3) * 60 - 20) AS success_count,
           count(*) FILTER (WHERE value < (user_id % 3) * 60 - 20) AS error_count
    FROM events GROUP BY user_id)"""


@query("final_status", f"""WITH {FINAL}
SELECT job_id, success_count, error_count,
       CASE WHEN error_count > 0 AND success_count = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
       CASE WHEN error_count > 0 AND success_count = 0
            THEN 'All ' || error_count || CASE WHEN job_id % 2 = 0 THEN ' files' ELSE ' items' END || ' failed'
            WHEN error_count > 0
            THEN error_count || ' of ' || n || CASE WHEN job_id % 2 = 0 THEN ' files' ELSE ' items' END || ' failed'
            END AS error_message
FROM counts""")
def _(t: Tables):
    rows = t.read("events").select(
        F.col("user_id").alias("job_id"), (F.col("value") >= (F.col("user_id") % 3) * 60 - 20).alias("success")
    )
    what = F.when(F.col("job_id") % 2 == 0, F.lit("files")).otherwise(F.lit("items"))
    return final_status(job_counts(rows), what).select(
        "job_id", "success_count", "error_count", "status", "error_message"
    )


@query("empty_jobs", """WITH kinds AS (
    SELECT doc_id, 'h1/ops/job.d' || doc_id AS object_id,
           CASE doc_id % 3 WHEN 0 THEN 'run_on_collection' WHEN 1 THEN 'run_on_stream' ELSE 'run_on_files' END AS job_type
    FROM documents)
SELECT object_id, job_type, 'SUCCEEDED' AS status, CASE job_type WHEN 'run_on_collection' THEN
       'No items found in collection' WHEN 'run_on_stream' THEN 'No items found in stream'
       ELSE 'No files to process' END AS error_message,
       CAST(NULL AS INTEGER) AS percent, CAST(NULL AS BIGINT) AS success_count, CAST(NULL AS BIGINT) AS error_count
FROM kinds WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def _(t: Tables):
    """A job per document, whose items are its labels; most documents have none."""
    key = F.col("doc_id")
    kind = F.when(key % 3 == 0, "run_on_collection").when(key % 3 == 1, "run_on_stream").otherwise("run_on_files")
    name = text("h1/ops/job.d", key)
    jobs = t.read("documents").select(name.alias("object_id"), kind.alias("job_type"))
    receipts = t.read("labels").select(name.alias("job_id"), (F.col("quality") == 1).alias("success"))
    return empty_jobs(jobs, job_counts(receipts))


@query("trigger_stats", f"""WITH {RECEIPTS}
SELECT job_id, user_id, count(*) AS run_count, count(*) FILTER (WHERE NOT success) AS error_count,
       max(timestamp) AS last_run_at, max(timestamp) FILTER (WHERE NOT success) AS last_err_at,
       arg_max(error_message, seq) FILTER (WHERE NOT success) AS last_err_message,
       arg_max(object_id, seq) AS last_object_id, arg_max(success, seq) AS last_success
FROM receipts GROUP BY job_id, user_id""")
def _(t: Tables):
    return trigger_stats(t.unnumbered_receipts, ["job_id", "user_id"], tie="event_id")


@query("latest_receipt", f"""WITH {RECEIPTS}, ranked AS (
    SELECT *, row_number() OVER (PARTITION BY job_id, user_id ORDER BY timestamp DESC, seq DESC) AS rn FROM receipts)
SELECT job_id, user_id, object_id, success, error_message, timestamp, cost FROM ranked WHERE rn = 1""")
def _(t: Tables):
    newest = latest_receipt(t.unnumbered_receipts, ["job_id", "user_id"], tie="event_id")
    return newest.select("job_id", "user_id", "object_id", "success", "error_message", "timestamp", "cost")


@query("cost_rollup", f"""WITH {RECEIPTS}
SELECT job_id, user_id, CAST(sum(CAST(cost AS DECIMAL(18, 6))) AS DOUBLE) AS total_cost, count(cost) AS costed
FROM receipts GROUP BY job_id, user_id""")
def _(t: Tables):
    return cost_rollup(t.unnumbered_receipts)


@query("job_progress", f"""WITH {RECEIPTS}, counted AS (
    SELECT job_id, seq, count(*) OVER (PARTITION BY job_id) AS n,
           count(*) FILTER (WHERE success) OVER w AS success_count,
           count(*) FILTER (WHERE NOT success) OVER w AS error_count
    FROM receipts WINDOW w AS (PARTITION BY job_id ORDER BY seq))
SELECT job_id, seq, n, success_count, error_count,
       CAST(floor((seq::DOUBLE / n::DOUBLE) * 100) AS INTEGER) AS percent
FROM counted""")
def _(t: Tables):
    return job_progress(t.receipts).select("job_id", "seq", "n", "success_count", "error_count", "percent")


# receipts sped up, so that one percent of a job takes some seconds to some minutes
THIN = """
WITH RECURSIVE fast AS (
    SELECT event_type AS job_id, {ms} // 100 AS timestamp,
           row_number() OVER (PARTITION BY event_type ORDER BY {ms}, event_id) AS seq,
           count(*) OVER (PARTITION BY event_type) AS n
    FROM events),
steps AS (
    SELECT job_id, timestamp, seq, CAST(floor((seq::DOUBLE / n::DOUBLE) * 100) AS INTEGER) AS percent FROM fast),
walk AS (
    SELECT job_id, 0::BIGINT AS seq, 0 AS last_percent, min(timestamp) - 30000 AS last_time, FALSE AS kept
    FROM steps GROUP BY job_id
    UNION ALL
    SELECT w.job_id, s.seq,
           CASE WHEN s.percent <> w.last_percent OR s.timestamp - w.last_time >= 60000 THEN s.percent ELSE w.last_percent END,
           CASE WHEN s.percent <> w.last_percent OR s.timestamp - w.last_time >= 60000 THEN s.timestamp ELSE w.last_time END,
           s.percent <> w.last_percent OR s.timestamp - w.last_time >= 60000
    FROM walk w JOIN steps s ON s.job_id = w.job_id AND s.seq = w.seq + 1)
SELECT job_id, seq, last_percent AS percent, last_time AS timestamp FROM walk WHERE kept
""".replace("{ms}", "(epoch_us(ts) // 1000)")


@query("thin_progress", THIN)
def _(t: Tables):
    fast = materialise(t.receipts.withColumn("timestamp", F.floor(F.col("timestamp") / 100)), "receipts")
    starts = fast.groupBy("job_id").agg((F.min("timestamp") - 30_000).alias("started_at"))
    progress = materialise(job_progress(fast).join(starts, "job_id"), "progress")
    return thin_progress(progress).select("job_id", "seq", "percent", "timestamp")
