from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowloom.functions.inputs import fields_of
from rowloom.operators.actions import Action, fail, succeed
from rowloom.plans.catalog.registry import MS, Tables, query, text
from rowloom.session import scratch_path
from rowloom.streaming.runs import (
    drain, live_counts, read_live_counts, read_new_files, run_on_stream_incremental,
)
from rowloom.streaming.puts import STATE_STORE, read_puts, stream_put_live
from rowloom.streaming.triggers import collection_changes, file_trigger, read_new_binary_files, stream_trigger


def _check_floor(inputs):
    value, floor = inputs.number("value"), inputs.number("floor")
    return (
        F.when(value.isNull() | floor.isNull(), fail(F.lit("not a number")))
        .when(value < floor, fail(text("below ", inputs["floor"])))
        .otherwise(succeed({"value": inputs["value"]}))
    )


FLOOR = Action("event.floor", ("value", "floor"), native=_check_floor)


def live(t: Tables) -> DataFrame:
    """The events table as a stream of files, be it one file or a folder of them."""
    events = read_new_files(t.spark, t.path("{events}"), t.read("events").schema)
    return events.select(
        text("h1/ops/stream.", F.col("event_type")).alias("stream_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        "event_id", "user_id", "event_type", "value", "props",
    )


INCREMENTAL = f"""
SELECT 'h1/ops/job.s-' || event_type AS job_id, 'h1/ops/stream-run-all.s-' || event_type AS stream_id,
       'h1/ops/stream.' || event_type || '@' || {MS} AS object_id, {MS} AS timestamp, event_id AS seq,
       value >= 50 AND event_id % 10 > 0 AS success,
       CASE WHEN event_id % 10 = 0 THEN 'not a number' WHEN value < 50 THEN 'below 50' END AS error_message
FROM events"""


def incremental(t: Tables, events: DataFrame, **how) -> DataFrame:
    out = scratch_path(t.spark, "receipts")
    # every tenth value is malformed: it fails its own item and no other
    value = F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    fields = fields_of({"value": value, "event_type": F.col("event_type")})
    run_on_stream_incremental(
        events, lambda: t.stream_jobs, FLOOR, fields, out, scratch_path(t.spark, "offsets"), event_key="event_id", **how
    )
    receipts = t.spark.read.parquet(out)
    return receipts.select("job_id", "stream_id", "object_id", "timestamp", "seq", "success", "error_message")


@query("run_on_stream_incremental", INCREMENTAL)
def _(t: Tables):
    return incremental(t, live(t))


@query("run_on_stream_repeats", INCREMENTAL)
def _(t: Tables):
    """Every third event arrives twice, and gives one receipt."""
    return incremental(t, live(t).unionByName(live(t).filter("event_id % 3 = 0")), repeats_within="1 day")


@query("stream_put_live", f"""WITH hourly AS (
    SELECT 'h1/ops/stream.' || event_type AS stream_id, {MS} // 3600000 * 3600000 AS timestamp, event_id, user_id, value,
           row_number() OVER (PARTITION BY event_type, {MS} // 3600000 ORDER BY event_id DESC) AS rn
    FROM events)
SELECT stream_id, timestamp, event_id, user_id, value FROM hourly WHERE rn = 1""")
def _(t: Tables):
    """The last put of each stream and hour, with the keys' last puts as state."""
    out, kept = scratch_path(t.spark, "puts"), t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    hour = (F.floor(F.col("timestamp") / 3_600_000) * 3_600_000).alias("timestamp")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        puts = live(t).select("stream_id", hour, "event_id", "user_id", "value")
        stream_put_live(puts, out, scratch_path(t.spark, "offsets"), order="event_id")
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return read_puts(t.spark, out, order="event_id")


@query("live_counts", """
SELECT event_type AS job_id, count(*) FILTER (WHERE value >= 50) AS success_count,
       count(*) FILTER (WHERE value < 50) AS error_count
FROM events GROUP BY event_type""")
def _(t: Tables):
    out = scratch_path(t.spark, "counts")
    receipts = live(t).select(F.col("event_type").alias("job_id"), (F.col("value") >= 50).alias("success"))
    live_counts(receipts, out, scratch_path(t.spark, "offsets"))
    return read_live_counts(t.spark, out)


@query("stream_trigger", """
SELECT event_id, value >= 50 AS success, CASE WHEN value >= 50 THEN value END AS amount,
       CASE WHEN value >= 50 THEN 'graded' END AS state
FROM events WHERE event_type = 'click'""")
def _(t: Tables):
    events = live(t).withColumn("data", fields_of({"amount": F.col("value")}))
    done = stream_trigger(
        events, FLOOR,
        in_map=[{"src": "amount", "dest": "value"}, {"dest": "floor", "static": "50"}],
        out_map=[{"src": "value", "dest": "amount"}, {"dest": "state", "static": "graded"}],
        stream_id="h1/ops/stream.click",
    )
    mapped = lambda name: F.try_element_at("mapped", F.lit(name))
    rows = done.select(
        "event_id", "result.success", mapped("amount").cast("double").alias("amount"), mapped("state").alias("state")
    )
    out = scratch_path(t.spark, "triggered")
    drain(rows, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), scratch_path(t.spark, "offsets"))
    return t.spark.read.parquet(out).drop("batch_id")


def _count_titles(inputs):
    body = inputs.column("content").cast("string")
    times = lambda part: F.length(body) - F.length(F.replace(body, F.lit(part), F.lit("")))
    return succeed({"pages": times("\n"), "titles": times("<h1>") / 4, "chars": F.length(body)})


COUNT_TITLES = Action("file.count_titles", ("key", "content"), native=_count_titles)


@query("file_trigger", """
SELECT substring(url, 1, 5) AS kind, count(*) AS pages,
       CAST(sum((length(html) - length(replace(html, '<h1>', ''))) // 4) AS BIGINT) AS titles
FROM pages WHERE page_id % 4 < 3 GROUP BY 1""")
def _(t: Tables):
    # pages become files of at most 5,000 lines: inbox/kind=…/part-*.json, and one kind of name not asked for
    inbox = scratch_path(t.spark, "inbox")
    pages = t.read("pages").select("page_id", "html", F.substring("url", 1, 5).alias("kind"))
    writer = lambda rows, name: (
        rows.write.partitionBy("kind").option("maxRecordsPerFile", 5_000).json(f"{inbox}/{name}")
    )
    writer(pages.filter("page_id % 4 < 3"), "wanted")
    writer(pages.filter("page_id % 4 = 3"), "other")
    files = read_new_binary_files(t.spark, inbox, "*.json")
    key = F.substring_index("path", "/inbox/", -1)
    done = file_trigger(
        files, COUNT_TITLES, "wanted/", ["part-*.json"], recursive=True, key=key, columns={"content": F.col("content")}
    )
    number = lambda n: F.try_element_at("result.outputs", F.lit(n)).cast("double").cast("bigint").alias(n)
    rows = done.select(F.regexp_extract("path", "kind=([^/]*)/", 1).alias("kind"), number("pages"), number("titles"))
    out = scratch_path(t.spark, "counted")
    drain(rows, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), scratch_path(t.spark, "offsets"))
    counted = t.spark.read.parquet(out).groupBy("kind").agg(F.sum("pages").alias("pages"), F.sum("titles").alias("titles"))
    return counted.select(F.url_decode("kind").alias("kind"), "pages", "titles")


@query("collection_changes", """
SELECT doc_id, CASE WHEN doc_id % 14 = 7 THEN NULL ELSE lang END AS lang,
       n_chars + CASE WHEN doc_id % 14 = 0 THEN 1 ELSE 0 END AS n_chars
FROM documents WHERE doc_id % 7 IN (0, 1, 2, 5)""")
def _(t: Tables):
    """Changes of a text, a null in a list, a microsecond and the last digit of a double; entries
    of a map in another order, minus zero and no numbers are none."""
    key = F.col("doc_id")
    docs = t.read("documents").select("doc_id", "text", "lang", "n_chars")
    pair = lambda k: (F.lit(k), F.concat(F.col("lang"), F.lit(k)))

    def version(changed: int):
        third, fourth = F.create_map(*pair("a"), *pair("b")), F.create_map(*pair("b"), *pair("a"))
        return docs.withColumns({
            "tags": F.array(F.when(key % 7 == 1, F.lit("null" if changed else None)).otherwise(F.col("lang"))),
            "at": F.timestamp_micros(key * 1_000_003 + F.when(key % 7 == 2, changed).otherwise(0)),
            "more": F.when(key % 7 == 3, fourth if changed else third).otherwise(third),
            "score": F.when(key % 7 == 4, F.when(key % 2 == 0, F.lit(float("nan"))).otherwise(-0.0 if changed else 0.0))
            .when(key % 7 == 5, F.lit(0.1 + 0.2 if changed else 0.3)).otherwise(key / 7),
        })

    new = version(1).withColumns({
        "lang": F.when(key % 14 != 7, F.col("lang")),
        "n_chars": F.col("n_chars") + F.when(key % 14 == 0, 1).otherwise(0),
    })
    old = version(0)
    return collection_changes(old, new, "doc_id").select("doc_id", "lang", "n_chars")
