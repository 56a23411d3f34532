from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.plans.catalog.registry import (
    COLLECTION_ITEMS, TYPE_STREAMS, MS, Tables, query, text,
)
from rowloom.sources.choices import inverted_map, lookup_choices, static_choices
from rowloom.sources.collections import exclude_jobs, multi_get, scan_collection, union_pages
from rowloom.sources.documents import parse_documents
from rowloom.session import scratch_path
from rowloom.sources.files import explode_files, file_events
from rowloom.sources.layout import of_jobs, read_clustered, write_clustered
from rowloom.sources.streams import read_stream, stream_events


@query("scan_collection", f"""WITH {COLLECTION_ITEMS}
SELECT owner, pk, object_id, lang, n_chars FROM collection_items
WHERE owner = 'h1/ops/collection.src0'""")
def _(t: Tables):
    return scan_collection(t.collection_items, "h1/ops/collection.src0").drop("doc_id")


@query("exclude_jobs", f"""WITH {COLLECTION_ITEMS}
SELECT owner, pk, object_id FROM collection_items WHERE pk IS NULL OR pk NOT LIKE '%/job.%'""")
def _(t: Tables):
    return exclude_jobs(t.collection_items).select("owner", "pk", "object_id")


@query("read_stream", f"""WITH {TYPE_STREAMS}
SELECT stream_id, timestamp, object_id, value FROM type_streams
WHERE stream_id = 'h1/ops/stream.click' AND timestamp > 1704153600000
ORDER BY timestamp, object_id LIMIT 500""")
def _(t: Tables):
    found = read_stream(t.type_streams, "h1/ops/stream.click", after_timestamp=1_704_153_600_000, limit=500)
    return found.select("stream_id", "timestamp", "object_id", "value")


@query("explode_files", """
SELECT 'h1/ops/job.f-' || (page_id // 100) AS object_id,
       row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) AS seq,
       count(*) OVER (PARTITION BY page_id // 100) AS n, url AS key
FROM pages""")
def _(t: Tables):
    return explode_files(t.file_jobs)


@query("multi_get", f"""WITH {COLLECTION_ITEMS}, keys AS (
    SELECT CAST(doc_id * 2 AS VARCHAR) AS object_id FROM labels)
SELECT object_id, 'found' AS outcome, lang FROM collection_items
WHERE object_id IN (SELECT object_id FROM keys)
UNION ALL
SELECT DISTINCT object_id, 'missing', NULL FROM keys
WHERE object_id NOT IN (SELECT object_id FROM collection_items)""")
def _(t: Tables):
    keys = t.read("labels").select((F.col("doc_id") * 2).cast("string").alias("object_id"))
    found, missing = multi_get(t.collection_items, keys)
    return found.select("object_id", F.lit("found").alias("outcome"), "lang").unionByName(
        missing.select("object_id", F.lit("missing").alias("outcome"), F.lit(None).cast("string").alias("lang"))
    )


@query("parse_documents", """
SELECT event_id, event_id % 11 = 0 AS is_bad,
       CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events""")
def _(t: Tables):
    # every 11th record is cut short; the others carry a field the schema does not know
    props = F.col("props")
    cut = F.substring(props, F.lit(1), F.length(props) - 1)
    raw = F.when(F.col("event_id") % 11 == 0, cut).otherwise(F.concat(cut, F.lit(', "extra": {"a": [1]}}')))
    parsed = parse_documents(t.read("events").select("event_id", raw.alias("raw")), "raw", "k bigint")
    return parsed.select("event_id", F.col("doc_error").isNotNull().alias("is_bad"), F.col("doc.k").alias("k"))


EVENT_KINDS = {"click": "PING", "view": "BLOB_CREATED", "purchase": "BLOB_DELETED", "signup": "GENERIC", "error": "SLACK"}


@query("stream_events", f"""
SELECT event_id, {MS} AS timestamp, user_id FROM events
WHERE event_type = 'signup' AND user_id % 10 = 3""")
def _(t: Tables):
    kind = F.lit(None).cast("string")
    for name, etype in EVENT_KINDS.items():
        kind = F.when(F.col("event_type") == name, etype).otherwise(kind)
    events = t.stream_items.withColumns({"etype": kind, "session_id": text("s", F.col("user_id") % 10)})
    return stream_events(events, etype="GENERIC", session_id="s3").select("event_id", "timestamp", "user_id")


@query("file_events", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'inbox/page-' || page_id || '.html'
                                 ELSE 'inbox/page-' || page_id || '.png' END AS key
FROM pages
WHERE page_id % 3 = 0 OR (page_id % 3 = 1 AND CAST(page_id AS VARCHAR) LIKE '1%')""")
def _(t: Tables):
    page = F.col("page_id")
    key = (
        F.when(page % 3 == 0, text("inbox/page-", page, ".html"))
        .when(page % 3 == 1, text("inbox/page-", page, ".png"))
        .otherwise(text("inbox/more/page-", page, ".html"))
    )
    files = t.read("pages").select("page_id", key.alias("key"))
    return file_events(files, "inbox/", ["*.html", "page-1*"])


@query("lookup_choices", """
SELECT 'c' || c_custkey AS value, c_name AS label FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def _(t: Tables):
    items = t.read("customer").select(
        text("c", F.col("c_custkey")).alias("object_id"), F.col("c_name").alias("name"), "c_mktsegment"
    )
    return lookup_choices(items, filter_by="c_mktsegment", filter_value="MACHINERY")


@query("static_choices", """
SELECT c_custkey, 0 AS position, c_mktsegment AS value, lower(c_mktsegment) AS label, c_acctbal < 0 AS disabled
FROM customer
UNION ALL SELECT c_custkey, 1, 'none', 'None', FALSE FROM customer""")
def _(t: Tables):
    choice = lambda value, label, disabled: F.struct(
        value.alias("value"), label.alias("label"), disabled.alias("disabled")
    )
    params = t.read("customer").select(
        "c_custkey",
        F.array(
            choice(F.col("c_mktsegment"), F.lower("c_mktsegment"), F.col("c_acctbal") < 0),
            choice(F.lit("none"), F.lit("None"), F.lit(None).cast("boolean")),
        ).alias("svals"),
    )
    return static_choices(params, "c_custkey")


@query("inverted_map", """
WITH pairs AS (
    SELECT c_name AS match, c_mktsegment AS value FROM customer
    UNION ALL SELECT 'at' || c_custkey, 'nation' || c_nationkey FROM customer)
SELECT DISTINCT value, match FROM pairs
WHERE value IN (SELECT 'nation' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'FURNITURE')""")
def _(t: Tables):
    records = t.read("customer").select(
        F.create_map(
            F.col("c_name"), F.col("c_mktsegment"),
            text("at", F.col("c_custkey")), text("nation", F.col("c_nationkey")),
        ).alias("mapping")
    )
    picked = t.read("nation").filter("n_regionkey = 1").select(text("nation", F.col("n_nationkey")).alias("value"))
    picked = picked.unionByName(t.values("value", ("FURNITURE",)))
    return inverted_map(records, picked)


@query("union_pages", f"""WITH {COLLECTION_ITEMS}
SELECT owner, pk, object_id FROM collection_items""")
def _(t: Tables):
    items = t.collection_items.select("owner", "pk", "object_id")
    # a first page that broke off, then the full scan that repeats its rows
    return union_pages(items.filter(F.col("object_id") < "5"), items)


@query("scan_clustered", f"""WITH {COLLECTION_ITEMS}
SELECT owner, object_id, lang, n_chars FROM collection_items
WHERE owner IN (SELECT 'h1/ops/collection.' || source FROM documents WHERE doc_id % 97 = 5) AND n_chars >= 200""")
def _(t: Tables):
    """Items of the collections that some jobs ask for, from a clustered copy of all."""
    path = scratch_path(t.spark, "clustered")
    write_clustered(t.collection_items.select("owner", "object_id", "lang", "n_chars"), path, sort=("n_chars",), folders=16)
    jobs = t.read("documents").filter("doc_id % 97 = 5").select(text("h1/ops/collection.", F.col("source")).alias("asked"))
    return of_jobs(t.spark.read.parquet(path), jobs, "asked", folders=16).filter("n_chars >= 200")


@query("read_stream_clustered", f"""WITH {TYPE_STREAMS}, middle AS (SELECT (min(timestamp) + max(timestamp)) // 2 AS half FROM type_streams)
SELECT stream_id, timestamp, object_id FROM type_streams, middle WHERE stream_id = 'h1/ops/stream.click' AND timestamp > half""")
def _(t: Tables):
    """One stream after a time: one folder, and in it the row groups after that time."""
    path = scratch_path(t.spark, "clustered")
    write_clustered(t.type_streams.select("stream_id", "timestamp", "object_id"), path, "stream_id", ("timestamp",), folders=16)
    ends = t.type_streams.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    items = read_clustered(t.spark, path, ["h1/ops/stream.click"], "stream_id", folders=16)
    return read_stream(items, "h1/ops/stream.click", after_timestamp=(ends.a + ends.b) // 2)
