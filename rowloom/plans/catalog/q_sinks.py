from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.plans.catalog.registry import COLLECTION_ITEMS, RECEIPTS, Tables, query, text
from rowloom.session import scratch_path
from rowloom.sinks.destinations import write_destination
from rowloom.sinks.documents import read_documents, snapshot, upsert_into
from rowloom.sinks.files import write_files
from rowloom.sinks.receipts import append_receipts, read_receipts, stream_put


@query("append_receipts", f"""WITH {RECEIPTS}
SELECT stream_id, object_id, seq, success, error_message, timestamp FROM receipts""")
def _(t: Tables):
    """Two runs, of which one is appended again: its receipts stay once."""
    path = scratch_path(t.spark, "receipts")
    rows = t.receipts.select("stream_id", "object_id", "seq", "success", "error_message", "timestamp")
    early = F.col("seq") <= 50
    append_receipts(rows.filter(early), path, "first")
    append_receipts(rows.filter(~early), path, "second")
    append_receipts(rows.filter(early), path, "first")
    return read_receipts(t.spark, path)


@query("stream_put", f"""WITH {RECEIPTS}, hourly AS (
    SELECT *, timestamp // 3600000 * 3600000 AS hour,
           row_number() OVER (PARTITION BY stream_id, timestamp // 3600000 ORDER BY seq DESC) AS rn
    FROM receipts)
SELECT stream_id, hour AS timestamp, object_id, success, error_message FROM hourly WHERE rn = 1""")
def _(t: Tables):
    hour = F.floor(F.col("timestamp") / 3_600_000) * 3_600_000
    kept = stream_put(t.receipts.withColumn("timestamp", hour))
    return kept.select("stream_id", "timestamp", "object_id", "success", "error_message")


@query("upsert_documents", f"""WITH {COLLECTION_ITEMS}, fresh AS (
    SELECT CASE WHEN doc_id % 3 = 0 THEN 'new' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS object_id,
           'q' || quality AS lang, CAST(toxic AS BIGINT) AS n_chars
    FROM labels),
first AS (
    SELECT object_id, lang, n_chars FROM collection_items WHERE object_id NOT IN (SELECT object_id FROM fresh)
    UNION ALL SELECT object_id, lang, n_chars FROM fresh),
again AS (
    SELECT CAST(l_orderkey % 500 AS VARCHAR) AS object_id, 'r' || max(l_orderkey) AS lang,
           max(l_orderkey * 100 + l_linenumber) AS n_chars
    FROM lineitem GROUP BY 1)
SELECT * FROM first WHERE object_id NOT IN (SELECT object_id FROM again)
UNION ALL SELECT * FROM again""")
def _(t: Tables):
    """Two rounds of writes onto a first one; in the last, many rows come for one key."""
    root = scratch_path(t.spark, "documents")
    upsert_into(t.collection_items.select("object_id", "lang", "n_chars"), root)
    fresh = t.read("labels").select(
        F.when(F.col("doc_id") % 3 == 0, text("new", F.col("doc_id")))
        .otherwise(F.col("doc_id").cast("string")).alias("object_id"),
        text("q", F.col("quality")).alias("lang"),
        F.col("toxic").cast("bigint").alias("n_chars"),
    )
    upsert_into(fresh, root, base=snapshot(t.spark, root))
    again = t.read("lineitem").select(
        (F.col("l_orderkey") % 500).cast("string").alias("object_id"),
        text("r", F.col("l_orderkey")).alias("lang"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("bigint").alias("n_chars"),
    )
    upsert_into(again, root, order="n_chars")
    return read_documents(t.spark, root)


@query("write_files", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t: Tables):
    orders = t.read("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    folder = write_files(orders, scratch_path(t.spark, "orders"), "json")
    return t.spark.read.schema(orders.schema).json(folder)


@query("write_destination", f"""WITH {RECEIPTS}
SELECT CASE user_id % 4 WHEN 0 THEN 'STREAM' WHEN 1 THEN 'COLLECTION' ELSE 'FILE' END AS kind,
       CASE user_id % 4 WHEN 0 THEN 'h1/ops/stream.out' WHEN 1 THEN 'h1/ops/collection.out' END AS target,
       object_id, success
FROM receipts WHERE user_id % 4 < 3""")
def _(t: Tables):
    rows = t.unnumbered_receipts.select("object_id", "user_id", "timestamp", "success")
    destinations = [
        {"kind": "STREAM", "stream_id": "h1/ops/stream.out"},
        {"kind": "COLLECTION", "owner": "h1/ops/collection.out"},
        {"kind": "FILE", "extension": "json"},
        {"kind": "INACTIVE"},
    ]
    out = None
    for part, where in enumerate(destinations):
        where["path"] = scratch_path(t.spark, where["kind"].lower())
        mine = rows.filter(F.col("user_id") % 4 == part)
        if where["kind"] == "COLLECTION":  # two writes: the second adds to what the first left
            write_destination(mine.filter("crc32(object_id) % 3 < 2"), where)
            mine = mine.filter("crc32(object_id) % 3 > 0")
        folder = write_destination(mine, where)
        if folder is None:
            continue
        if where["kind"] == "COLLECTION":
            back = read_documents(t.spark, folder)
        elif where["kind"] == "FILE":
            back = t.spark.read.schema("object_id string, success boolean").json(folder)
        else:
            back = read_receipts(t.spark, folder)
        target = {"STREAM": "stream_id", "COLLECTION": "owner"}.get(where["kind"])
        back = back.select(
            F.lit(where["kind"]).alias("kind"),
            (F.col(target) if target else F.lit(None).cast("string")).alias("target"),
            "object_id", "success",
        )
        out = back if out is None else out.unionByName(back)
    return out
