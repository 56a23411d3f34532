from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions.inputs import fields_of, overlay
from rowloom.operators.fanout import fan_out_collection, fan_out_files, fan_out_stream
from rowloom.operators.groups import match_groups
from rowloom.operators.updates import derive_mappings, update_back
from rowloom.plans.catalog.q_scalars import only_if
from rowloom.plans.catalog.registry import (
    COLLECTION_ITEMS, COLLECTION_JOBS, COLLECTION_ROWS, TYPE_STREAMS, Tables, query, text,
)
from rowloom.schemas import MAPPINGS
from rowloom.sources.collections import exclude_jobs, with_item_id

FAN_OUT = f"""{COLLECTION_ROWS}, {COLLECTION_JOBS}, fan_out AS (
    SELECT j.object_id AS job_id, i.*,
           row_number() OVER (PARTITION BY j.object_id
                              ORDER BY md5(i.item_id), i.item_id, i.object_id) AS seq,
           count(*) OVER (PARTITION BY j.object_id) AS n
    FROM collection_jobs j JOIN collection_rows i ON i.owner = j.collection_owner)"""


@query("fan_out_collection", f"""WITH {FAN_OUT}
SELECT job_id, item_id, seq, n, lang FROM fan_out""")
def _(t: Tables):
    rows = fan_out_collection(t.collection_jobs, exclude_jobs(t.collection_items))
    return rows.select(F.col("object_id").alias("job_id"), "item_id", "seq", "n", F.col("item_lang").alias("lang"))


@query("fan_out_stream", f"""WITH {TYPE_STREAMS}, ranked AS (
    SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY timestamp, object_id) AS seq FROM type_streams)
SELECT 'h1/ops/job.s-' || event_type AS job_id, object_id, timestamp, seq,
       count(*) OVER (PARTITION BY stream_id) AS n
FROM ranked""")
def _(t: Tables):
    rows = fan_out_stream(t.stream_jobs, t.type_streams)
    return rows.select(
        F.col("object_id").alias("job_id"), F.col("item_object_id").alias("object_id"),
        F.col("item_timestamp").alias("timestamp"), "seq", "n",
    )


@query("fan_out_files", """
SELECT 'h1/ops/job.f-' || (page_id // 100) AS job_id,
       row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) AS seq,
       url AS key, string_split(url, '/')[-1] AS filename, 'in/' AS prefix
FROM pages""")
def _(t: Tables):
    return fan_out_files(t.file_jobs).select(F.col("object_id").alias("job_id"), "seq", "key", "filename", "prefix")


@query("update_back", f"""WITH {COLLECTION_ITEMS}, collection_rows AS (
    SELECT *, CASE WHEN doc_id % 40 = 1 THEN 'unknown' ELSE coalesce(pk, object_id) END AS item_id
    FROM collection_items WHERE NOT contains(coalesce(pk, ''), '/job.'))
SELECT i.item_id, i.lang,
       CASE WHEN l.doc_id IS NULL OR i.doc_id % 2 = 1 THEN 'old' ELSE CAST(l.quality AS VARCHAR) END AS score,
       CASE WHEN l.doc_id IS NOT NULL AND i.doc_id % 5 <> 0 THEN CAST(l.toxic AS VARCHAR) END AS flag,
       l.doc_id IS NOT NULL AND (i.doc_id % 2 = 0 OR i.doc_id % 5 <> 0) AS updated
FROM collection_rows i LEFT JOIN labels l ON l.doc_id = i.doc_id AND i.item_id <> 'unknown'""")
def _(t: Tables):
    # some items have neither pk nor object_id; nothing may be written to those
    doc = F.col("doc_id")
    rows = exclude_jobs(t.collection_items).withColumn("object_id", F.when(doc % 40 != 1, F.col("object_id")))
    items = with_item_id(rows).withColumn(
        "fields", fields_of({"lang": F.col("lang"), "score": F.lit("old")})
    )
    labels = t.read("labels").select("doc_id", "quality", "toxic")
    mappings = F.array(
        F.struct(F.lit("q").alias("source"), F.lit("score").alias("target")),
        F.struct(F.lit("t").alias("source"), F.lit("flag").alias("target")),
    ).cast(MAPPINGS)
    results = items.join(labels, "doc_id").select(
        "item_id",
        overlay(
            only_if(doc % 2 == 0, {"q": F.col("quality")}), only_if(doc % 5 != 0, {"t": F.col("toxic")})
        ).alias("outputs"),
        mappings.alias("mappings"),
        F.lit(1).alias("completed_at"),
    )
    done = update_back(items, results)
    field = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    return done.select(
        "item_id", field("lang").alias("lang"), field("score").alias("score"), field("flag").alias("flag"), "updated"
    )


@query("derive_mappings", """
SELECT 's' || c_custkey AS object_id, 'Output' AS source,
       CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Label' END AS target
FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT 's' || c_custkey, 'Resp', 'n' || c_nationkey FROM customer WHERE c_custkey % 3 > 0""")
def _(t: Tables):
    key = F.col("c_custkey")

    def node(name, kind):
        return F.struct(F.lit(name).alias("unique_id"), kind.alias("ntype"), F.lit("").alias("action_id"))

    def link(source, target, into):
        return F.struct(
            F.lit("a").alias("source"), source.alias("sourceHandle"),
            F.lit(into).alias("target"), target.alias("targetHandle"),
        )

    update = F.when(key % 3 > 0, F.lit("UPDATE_VALUES")).otherwise(F.lit("OUTPUT"))
    scripts = t.read("customer").select(
        text("s", key).alias("object_id"),
        F.array(node("a", F.lit("ACTION")), node("u", update), node("v", update)).alias("nodes"),
        F.array(
            link(F.lit("Output"), F.lit("Label"), "u"),
            link(F.lit("Output"), F.lit("Other"), "v"),
            link(F.lit("Output"), F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("")), "u"),
            link(F.lit(""), F.lit("Nothing"), "u"),
            link(F.lit("Resp"), text("n", F.col("c_nationkey")), "u"),
        ).alias("links"),
    )
    return derive_mappings(scripts)


@query("match_groups", """
WITH users AS (
    SELECT c_custkey AS user_id, 'c' || c_custkey || '@' || lower(c_mktsegment) || '.example.com' AS email
    FROM customer),
user_groups AS (
    SELECT 'g_even' AS group_id, '[02468]@' AS pattern, '@' AS has UNION ALL SELECT 'g_auto', '@automobile', '@'
    UNION ALL SELECT 'g_n' || n_nationkey, '^c' || n_nationkey || '[0-9]*@', 'c' || n_nationkey
    FROM nation WHERE n_regionkey <> 2
    UNION ALL SELECT 'g_s' || s_suppkey, '^c[0-9]+' || (s_suppkey % 900 + 100) || '@(?:auto|machi)',
           (s_suppkey % 900 + 100) || '@' FROM supplier
    UNION ALL SELECT 'g_d' || doc_id, '(c' || doc_id || '@|u' || doc_id || '@)[a-z]+[.]example', doc_id || '@'
    FROM documents)
SELECT user_id, group_id FROM users JOIN user_groups
ON CASE WHEN contains(email, has) THEN regexp_matches(email, pattern) ELSE FALSE END""")
def _(t: Tables):
    """A rule per document and per supplier (11,000 at scale 0.1): for one user, for some, for
    many, and some without any letters to look them up by."""
    users = t.read("customer").select(
        F.col("c_custkey").alias("user_id"),
        text("c", F.col("c_custkey"), "@", F.lower("c_mktsegment"), ".example.com").alias("email"),
    )
    rule = lambda df, name, pattern: df.select(
        name.alias("group_id"), pattern.alias("email_regex_match"), F.lit(True).alias("add_to_user_on_signup")
    )
    supplier, doc = F.col("s_suppkey"), F.col("doc_id")
    groups = t.read("nation").select(
        text("g_n", F.col("n_nationkey")).alias("group_id"),
        text("^c", F.col("n_nationkey"), "[0-9]*@").alias("email_regex_match"),
        (F.col("n_regionkey") != 2).alias("add_to_user_on_signup"),
    )
    fixed = t.values(
        "group_id, email_regex_match, add_to_user_on_signup",
        ("g_even", "[02468]@", True), ("g_auto", "@automobile", True), ("g_off", ".*", False),
    )
    for more in (
        fixed,
        rule(t.read("supplier"), text("g_s", supplier), text("^c[0-9]+", supplier % 900 + 100, "@(?:auto|machi)")),
        rule(t.read("documents"), text("g_d", doc), text("(c", doc, "@|u", doc, "@)[a-z]+[.]example")),
    ):
        groups = groups.unionByName(more)
    return match_groups(users, groups)
