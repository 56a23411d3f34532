from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions.inputs import fields_of, overlay, truthy_fallback
from rowloom.functions.validate import (
    EMAIL_PATTERN, URL_PATTERN, is_active, is_member, is_present, match_glob, missing_required,
    not_members, violations,
)
from rowloom.operators.jobs import resolve_jobs, split_cancelled, validate_jobs
from rowloom.plans.catalog.q_scalars import only_if
from rowloom.plans.catalog.registry import Tables, query, text

MODES = ("RUN_ACTION", "RUN_JOB", "RUN_STREAM", "REGISTER_ACTIONS", "OTHER", "")


@query("missing_required", """
WITH r AS (SELECT c_custkey AS k, (['RUN_ACTION', 'RUN_JOB', 'RUN_STREAM', 'REGISTER_ACTIONS', 'OTHER', ''])
                                  [c_custkey % 6 + 1] AS mode FROM customer)
SELECT k AS c_custkey, mode, concat_ws(',',
    CASE WHEN mode = '' THEN 'RUN_MODE' END,
    CASE WHEN k % 2 = 0 THEN 'DYNAMO_TABLE' END,
    CASE WHEN k % 7 = 0 AND mode IN ('RUN_ACTION', 'RUN_JOB', 'RUN_STREAM') THEN 'JOB_ID' END,
    CASE WHEN k % 5 = 0 AND mode IN ('RUN_ACTION', 'RUN_JOB', 'RUN_STREAM') THEN 'USERNAME' END,
    CASE WHEN k % 11 = 0 AND mode = 'RUN_ACTION' THEN 'ACTION_ID' END) AS missing
FROM r""")
def _(t: Tables):
    key = F.col("c_custkey")
    mode = F.get(F.array(*[F.lit(m) for m in MODES]), (key % len(MODES)).cast("int"))
    record = overlay(
        fields_of({"DYNAMO_STREAMS_TABLE": F.lit("s"), "PRIMARY_BUCKET": F.lit("b"), "RUN_MODE": F.col("mode")}),
        fields_of({"DYNAMO_TABLE": F.when(key % 2 == 0, F.lit("")).otherwise(F.lit("t"))}),
        fields_of({"USERNAME": F.when(key % 5 != 0, F.col("c_name"))}),
        only_if(key % 7 != 0, {"JOB_ID": key}),
        fields_of({"ACTION_ID": F.when(key % 11 == 0, F.lit("")).otherwise(F.lit("a"))}),
    )
    rows = t.read("customer").withColumn("mode", mode)
    return rows.select(
        "c_custkey", "mode", F.array_join(missing_required(record, F.col("mode")), ",").alias("missing")
    )


JOB_SHAPES = """jobs AS (
    SELECT 'h/u/job.' || o_orderkey AS object_id,
           CASE o_orderkey % 6 WHEN 0 THEN 'run_on_collection' WHEN 1 THEN 'run_on_stream' WHEN 2 THEN 'run_on_files'
                WHEN 3 THEN 'singleton' WHEN 4 THEN 'unheard_of' END AS job_type,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE 'c' || o_custkey END
               AS collection_owner,
           CASE WHEN o_orderkey % 9 = 1 THEN '' ELSE 's' || o_custkey END AS stream_id,
           o_orderkey % 8 AS shape, o_orderkey, o_orderstatus AS status
    FROM orders)"""


def job_shapes(t: Tables):
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    kinds = ("run_on_collection", "run_on_stream", "run_on_files", "singleton", "unheard_of")
    kind = F.lit(None).cast("string")
    for at, name in enumerate(kinds):
        kind = F.when(key % 6 == at, F.lit(name)).otherwise(kind)
    return t.read("orders").select(
        text("h/u/job.", key).alias("object_id"),
        kind.alias("job_type"),
        F.when(key % 4 == 1, F.lit("")).when(key % 4 > 1, text("c", who)).alias("collection_owner"),
        F.when(key % 9 == 1, F.lit("")).otherwise(text("s", who)).alias("stream_id"),
        F.when(key % 8 == 2, F.array().cast("array<string>"))
        .when(key % 8 != 0, F.array(text("f", key))).alias("file_keys"),
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
    )


@query("validate_jobs", f"""WITH {JOB_SHAPES}
SELECT object_id, status, CASE
    WHEN job_type = 'run_on_collection' AND coalesce(collection_owner, '') = ''
        THEN 'collection_owner is required for run_on_collection'
    WHEN job_type = 'run_on_stream' AND stream_id = '' THEN 'stream_id is required for run_on_stream'
    WHEN job_type = 'run_on_files' AND shape IN (0, 2) THEN 'file_keys is required for run_on_files'
    END AS reject_reason
FROM jobs""")
def _(t: Tables):
    return validate_jobs(job_shapes(t)).select("object_id", "status", "reject_reason")


@query("resolve_jobs", f"""WITH {JOB_SHAPES}
SELECT object_id, coalesce(job_type, 'singleton') AS declared_type,
       CASE WHEN o_orderkey % 6 < 3 THEN job_type ELSE 'singleton' END AS job_type,
       CASE WHEN coalesce(collection_owner, '') = '' THEN 'fallback' ELSE collection_owner END AS collection_owner
FROM jobs""")
def _(t: Tables):
    resolved = resolve_jobs(job_shapes(t), collection_owner="fallback")
    return resolved.select("object_id", "declared_type", "job_type", "collection_owner")


@query("split_cancelled", """
SELECT 'h/u/job.' || o_orderkey AS object_id,
       CASE WHEN o_orderkey % 7 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS status,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Job was cancelled by user' END AS error_message,
       o_custkey AS success_count
FROM orders""")
def _(t: Tables):
    key = F.col("o_orderkey")
    jobs = t.read("orders").select(
        text("h/u/job.", key).alias("object_id"),
        F.when(key % 7 == 0, F.lit(True)).when(key % 2 == 0, F.lit(False)).alias("request_cancel"),
        F.lit("RUNNING").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.col("o_custkey").alias("success_count"),
    )
    going, cancelled = split_cancelled(jobs)
    return going.unionByName(cancelled).drop("request_cancel")


@query("check_rules", f"""
WITH p AS (SELECT page_id, url, page_id * 17 % 2000 AS width,
                  CASE WHEN page_id % 3 = 0 THEN 'p' || page_id ELSE 'p' || page_id || '@x.org' END AS email FROM pages)
SELECT page_id, concat_ws(',',
    CASE WHEN NOT regexp_matches(url, '{URL_PATTERN}') THEN 'url:VALID_URL' END,
    CASE WHEN NOT starts_with(url, 'https') THEN 'url:STARTS_WITH' END,
    CASE WHEN NOT (ends_with(url, '1') OR ends_with(url, '#top')) THEN 'url:ends in 1 or #top' END,
    CASE WHEN length(url) < 36 THEN 'url:MIN_LENGTH' END,
    CASE WHEN length(url) > 45 THEN 'url:MAX_LENGTH' END,
    CASE WHEN width <= 50 THEN 'width:GREATER_THAN' END,
    CASE WHEN width >= 1920 THEN 'width:LESS_THAN' END,
    CASE WHEN width < 102 THEN 'width:GREATER_THAN_OR_EQUAL' END,
    CASE WHEN width > 1802 THEN 'width:LESS_THAN_OR_EQUAL' END,
    CASE WHEN NOT regexp_matches(email, '{EMAIL_PATTERN}') THEN 'email:EMAIL' END) AS failed
FROM p""")
def _(t: Tables):
    page, url, width, email = F.col("page_id"), F.col("url"), F.col("width"), F.col("email")
    rows = t.read("pages").select(
        "page_id", "url", (page * 17 % 2000).alias("width"),
        F.when(page % 3 == 0, text("p", page)).otherwise(text("p", page, "@x.org")).alias("email"),
    )
    checks = [
        ("url", url, {"rule": "VALID_URL"}),
        ("url", url, {"rule": "STARTS_WITH", "svals": ["https"]}),
        ("url", url, {"rule": "ENDS_WITH", "svals": ["1", "#top"], "error_message": "ends in 1 or #top"}),
        ("url", url, {"rule": "MIN_LENGTH", "ival": 36}),
        ("url", url, {"rule": "MAX_LENGTH", "ival": 45}),
        ("width", width, {"rule": "GREATER_THAN", "ival": 50}),
        ("width", width, {"rule": "LESS_THAN", "ival": 1920}),
        ("width", width, {"rule": "GREATER_THAN_OR_EQUAL", "dval": 102.0}),
        ("width", width, {"rule": "LESS_THAN_OR_EQUAL", "ival": 1802}),
        ("email", email, {"rule": "EMAIL"}),
    ]
    named = F.transform(
        violations(checks),
        lambda v: F.concat(
            v["name"], F.lit(":"), F.when(v["message"].contains("#top"), v["message"]).otherwise(v["rule"])
        ),
    )
    return rows.select("page_id", F.array_join(named, ",").alias("failed"))


@query("check_membership", """
SELECT c_custkey, c_mktsegment IN ('MACHINERY', 'FURNITURE') AS single_ok,
       concat_ws(',', CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') THEN c_mktsegment END,
                 CASE WHEN c_nationkey <> 3 THEN 'N' || c_nationkey END) AS not_allowed
FROM customer""")
def _(t: Tables):
    allowed = ["MACHINERY", "FURNITURE"]
    chosen = F.array(F.col("c_mktsegment"), text("N", F.col("c_nationkey")))
    return t.read("customer").select(
        "c_custkey", is_member(F.col("c_mktsegment"), allowed).alias("single_ok"),
        F.array_join(not_members(chosen, [*allowed, "N3"]), ",").alias("not_allowed"),
    )


@query("check_presence", """
SELECT event_id, event_id % 3 <> 0 OR event_id % 2 = 0 AS ok FROM events""")
def _(t: Tables):
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return t.read("events").select("event_id", is_present(value, F.col("event_id") % 2 == 0).alias("ok"))


@query("check_conditionals", """
SELECT event_id, event_type = 'click' AND user_id % 4 = 1 AS all_hold,
       event_type = 'click' OR user_id % 4 = 1 AS any_holds
FROM events""")
def _(t: Tables):
    inputs = {"kind": F.col("event_type"), "shard": F.col("user_id") % 4}
    wanted = {"kind": "click", "shard": 1}
    return t.read("events").select(
        "event_id", is_active(inputs, wanted, True).alias("all_hold"), is_active(inputs, wanted, False).alias("any_holds")
    )


@query("match_glob", """
SELECT page_id, url FROM pages
WHERE url GLOB 'https://*.example.???/en/*' OR url GLOB '*.net/[!e]?/*[0-4]'""")
def _(t: Tables):
    hit = match_glob(F.col("url"), "https://*.example.???/en/*", "*.net/[!e]?/*[0-4]")
    return t.read("pages").filter(hit).select("page_id", "url")


@query("truthy_fallback", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN conv_id % 2 = 0 THEN 'second' ELSE '' END AS chosen
FROM conversations""")
def _(t: Tables):
    turn = F.col("turn")
    first = F.when(turn % 3 == 0, F.col("role")).when(turn % 3 == 1, F.lit(""))
    second = F.when(F.col("conv_id") % 2 == 0, F.lit("second"))
    return t.read("conversations").select("conv_id", "turn", truthy_fallback(first, second, F.lit("")).alias("chosen"))
