from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowloom.functions.clean import strip_buffers
from rowloom.functions.ids import (
    collection_item_id, file_name, job_uuid, receipt_stream_id, split_path, stream_item_id,
)
from rowloom.functions.inputs import (
    bind_inputs, expand_template, fields_of, fill_defaults, inject_context, map_params, overlay,
    project_params,
)
from rowloom.functions.text import (
    clamp, dest_key, empty_to_null, epoch_millis, epoch_seconds, mask_secret, narrow_decimal,
    normalize_url,
)
from rowloom.functions.values import encode_value, flatten_outputs
from rowloom.plans.catalog.registry import COLLECTION_ITEMS, MS, Tables, query, text
from rowloom.schemas import FIELDS


def only_if(condition: Column, values: dict[str, Column]) -> Column:
    """Fields that are present only where the condition holds."""
    return F.when(condition, fields_of(values)).otherwise(F.create_map().cast(FIELDS))


def got(inputs: Column, name: str) -> Column:
    return F.try_element_at(inputs, F.lit(name))


@query("bind_inputs", """
SELECT doc_id, lang,
       CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars AS VARCHAR) ELSE '0' END AS n_chars,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'const' END AS note,
       'plain' AS tone, 'd' || doc_id AS bound_id, 5 AS n_keys
FROM documents""")
def _(t: Tables):
    doc = F.col("doc_id")
    constants = fields_of({
        "lang": F.lit("xx"), "n_chars": F.lit(0), "note": F.lit("const"), "tone": F.lit("plain"),
        "object_id": F.lit("const"),
    })
    item = overlay(
        fields_of({"lang": F.col("lang")}),
        only_if(doc % 3 != 0, {"n_chars": F.col("n_chars")}),
        only_if(doc % 5 == 0, {"note": F.lit(None)}),
    )
    bound = bind_inputs(constants, item, {"object_id": text("d", doc)})
    rows = t.read("documents").select("doc_id", bound.alias("i"))
    inputs = F.col("i")
    return rows.select(
        "doc_id", got(inputs, "lang").alias("lang"), got(inputs, "n_chars").alias("n_chars"),
        got(inputs, "note").alias("note"), got(inputs, "tone").alias("tone"),
        got(inputs, "object_id").alias("bound_id"), F.size(inputs).alias("n_keys"),
    )


@query("project_params", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'value' WHEN 'view' THEN 'event_type,value'
                 ELSE 'event_type,props,value' END AS kept
FROM events""")
def _(t: Tables):
    kind = F.col("event_type")
    inputs = fields_of({name: F.col(name) for name in ("value", "props", "event_type")})
    params = F.when(kind == "click", F.array(F.lit("value"))).otherwise(F.array(F.lit("value"), F.lit("event_type")))
    kept = project_params(inputs, params, ~kind.isin("click", "view"))
    return t.read("events").select(
        "event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept")
    )


@query("inject_context", """
SELECT c_custkey,
       CASE WHEN c_custkey % 3 <> 2 AND c_custkey % 4 <> 0 THEN 'host' || c_nationkey END AS hostname,
       CASE WHEN c_custkey % 5 = 0 THEN 'own' WHEN c_custkey % 3 <> 1 THEN 'user' || c_custkey END AS username,
       1 + CAST(c_custkey % 3 <> 2 AND c_custkey % 4 <> 0 AS INTEGER)
         + CAST(c_custkey % 5 = 0 OR c_custkey % 3 <> 1 AS INTEGER) AS n_keys
FROM customer""")
def _(t: Tables):
    key = F.col("c_custkey")
    both = F.array(F.lit("hostname"), F.lit("username"))
    params = (
        F.when(key % 3 == 0, both)
        .when(key % 3 == 1, F.array(F.lit("hostname")))
        .otherwise(F.array(F.lit("username")))
    )
    given = overlay(fields_of({"segment": F.col("c_mktsegment")}), only_if(key % 5 == 0, {"username": F.lit("own")}))
    host = F.when(key % 4 == 0, F.lit("")).otherwise(text("host", F.col("c_nationkey")))
    rows = t.read("customer").select(
        "c_custkey", inject_context(given, params, host, text("user", key)).alias("i")
    )
    inputs = F.col("i")
    return rows.select(
        "c_custkey", got(inputs, "hostname").alias("hostname"), got(inputs, "username").alias("username"),
        F.size(inputs).alias("n_keys"),
    )


@query("map_params", """
SELECT event_id, value AS amount, 'event' AS kind,
       CASE WHEN event_id % 2 = 0 THEN props ELSE event_type END AS note, 3 AS n_keys
FROM events""")
def _(t: Tables):
    data = overlay(
        fields_of({"value": F.col("value"), "event_type": F.col("event_type")}),
        only_if(F.col("event_id") % 2 == 0, {"props": F.col("props")}),
    )
    mapping = [
        {"src": "value", "dest": "amount"},
        {"dest": "kind", "static": "event"},
        {"src": "event_type", "dest": "note"},
        {"src": "props", "dest": "note"},
        {"src": "absent", "dest": "nothing"},
    ]
    rows = t.read("events").select("event_id", map_params(data, mapping).alias("m"))
    mapped = F.col("m")
    return rows.select(
        "event_id", got(mapped, "amount").cast("double").alias("amount"), got(mapped, "kind").alias("kind"),
        got(mapped, "note").alias("note"), F.size(mapped).alias("n_keys"),
    )


DEST_DEFAULT = "{hostname}/{username}/screenshots/"


@query("fill_defaults", f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id ELSE 1200 END AS width,
       CASE WHEN page_id % 3 <> 0 THEN page_id + 1 ELSE 800 END AS height,
       CASE WHEN page_id % 5 = 0 THEN '' ELSE '{DEST_DEFAULT}' END AS dest_prefix
FROM pages""")
def _(t: Tables):
    page = F.col("page_id")
    given = overlay(
        only_if(page % 2 == 0, {"width": page}),
        fields_of({"height": F.when(page % 3 != 0, page + 1)}),
        only_if(page % 5 == 0, {"dest_prefix": F.lit("")}),
    )
    filled = fill_defaults(given, {"width": 1200, "height": 800, "dest_prefix": DEST_DEFAULT})
    rows = t.read("pages").select("page_id", filled.alias("i"))
    inputs = F.col("i")
    return rows.select(
        "page_id", got(inputs, "width").cast("bigint").alias("width"),
        got(inputs, "height").cast("bigint").alias("height"), got(inputs, "dest_prefix").alias("dest_prefix"),
    )


@query("job_uuid", """
WITH ids AS (
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'h1/ops/job.' || o_orderkey WHEN 1 THEN 'job.' || o_orderkey
           WHEN 2 THEN CAST(o_orderkey AS VARCHAR) ELSE 'xjob.1/job.2.job.' || o_orderkey END AS job_id
    FROM orders)
SELECT o_orderkey, job_id, CASE WHEN contains(job_id, '/job.') THEN string_split(job_id, '/job.')[-1]
       WHEN contains(job_id, 'job.') THEN string_split(job_id, 'job.')[-1] ELSE job_id END AS uuid
FROM ids""")
def _(t: Tables):
    key = F.col("o_orderkey")
    job_id = (
        F.when(key % 4 == 0, text("h1/ops/job.", key))
        .when(key % 4 == 1, text("job.", key))
        .when(key % 4 == 2, key.cast("string"))
        .otherwise(text("xjob.1/job.2.job.", key))
    )
    rows = t.read("orders").select("o_orderkey", job_id.alias("job_id"))
    return rows.withColumn("uuid", job_uuid(F.col("job_id")))


@query("split_path", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'h' || c_nationkey WHEN 1 THEN 'h2' END AS hostname,
       CASE WHEN c_custkey % 3 < 2 THEN 'u' || c_custkey END AS username, c_custkey % 3 < 2 AS valid
FROM customer""")
def _(t: Tables):
    key = F.col("c_custkey")
    path = (
        F.when(key % 3 == 0, text("h", F.col("c_nationkey"), "/u", key, "/script.", key))
        .when(key % 3 == 1, text("h2/u", key))
        .otherwise(text("solo", key))
    )
    rows = t.read("customer").select("c_custkey", split_path(path).alias("p"))
    return rows.select("c_custkey", "p.hostname", "p.username", "p.valid")


@query("file_name", "SELECT page_id, string_split(url, '/')[-1] AS filename FROM pages")
def _(t: Tables):
    return t.read("pages").select("page_id", file_name(F.col("url")).alias("filename"))


@query("receipt_stream_id", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'None' ELSE 'host' || c_nationkey END
       || '/u' || c_custkey || '/stream-run-all.' || c_custkey AS stream_id
FROM customer""")
def _(t: Tables):
    key = F.col("c_custkey")
    host = F.when(key % 5 != 0, text("host", F.col("c_nationkey")))
    return t.read("customer").select(
        "c_custkey", receipt_stream_id(host, text("u", key), text("h/u/job.", key)).alias("stream_id")
    )


@query("item_id", f"""WITH {COLLECTION_ITEMS}
SELECT doc_id AS row_id, 'item' AS kind, coalesce(pk, object_id, 'unknown') AS item_id FROM collection_items
UNION ALL
SELECT event_id, 'event', 'h1/u' || user_id || '/stream.' || event_type || '@'
       || CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE CAST({MS} AS VARCHAR) END
FROM events
UNION ALL SELECT page_id, 'file', url FROM pages""")
def _(t: Tables):
    at = F.when(F.col("event_id") % 9 != 0, F.col("timestamp"))
    items = t.collection_items.select(
        F.col("doc_id").alias("row_id"), F.lit("item").alias("kind"),
        collection_item_id(F.col("pk"), F.col("object_id")).alias("item_id"),
    )
    events = t.stream_items.select(
        F.col("event_id").alias("row_id"), F.lit("event").alias("kind"),
        stream_item_id(F.col("stream_id"), at).alias("item_id"),
    )
    files = t.read("pages").select(
        F.col("page_id").alias("row_id"), F.lit("file").alias("kind"), F.col("url").alias("item_id")
    )
    return items.unionByName(events).unionByName(files)


@query("narrow_decimal", """
WITH d AS (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE -o_totalprice END
                                   AS DECIMAL(18, 2)) AS d FROM orders)
SELECT o_orderkey, CASE WHEN d % 1 = 0 THEN CAST(d AS BIGINT) END AS ival,
       CASE WHEN d % 1 <> 0 THEN CAST(d AS DOUBLE) END AS dval
FROM d""")
def _(t: Tables):
    price = F.col("o_totalprice")
    value = F.when(F.col("o_orderkey") % 2 == 0, F.floor(price).cast("double")).otherwise(-price)
    rows = t.read("orders").select("o_orderkey", narrow_decimal(value.cast("decimal(18,2)")).alias("v"))
    return rows.select("o_orderkey", "v.ival", "v.dval")


@query("mask_secrets", """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'ACCESS_KEY' WHEN 1 THEN 'MY_SECRET_X' WHEN 2 THEN 'REGION'
                      ELSE 'monkey' END AS name,
       CASE WHEN turn % 4 > 1 THEN CASE WHEN conv_id % 5 = 3 THEN '' ELSE text END
            WHEN conv_id % 5 = 3 OR text = '' THEN NULL ELSE substring(text, 1, 4) || '...' END AS shown
FROM conversations""")
def _(t: Tables):
    turn = F.col("turn")
    name = (
        F.when(turn % 4 == 0, F.lit("ACCESS_KEY")).when(turn % 4 == 1, F.lit("MY_SECRET_X"))
        .when(turn % 4 == 2, F.lit("REGION")).otherwise(F.lit("monkey"))
    )
    value = F.when(F.col("conv_id") % 5 == 3, F.lit("")).otherwise(F.col("text"))
    rows = t.read("conversations").select("conv_id", "turn", name.alias("name"), value.alias("value"))
    return rows.select("conv_id", "turn", "name", mask_secret(F.col("name"), F.col("value")).alias("shown"))


@query("strip_buffers", """
SELECT c_custkey, CASE c_custkey % 4
    WHEN 0 THEN '{"name":"' || c_name || '","raw":null,"kept":[null,' || c_custkey || ']}'
    WHEN 1 THEN '{"value":{"ptype":' || c_nationkey || '}}'
    WHEN 2 THEN '{"byval":"' || c_mktsegment || '","x":{"type":"Buffer"}}'
    END AS cleaned
FROM customer""")
def _(t: Tables):
    key, buffer = F.col("c_custkey"), '{"type": "Buffer", "data": [1, 2]}'
    raw = (
        F.when(key % 4 == 0, text('{"name": "', F.col("c_name"), f'", "raw": {buffer}, "kept": [{buffer}, ', key, "]}"))
        .when(key % 4 == 1, text('{"value": {"ptype": ', F.col("c_nationkey"), f', "byval": {buffer}}}}}'))
        .when(key % 4 == 2, text('{"byval": "', F.col("c_mktsegment"), '", "x": {"type": "Buffer"}}'))
        .otherwise(text("{not json ", key))
    )
    return t.read("customer").select("c_custkey", strip_buffers(raw).alias("cleaned"))


@query("encode_value", """
SELECT event_id, 'FLOAT' AS value_tag, value AS value_dval, CAST(NULL AS VARCHAR) AS value_sval,
       'STRING' AS kind_tag, event_type AS kind_sval, 'INTEGER' AS user_tag, user_id AS user_ival,
       'LIST' AS list_tag, event_type || ',' || user_id AS list_svals
FROM events""")
def _(t: Tables):
    kinds = F.array(F.col("event_type"), F.col("user_id").cast("string"))
    rows = t.read("events").select(
        "event_id",
        encode_value(F.col("value"), "FLOAT").alias("v"),
        encode_value(F.col("event_type"), "STRING").alias("k"),
        encode_value(F.col("user_id"), "INTEGER").alias("u"),
        encode_value(kinds, "LIST").alias("l"),
    )
    return rows.select(
        "event_id", F.col("v.ptype").alias("value_tag"), F.col("v.dval").alias("value_dval"),
        F.col("v.sval").alias("value_sval"), F.col("k.ptype").alias("kind_tag"),
        F.col("k.sval").alias("kind_sval"), F.col("u.ptype").alias("user_tag"),
        F.col("u.ival").alias("user_ival"), F.col("l.ptype").alias("list_tag"),
        F.array_join("l.svals", ",").alias("list_svals"),
    )


@query("decode_value", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       value AS amount, CASE WHEN event_id % 3 = 0 THEN value >= 50 END AS high,
       CAST(json_extract(props, '$.k') AS BIGINT) AS nested_k
FROM events""")
def _(t: Tables):
    k = F.get_json_object("props", "$.k")
    number = F.when(F.col("event_id") % 2 == 0, encode_value(k.cast("bigint"), "INTEGER")).otherwise(
        encode_value(k, "STRING")
    )
    high = F.when(F.col("event_id") % 3 == 0, encode_value(F.col("value") >= 50, "BOOLEAN"))
    props = encode_value(F.from_json("props", "k bigint"), "JSON")
    outputs = F.create_map(
        F.lit("k"), number, F.lit("amount"), encode_value(F.col("value"), "FLOAT"),
        F.lit("high"), high, F.lit("props"), props,
    )
    rows = t.read("events").select("event_id", outputs.alias("outputs"))
    flat = rows.select(
        "event_id",
        *flatten_outputs(F.col("outputs"), {"k": "INTEGER", "amount": "FLOAT", "high": "BOOLEAN", "props": "JSON"}),
    )
    return flat.select(
        "event_id", "k", "amount", "high", F.try_variant_get("props", "$.k", "bigint").alias("nested_k")
    )


URL_CASES = """CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN upper(url)
    WHEN 2 THEN string_split(url, '://')[2] ELSE 'http|' || string_split(url, '://')[2] END"""


def url_cases() -> Column:
    page, url = F.col("page_id"), F.col("url")
    bare = F.substring_index(url, "://", -1)
    return (
        F.when(page % 4 == 0, url).when(page % 4 == 1, F.upper(url)).when(page % 4 == 2, bare)
        .otherwise(text("http|", bare))
    )


@query("normalize_url", f"""
WITH u AS (SELECT page_id, {URL_CASES} AS url FROM pages)
SELECT page_id, url, CASE WHEN regexp_matches(url, '^http[:|/]') THEN 'https://' || string_split(url, '/')[-1]
       WHEN url NOT LIKE 'https%' THEN 'https://' || url ELSE url END AS normal
FROM u""")
def _(t: Tables):
    rows = t.read("pages").select("page_id", url_cases().alias("url"))
    return rows.withColumn("normal", normalize_url(F.col("url")))


@query("dest_key", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'h/u/shots/' ELSE 'h/u/p' || page_id || '/' END
       || strftime(TIMESTAMP '2024-05-06 07:08:09' + to_seconds(page_id * 977), '%Y-%m-%d-at-%H-%M-%S')
       || '-' || substring(sha256(CAST(page_id AS VARCHAR)), 1, 4) || '.png' AS dest
FROM pages""")
def _(t: Tables):
    page = F.col("page_id")
    prefix = F.when(page % 2 == 0, F.lit("h/u/shots/")).otherwise(text("h/u/p", page))
    at = F.timestamp_seconds(F.lit(1_714_979_289) + page * 977)
    return t.read("pages").select("page_id", dest_key(prefix, at, page.cast("string")).alias("dest"))


@query("expand_template", """
SELECT c_custkey, 'h' || c_nationkey || '/' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END
       || '/screenshots/h' || c_nationkey AS folder
FROM customer""")
def _(t: Tables):
    user = F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))
    template = F.lit(DEST_DEFAULT + "{hostname}")
    return t.read("customer").select(
        "c_custkey", expand_template(template, hostname=text("h", F.col("c_nationkey")), username=user).alias("folder")
    )


@query("clamp", """
SELECT event_id, CASE WHEN value * 100 - 2000 < 0 THEN 0.0 WHEN value * 100 - 2000 > 3600 THEN 3600.0
                 ELSE value * 100 - 2000 END AS seconds
FROM events""")
def _(t: Tables):
    return t.read("events").select("event_id", clamp(F.col("value") * 100 - 2000, 0.0, 3600.0).alias("seconds"))


@query("empty_to_null", """
SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN role END AS message FROM conversations""")
def _(t: Tables):
    message = F.when(F.col("turn") % 2 == 1, F.col("role")).otherwise(F.lit(""))
    return t.read("conversations").select("conv_id", "turn", empty_to_null(message).alias("message"))


@query("epoch_units", f"""
SELECT event_id, epoch_us(ts) // 1000000 AS seconds, {MS} AS millis FROM events""")
def _(t: Tables):
    at = F.col("ts")
    return t.read("events").select(
        "event_id", epoch_seconds(at).alias("seconds"), epoch_millis(at).alias("millis")
    )
