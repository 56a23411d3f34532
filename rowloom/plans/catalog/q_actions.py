from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.inputs import fields_of
from rowloom.operators.actions import (
    Action, ActionFailed, Inputs, action_percent, build_receipts, count_actions, dispatch_actions, fail,
    run_action, single_action_result, succeed,
)
from rowloom.operators.outputs import shred, variant_outputs
from rowloom.operators.rollup import action_counts
from rowloom.plans.catalog.registry import MS, Tables, query, text
from rowloom.schemas import NODES


def _take(inputs: Column, name: str) -> Column:
    return F.try_element_at(inputs, F.lit(name))


def look_up_label(inputs: Inputs) -> Column:
    quality = inputs["quality"]
    return F.when(quality.isNull(), fail(F.lit("no label"))).otherwise(
        succeed({"quality": quality, "toxic": inputs["toxic"]}, primary="quality")
    )


LABEL = Action("label.lookup", ("quality", "toxic"), native=look_up_label, primary_output="quality")


def grade(value, user_id):
    amount = float(value)
    if amount < 20:
        raise ActionFailed(f"too low for user {user_id}")
    return {"grade": int(amount // 10)}


GRADE = Action("event.grade", ("value", "user_id"), python=grade, primary_output="grade")


def events_with_inputs(t: Tables) -> DataFrame:
    names = ("value", "user_id", "event_type")
    return t.stream_items.withColumn("inputs", fields_of({n: F.col(n) for n in names}))


@query("run_action", """
SELECT event_id, value >= 20 AS success,
       CASE WHEN value < 20 THEN 'too low for user ' || user_id END AS error_message,
       CASE WHEN value >= 20 THEN CAST(floor(value / 10) AS BIGINT) END AS grade
FROM events""")
def _(t: Tables):
    done = run_action(events_with_inputs(t), GRADE)
    return done.select(
        "event_id", "result.success", "result.error_message",
        F.try_element_at("result.outputs", F.lit("grade")).cast("bigint").alias("grade"),
    )


def _double(inputs: Inputs) -> Column:
    return succeed({"twice": inputs.number("value") * 2})


def _shadowed(_inputs: Inputs) -> Column:
    return fail(F.lit("the first registry should win"))


REGISTRIES = {
    "vendor": {
        "click": Action("click", ("value",), native=_double),
        "view": GRADE,
    },
    "builtin": {
        "click": Action("click", native=_shadowed),
        "purchase": Action("purchase", ("user_id",), native=lambda i: succeed({"who": i["user_id"]})),
        "signup": Action("signup", native=lambda _i: fail(F.lit(""))),
    },
}


SIZES = {"long": "BOOLEAN", "thousands": "FLOAT", "parts": "LIST", "raw": "BYTES"}
PLACES = {"place": "INTEGER", "ends": "VECTOR", "first": "BOOLEAN", "raw": "BYTES", "by": "STRING_MAP"}


def sizes(lang, n_chars):
    n = int(n_chars)
    thousands = "unknown" if n % 11 == 0 else n / 1000
    return {"long": n > 1000, "thousands": thousands, "parts": [lang, str(n % 3)], "raw": lang.encode()}


def places(inputs: Inputs) -> Column:
    at = inputs.number("n_chars")
    return succeed(
        {
            "place": F.when(at % 13 == 0, F.lit("none")).otherwise(at.cast("bigint").cast("string")),
            "ends": F.array(at / 2, at * 2),
            "first": at < 500,
            "raw": inputs["lang"].cast("binary"),
            "by": F.create_map(inputs["lang"], inputs["n_chars"]),
        },
        types={name: PLACES[name] for name in ("ends", "raw", "by")},
    )


TYPED = {
    "typed": {
        "doc.sizes": Action("doc.sizes", ("lang", "n_chars"), python=sizes, outputs=SIZES),
        "doc.places": Action("doc.places", ("lang", "n_chars"), native=places, outputs=PLACES),
    }
}


@query("typed_outputs", """
SELECT doc_id, action_id, CASE WHEN action_id = 'doc.sizes' THEN n_chars % 11 <> 0 ELSE n_chars % 13 <> 0 END AS success,
       CASE WHEN success THEN NULL WHEN action_id = 'doc.sizes' THEN 'Not of the declared type: thousands'
            ELSE 'Not of the declared type: place' END AS error_message,
       CASE WHEN success AND action_id = 'doc.sizes' THEN n_chars > 1000 END AS long,
       CASE WHEN success AND action_id = 'doc.sizes' THEN n_chars / 1000 END AS thousands,
       CASE WHEN success AND action_id = 'doc.sizes' THEN n_chars % 3 END AS second_part,
       CASE WHEN success AND action_id = 'doc.places' THEN n_chars END AS place,
       CASE WHEN success AND action_id = 'doc.places' THEN n_chars / 2 + n_chars * 2 END AS ends,
       CASE WHEN success AND action_id = 'doc.places' THEN n_chars < 500 END AS first,
       CASE WHEN success THEN octet_length(encode(lang)) END AS bytes,
       CASE WHEN success AND action_id = 'doc.places' THEN CAST(n_chars AS VARCHAR) END AS by_lang
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'doc.sizes' ELSE 'doc.places' END AS action_id FROM documents)""")
def _(t: Tables):
    """A Python and a native action in one pass; their outputs as VARIANT, then by type."""
    docs = t.read("documents").select(
        "doc_id", "lang",
        F.when(F.col("doc_id") % 2 == 0, "doc.sizes").otherwise("doc.places").alias("action_id"),
        fields_of({"lang": F.col("lang"), "n_chars": F.col("n_chars")}).alias("inputs"),
    )
    done = dispatch_actions(docs, TYPED)
    typed = variant_outputs(F.col("result.outputs"), F.col("action_id"), {"doc.sizes": SIZES, "doc.places": PLACES})
    rows = shred(done.withColumn("typed", typed), {**SIZES, **PLACES})
    return rows.select(
        "doc_id", "action_id", "result.success", "result.error_message", "long", "thousands",
        F.get("parts", F.lit(1)).cast("bigint").alias("second_part"), "place",
        F.aggregate("ends", F.lit(0.0), lambda a, b: a + b).alias("ends"), "first",
        F.octet_length("raw").cast("bigint").alias("bytes"), F.try_element_at("by", F.col("lang")).alias("by_lang"),
    )


@query("dispatch_actions", """
SELECT event_id, CASE event_type WHEN 'view' THEN value >= 20 ELSE event_type IN ('click', 'purchase') END AS success,
       CASE WHEN event_type = 'view' AND value < 20 THEN 'too low for user ' || user_id
            WHEN event_type = 'signup' THEN ''
            WHEN event_type = 'error' THEN 'Action not found: error. Searched: [''vendor'', ''builtin'']'
            END AS error_message,
       CASE event_type WHEN 'click' THEN value * 2 WHEN 'purchase' THEN CAST(user_id AS DOUBLE)
            WHEN 'view' THEN CASE WHEN value >= 20 THEN floor(value / 10) END END AS output
FROM events""")
def _(t: Tables):
    done = dispatch_actions(events_with_inputs(t), REGISTRIES, action_id="event_type")
    outputs = F.coalesce("result.outputs", F.create_map().cast("map<string,string>"))
    output = F.coalesce(*[_take(outputs, n) for n in ("twice", "who", "grade")]).cast("double")
    return done.select("event_id", "result.success", "result.error_message", output.alias("output"))


def native_results(t: Tables) -> DataFrame:
    """Events as items with a result: no outputs for user 3, an empty message for user 4."""
    good = F.col("value") >= 50
    user = F.col("user_id") % 5
    done = F.when(~good & (user == 4), fail(F.lit(""))).when(~good, fail(text("low ", F.col("user_id"))))
    done = done.when(user == 3, succeed()).otherwise(succeed({"value": F.col("value")}, "value", 0.5))
    return t.stream_items.withColumn("result", done)


@query("build_receipts", f"""
SELECT event_type AS job_id, CAST(event_id AS VARCHAR) AS object_id, value >= 50 AS success,
       CASE WHEN value < 50 AND user_id % 5 <> 4 THEN 'low ' || user_id END AS error_message,
       {MS} AS timestamp, CASE WHEN value >= 50 AND user_id % 5 <> 3 THEN value END AS output,
       CASE WHEN value >= 50 AND user_id % 5 <> 3 THEN CAST(0.5 AS DOUBLE) END AS cost
FROM events""")
def _(t: Tables):
    results = native_results(t).withColumnsRenamed({"event_type": "job_id", "object_id": "item_id"})
    receipts = build_receipts(results, F.col("timestamp"), keep=("job_id",))
    return receipts.withColumn("output", _take(F.col("outputs"), "value").cast("double")).drop("outputs")


@query("single_action_result", """
SELECT event_id AS job_id, CASE WHEN value >= 50 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
       CASE WHEN value < 50 THEN CASE WHEN user_id % 5 = 4 THEN '' ELSE 'low ' || user_id END END AS error_message,
       100 AS percent, epoch_us(ts) // 1000000 AS completed_at,
       value < 50 OR user_id % 5 <> 3 AS has_receipt,
       CASE WHEN value >= 50 AND user_id % 5 <> 3 THEN 'value' END AS primary_output,
       CASE WHEN value >= 50 AND user_id % 5 <> 3 THEN value END AS output
FROM events""")
def _(t: Tables):
    done = single_action_result(native_results(t), F.floor(F.col("timestamp") / 1000))
    return done.select(
        F.col("event_id").alias("job_id"), "status", "error_message", "percent", "completed_at",
        F.col("receipt").isNotNull().alias("has_receipt"), "receipt.primary_output",
        _take(F.col("receipt.outputs"), "value").cast("double").alias("output"),
    )


@query("action_counts", """
WITH calls AS (
    SELECT event_type AS job_id, value >= 50 AS ok FROM events
    UNION ALL SELECT event_type, value >= 20 FROM events)
SELECT job_id, count(*) FILTER (WHERE ok) AS action_success_count,
       count(*) FILTER (WHERE NOT ok) AS action_error_count
FROM calls GROUP BY job_id""")
def _(t: Tables):
    # every item makes two calls
    calls = t.read("events").select(
        F.col("event_type").alias("job_id"),
        F.explode(F.array(F.col("value") >= 50, F.col("value") >= 20)).alias("success"),
    )
    return action_counts(calls)


@query("count_actions", """
SELECT c_custkey, CAST(greatest((c_custkey % 7 + 1) // 2, 1) AS INTEGER) AS actions,
       CAST(floor(1.0::DOUBLE / greatest((c_custkey % 7 + 1) // 2, 1)::DOUBLE * 100) AS INTEGER) AS first_percent
FROM customer""")
def _(t: Tables):
    # a script of key % 7 nodes, every other one an action
    nodes = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(6)),
            lambda i: F.when(
                i < F.col("c_custkey") % 7,
                F.struct(
                    i.cast("string").alias("unique_id"),
                    F.when(i % 2 == 0, F.lit("ACTION")).otherwise(F.lit("STATIC")).alias("ntype"),
                    F.lit("").alias("action_id"),
                ),
            ),
        ),
        lambda n: n.isNotNull(),
    ).cast(NODES)
    scripts = t.read("customer").select("c_custkey", nodes.alias("nodes"))
    return scripts.select(
        "c_custkey", count_actions(F.col("nodes")).alias("actions"),
        action_percent(F.lit(1), F.col("nodes")).alias("first_percent"),
    )
