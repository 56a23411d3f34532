from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions.inputs import fields_of
from rowloom.operators.steps import (
    apply_param_types, step_bundle, step_coalesce, step_guard, step_io, step_receipt_meta, step_static,
    wait_for_register, wait_for_step,
)
from rowloom.plans.catalog.registry import RECEIPTS, Tables, query, text


@query("step_static", "SELECT event_id, 'fixed' AS label, 7 AS weight FROM events")
def _(t: Tables):
    return t.read("events").select("event_id").transform(step_static({"label": "fixed", "weight": 7}))


@query("step_io", "SELECT event_id, value, CAST(NULL AS VARCHAR) AS absent FROM events")
def _(t: Tables):
    return t.read("events").transform(step_io(["event_id", "value", "absent"]))


@query("step_coalesce", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN props END AS first_value
FROM events""")
def _(t: Tables):
    key = F.col("event_id")
    rows = t.read("events").select(
        "event_id", F.when(key % 2 == 0, F.col("event_type")).alias("a"), F.when(key % 3 == 0, F.col("props")).alias("b")
    )
    return rows.transform(step_coalesce("first_value", "a", "b")).drop("a", "b")


@query("step_bundle", "SELECT event_id, user_id AS b_user, value AS b_value FROM events")
def _(t: Tables):
    rows = t.read("events").transform(step_bundle("bundle", "user_id", "value"))
    return rows.select("event_id", F.col("bundle.user_id").alias("b_user"), F.col("bundle.value").alias("b_value"))


@query("step_receipt_meta", f"""WITH {RECEIPTS}
SELECT object_id, success, error_message, timestamp, cost FROM receipts""")
def _(t: Tables):
    fields = ("success", "error_message", "timestamp", "cost")
    nested = t.unnumbered_receipts.select("object_id", F.struct(*fields).alias("receipt"))
    return nested.transform(step_receipt_meta()).drop("receipt")


@query("step_guard", """
SELECT event_id, CASE WHEN user_id % 4 = 0 THEN value * 2 ELSE value END AS value,
       CASE WHEN user_id % 4 = 0 THEN 'x' || event_type END AS note
FROM events""")
def _(t: Tables):
    key = F.col("user_id")
    rows = t.read("events").withColumn("go", F.when(key % 4 == 0, True).when(key % 4 == 1, False))
    guarded = rows.transform(step_guard("go", {"value": F.col("value") * 2, "note": text("x", F.col("event_type"))}))
    return guarded.select("event_id", "value", "note")


@query("wait_gate", """
SELECT event_id, user_id % 3 <> 2 AND value >= 50 AS after_success,
       user_id % 3 <> 2 AND value < 50 AS after_failure, user_id % 3 <> 2 AS after_either,
       CASE WHEN event_type = 'error' THEN 'SKIP' WHEN event_type = 'click' THEN 'RUN' ELSE 'WAIT' END AS gate
FROM events""")
def _(t: Tables):
    # steps of every third user have no receipt yet
    success = F.when(F.col("user_id") % 3 != 2, F.col("value") >= 50)
    return t.read("events").select(
        "event_id",
        wait_for_step(success, True, False).alias("after_success"),
        wait_for_step(success, False, True).alias("after_failure"),
        wait_for_step(success, True, True).alias("after_either"),
        wait_for_register(F.col("event_type"), run_value="click", skip_value="error").alias("gate"),
    )


@query("apply_param_types", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'many' ELSE CAST(user_id AS VARCHAR) END AS count_text,
                  CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS amount_text,
                  CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'maybe' END AS flag_text, value FROM events)
SELECT event_id, TRY_CAST(count_text AS BIGINT) AS count, CASE WHEN event_id % 5 <> 0 THEN value END AS amount,
       CASE WHEN flag_text = 'true' THEN TRUE END AS flag,
       concat_ws(',', CASE WHEN event_id % 4 = 0 THEN 'count' END, CASE WHEN event_id % 5 = 0 THEN 'amount' END,
                 CASE WHEN event_id % 3 = 1 THEN 'flag' END) AS type_errors
FROM r""")
def _(t: Tables):
    key = F.col("event_id")
    inputs = fields_of({
        "count": F.when(key % 4 == 0, F.lit("many")).otherwise(F.col("user_id").cast("string")),
        "amount": F.when(key % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")),
        "flag": F.when(key % 3 == 0, F.lit("true")).when(key % 3 == 1, F.lit("maybe")),
    })
    rows = t.read("events").select("event_id", inputs.alias("inputs"))
    typed = apply_param_types(rows, {"count": "INTEGER", "amount": "FLOAT", "flag": "BOOLEAN"})
    return typed.withColumn("type_errors", F.array_join("type_errors", ",")).drop("inputs")
