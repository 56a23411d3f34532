import pytest
from pyspark.sql import functions as F

from rowloom.operators.actions import (
    Action, build_receipts, dispatch_actions, fail, run_action, single_action_result, succeed,
)
from rowloom.operators.outputs import shred, variant_outputs
from rowloom.plans.run import run_jobs
from rowloom.schemas import RESULT
from rowloom.session import scratch_path
from rowloom.sinks.receipts import read_receipts

ROWS = "item_id string, action_id string, inputs map<string,string>"


def divide(a, b="1"):
    return {"q": int(a) // int(b), "nothing": None}


DIVIDE = Action("divide", ("a", "b"), python=divide, primary_output="q", cost=0.5)


def run(spark, rows):
    return {r["item_id"]: r["result"] for r in run_action(spark.createDataFrame(rows, ROWS), DIVIDE).collect()}


def test_python_errors_are_data(spark):
    got = run(spark, [
        ("ok", "", {"a": "7", "b": "2", "stranger": "1"}), ("zero", "", {"a": "7", "b": "0"}),
        ("absent", "", {"b": "1"}), ("null", "", None),
    ])
    assert got["ok"]["outputs"] == {"q": "3", "nothing": None} and got["ok"]["cost"] == 0.5
    assert got["zero"]["success"] is False and "by zero" in got["zero"]["error_message"]
    assert "missing 1 required" in got["absent"]["error_message"]
    assert "missing 1 required" in got["null"]["error_message"]


def test_context_reaches_actions_that_declare_it(spark):
    who = Action("who", ("hostname", "username"), python=lambda **given: given)
    df = spark.createDataFrame([("i", "", {"x": "1"})], ROWS)
    got = run_action(df, who, hostname=F.lit("h"), username=F.lit("u")).first()["result"]
    assert got["outputs"] == {"hostname": "h", "username": "u"}


def test_native_actions_read_declared_inputs_and_context_only(spark):
    def native(inputs):
        return succeed({"host": inputs["hostname"], "user": inputs["username"], "x": inputs["x"]})

    rows = [("bare", "", {"x": "1"}), ("own", "", {"hostname": None, "username": "me"})]
    df = spark.createDataFrame(rows, ROWS)
    done = run_action(df, Action("n", ("hostname", "username", "x"), native=native), hostname=F.lit("h"), username=F.lit("u"))
    assert {r["item_id"]: r["result"]["outputs"] for r in done.collect()} == {
        "bare": {"host": "h", "user": "u", "x": "1"}, "own": {"host": None, "user": "me", "x": None},
    }
    with pytest.raises(KeyError):
        run_action(df, Action("n", ("x",), native=native))


def test_dispatch_first_registry_wins_and_unknown_fails(spark):
    registries = {
        "first": {"n": Action("n", native=lambda _i: succeed({"from": F.lit("first")})), "p": DIVIDE},
        "second": {"n": Action("n", native=lambda _i: fail(F.lit("no")))},
    }
    df = spark.createDataFrame([("1", "n", {}), ("2", "p", {"a": "4"}), ("3", "zzz", {}), ("4", None, {})], ROWS)
    got = {r["item_id"]: r["result"] for r in dispatch_actions(df, registries).collect()}
    assert got["1"]["outputs"] == {"from": "first"}
    assert got["2"]["outputs"]["q"] == "4"
    assert got["3"]["error_message"] == "Action not found: zzz. Searched: ['first', 'second']"
    assert got["4"]["success"] is False


def results(spark):
    rows = [
        ("good", (True, None, {"a": "1"}, "a", 2.0)), ("bare", (True, "", {}, "", None)),
        ("bad", (False, "boom", {"a": "1"}, "", None)), ("quiet", (False, "", None, "", None)), ("none", None),
    ]
    return spark.createDataFrame(rows, f"item_id string, result {RESULT}")


def test_receipts(spark):
    got = {r["object_id"]: r for r in build_receipts(results(spark), F.lit(5), keep=()).collect()}
    assert got["good"]["outputs"] == {"a": "1"} and got["good"]["cost"] == 2.0 and got["good"]["timestamp"] == 5
    assert got["bare"]["outputs"] is None and got["bare"]["error_message"] is None
    assert got["bad"]["outputs"] is None and got["bad"]["error_message"] == "boom"
    assert got["quiet"]["success"] is False and got["quiet"]["error_message"] is None
    assert got["none"]["success"] is True


def test_single_action_result(spark):
    got = {r["item_id"]: r for r in single_action_result(results(spark), F.lit(9)).collect()}
    assert got["good"]["status"] == "SUCCEEDED" and got["good"]["receipt"]["primary_output"] == "a"
    assert got["bare"]["receipt"] is None and got["bare"]["percent"] == 100
    assert got["bad"]["status"] == "FAILED" and got["bad"]["receipt"]["error_message"] == "boom"
    assert got["quiet"]["error_message"] == ""
    assert got["none"]["status"] == "FAILED" and got["none"]["error_message"] == "Unknown error"


TAGS = {"flag": "BOOLEAN", "share": "FLOAT", "list": "LIST", "numbers": "VECTOR", "raw": "BYTES", "any": "JSON", "name": "STRING"}
VALUES = {"flag": True, "share": 0.1, "list": ["a", "b,c"], "numbers": [1.5, 2.0], "raw": b"\x00\xff", "any": {"k": [1]}, "name": "true"}


def shredded(spark, action, *inputs):
    df = spark.createDataFrame([(str(k), action.action_id, i) for k, i in enumerate(inputs)], ROWS)
    done = dispatch_actions(df, {"r": {action.action_id: action}})
    typed = variant_outputs(F.col("result.outputs"), F.col("action_id"), {action.action_id: action.outputs})
    return shred(done.withColumn("typed", typed), action.outputs).orderBy("item_id").collect()


def test_python_outputs_come_back_typed(spark):
    def give(wrong=None):
        return {**VALUES, **({wrong: object()} if wrong else {})}

    rows = shredded(spark, Action("p", ("wrong",), python=give, outputs=TAGS), {}, {"wrong": "flag"}, {"wrong": "numbers"}, {"wrong": "name"})
    assert [rows[0][n] for n in TAGS if n != "any"] == [v for n, v in VALUES.items() if n != "any"]
    assert rows[0]["any"].toPython() == {"k": [1]}
    # a wrong type fails its item only; anything can be a text
    assert [r["result"]["success"] for r in rows] == [True, False, False, True]
    assert rows[1]["result"]["error_message"] == "Not of the declared type: flag" and rows[1]["share"] is None
    assert rows[2]["result"]["error_message"] == "Not of the declared type: numbers"


def test_native_outputs_come_back_typed(spark):
    def give(inputs):
        values = {
            "flag": F.lit(True), "share": inputs["share"], "list": F.array(F.lit("a"), F.lit("b,c")), "numbers": F.array(F.lit(1.5), F.lit(2.0)),
            "raw": F.unhex(F.lit("00FF")), "any": F.struct(F.array(F.lit(1)).alias("k")), "name": F.lit("true"),
        }
        return succeed(values, types=TAGS)

    action = Action("n", ("share",), native=give, outputs=TAGS)
    good, bad, absent = shredded(spark, action, {"share": "0.1"}, {"share": "much"}, {})
    assert [good[n] for n in TAGS if n != "any"] == [v for n, v in VALUES.items() if n != "any"]
    assert bad["result"]["error_message"] == "Not of the declared type: share" and bad["flag"] is None
    assert absent["result"]["success"] and absent["share"] is None and absent["flag"] is True
    alone = run_action(spark.createDataFrame([("1", "n", {"share": "x"})], ROWS), action).first()
    assert alone["result"]["success"] is False


def test_runs_keep_typed_outputs(spark):
    action = Action("p", ("object_id",), python=lambda object_id: {"length": len(object_id), "parts": object_id.split(".")}, outputs={"length": "INTEGER", "parts": "LIST"})
    jobs = spark.createDataFrame([("h/job.1", "u", "h", "run_on_collection", "o", {})], "object_id string, username string, hostname string, job_type string, collection_owner string, input_data map<string,string>")
    items = spark.createDataFrame([("o", "o.1", "1", {}), ("o", "o.22", "22", {})], "owner string, pk string, object_id string, fields map<string,string>")
    path = scratch_path(spark, "typed")
    run = run_jobs(jobs, action, 1, items=items, receipts_path=path)
    assert sorted((r["object_id"], r["length"], r["parts"]) for r in run.typed(action).collect()) == [("o.1", 3, ["o", "1"]), ("o.22", 4, ["o", "22"])]
    assert shred(read_receipts(spark, path), action.outputs).agg(F.sum("length")).first()[0] == 7
