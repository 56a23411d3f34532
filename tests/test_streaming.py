from pyspark.sql import functions as F

from rowloom.functions.inputs import fields_of
from rowloom.operators.actions import Action, fail, succeed
from rowloom.session import scratch_path
from rowloom.streaming.runs import live_counts, read_live_counts, read_new_files, run_on_stream_incremental
from rowloom.sinks.receipts import stream_put
from rowloom.streaming.puts import STATE_STORE, read_puts, stream_put_live
from rowloom.streaming.triggers import collection_changes, file_trigger, stream_trigger, stream_triggers

EVENTS = "stream_id string, timestamp bigint, value int"
JOBS = "object_id string, hostname string, username string, stream_id string, input_data map<string,string>, request_cancel boolean"


def _positive(inputs):
    value = inputs["value"].try_cast("int")
    return F.when(value > 0, succeed({"value": value})).otherwise(fail(F.lit("not positive")))


POSITIVE = Action("positive", ("value",), native=_positive)


def test_incremental_run_sees_only_new_items_and_stops_for_cancelled_jobs(spark):
    source, out, offsets = (scratch_path(spark, n) for n in ("source", "out", "offsets"))
    jobs = [("h/u/job.1", "h", "u", "s", {}, False), ("h/u/job.2", "h", "u", "s", {}, None)]

    def run(cancelled=()):
        table = [(*j[:5], j[0] in cancelled) for j in jobs]
        events = read_new_files(spark, source, spark.createDataFrame([], EVENTS).schema)
        run_on_stream_incremental(
            events, lambda: spark.createDataFrame(table, JOBS), POSITIVE, fields_of({"value": F.col("value")}), out, offsets
        )
        return spark.read.parquet(out)

    spark.createDataFrame([("s", 1, 5), ("s", 2, -1), ("other", 3, 1)], EVENTS).write.mode("append").parquet(source)
    first = run()
    assert first.count() == 4
    assert {(r["object_id"], r["success"]) for r in first.collect()} == {("s@1", True), ("s@2", False)}

    spark.createDataFrame([("s", 4, 5)], EVENTS).write.mode("append").parquet(source)
    second = run(cancelled=("h/u/job.2",))
    assert second.count() == 5
    assert second.filter("object_id = 's@4'").select("job_id").collect()[0][0] == "h/u/job.1"
    assert run().count() == 5  # nothing new


def test_live_counts_over_several_batches_equal_the_batch_result(spark):
    source, out, offsets = (scratch_path(spark, n) for n in ("source", "out", "offsets"))
    schema = "job_id string, success boolean"
    for part in range(3):
        rows = [(f"j{i % 2}", i % 3 == part) for i in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        live_counts(read_new_files(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1), out, offsets)
    got = {r["job_id"]: (r["success_count"], r["error_count"]) for r in read_live_counts(spark, out).collect()}
    assert got == {"j0": (10, 20), "j1": (10, 20)}


def test_stream_trigger_on_a_table(spark):
    events = spark.createDataFrame([("s", "GENERIC", {"n": "4"}), ("s", "PING", {"n": "1"}), ("t", "GENERIC", {"n": "-4"})],
                                   "stream_id string, etype string, data map<string,string>")
    done = stream_trigger(events, POSITIVE, [{"src": "n", "dest": "value"}], [{"src": "value", "dest": "out"}], etype="GENERIC")
    assert {r["stream_id"]: r["mapped"] for r in done.collect()} == {"s": {"out": "4"}, "t": None}


def test_many_triggers_each_with_its_own_maps(spark):
    events = spark.createDataFrame([("s", {"n": "4"}), ("t", {"n": "4"}), ("u", {"n": "4"})], "stream_id string, data map<string,string>")
    triggers = spark.createDataFrame(
        [
            ("t1", "s", "positive", [("n", "value", None)], [("value", "out", None), (None, "by", "t1")]),
            ("t2", "s", "positive", [(None, "value", "-1")], [("value", "out", None)]),
            ("t3", "t", "nobody", [], []),
        ],
        "object_id string, owner string, action_id string, in_map array<struct<src:string,dest:string,static:string>>, "
        "out_map array<struct<src:string,dest:string,static:string>>",
    )
    done = stream_triggers(events, triggers, {"here": {"positive": POSITIVE}}).collect()
    got = {r["trigger_id"]: (r["result"]["success"], r["mapped"]) for r in done}
    assert got == {"t1": (True, {"out": "4", "by": "t1"}), "t2": (False, None), "t3": (False, None)}


def test_file_trigger_does_not_read_content_it_does_not_need(spark):
    folder = scratch_path(spark, "files")
    spark.range(3).repartition(1).write.json(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = Action("name", ("key",), native=lambda i: succeed({"key": i["key"]}))
    done = file_trigger(files, name, "part-", ["*.json"], key=F.substring_index("path", "/", -1)).select("result.outputs")
    assert done.count() == 1
    assert "content" not in done._jdf.queryExecution().executedPlan().toString()


def test_collection_changes_is_null_safe_and_not_fooled_by_joined_values(spark):
    schema = "k int, a string, b string"
    old = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, "a|1:b", ""), (4, "s", "s"), (5, "", None)], schema)
    new = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "a", "b"), (5, None, ""), (6, "n", "n")], schema)
    assert sorted(r["k"] for r in collection_changes(old, new, "k").collect()) == [2, 3, 5]
    assert sorted(r["k"] for r in collection_changes(old, new, "k", ["b"]).collect()) == [2, 3, 5]


def test_a_failing_batch_is_handled_again(spark, monkeypatch):
    import pytest

    source, out, offsets = (scratch_path(spark, n) for n in ("source", "out", "offsets"))
    events = [("s", 1, 5), ("s", 1, 6), ("s", 2, -1)]
    spark.createDataFrame(events, EVENTS).write.parquet(source)
    jobs = spark.createDataFrame([("h/u/job.1", "h", "u", "s", {}, False)], JOBS)

    def run(action):
        stream = read_new_files(spark, source, spark.createDataFrame([], EVENTS).schema)
        run_on_stream_incremental(
            stream, lambda: jobs, action, fields_of({"value": F.col("value")}), out, offsets, event_key="value"
        )

    broken = Action("broken", ("value",), native=lambda i: succeed({"x": F.raise_error(F.lit("lost"))}))
    with pytest.raises(Exception):
        run(broken)
    run(POSITIVE)
    got = spark.read.parquet(out).collect()
    assert sorted((r["timestamp"], r["seq"], r["success"]) for r in got) == [(1, 5, True), (1, 6, True), (2, -1, False)]


def test_only_valid_stream_jobs_take_part(spark):
    source, out, offsets = (scratch_path(spark, n) for n in ("source", "out", "offsets"))
    spark.createDataFrame([("s", 1, 5)], EVENTS).write.parquet(source)
    rows = [("h/u/job.1", "h", "u", "s", {}, False, "run_on_stream"), ("h/u/job.2", "h", "u", "s", {}, False, "run_on_files"), ("h/u/job.3", "h", "", "s", {}, False, "run_on_stream")]
    jobs = spark.createDataFrame(rows, JOBS + ", job_type string")
    stream = read_new_files(spark, source, spark.createDataFrame([], EVENTS).schema)
    run_on_stream_incremental(stream, lambda: jobs, POSITIVE, fields_of({"value": F.col("value")}), out, offsets)
    assert "h/u/job.2" not in {r["job_id"] for r in spark.read.parquet(out).collect()}


def test_changes_in_nested_columns(spark):
    schema = "k int, tags array<string>, m map<string,string>, t string"
    old = [(1, [None], {"a": "1"}, None), (2, ["x", "y"], {}, "a"), (3, ["x"], {"a": None}, "b"), (4, None, None, "null"), (5, ["x"], {"a": "1"}, "c")]
    new = [(1, ["null"], {"a": "1"}, None), (2, ["x, y"], {}, "a"), (3, ["x"], {}, "b"), (4, None, None, None), (5, ["x"], {"a": "1"}, "c")]
    done = collection_changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "k")
    assert sorted(r["k"] for r in done.collect()) == [1, 2, 3, 4]


def test_collection_changes_are_typed(spark):
    same = "map('a', 1, 'b', 2) AS m, timestamp'2024-01-01 00:00:00.000001' AS t, 1.5D AS d, named_struct('x', array(timestamp_micros(7))) AS s"
    def changed(old, new):  # noqa: E306
        versions = [spark.sql(f"SELECT 1 AS k, *  EXCEPT ({x.split(' AS ')[-1]}), {x} FROM (SELECT {same})") for x in (old, new)]
        return collection_changes(versions[0].select("k", "m", "t", "d", "s"), versions[1].select("k", "m", "t", "d", "s"), "k").count() == 1

    assert changed("timestamp'2024-01-01 00:00:00.000001' AS t", "timestamp'2024-01-01 00:00:00.000999' AS t")
    assert changed("cast(null as timestamp) AS t", "timestamp'1970-01-01 00:00:00' AS t")
    assert not changed("map('a', 1, 'b', 2) AS m", "map('b', 2, 'a', 1) AS m")
    assert changed("map('a', 1, 'b', 2) AS m", "map('a', 2, 'b', 1) AS m")
    assert changed("cast(null as map<string,int>) AS m", "cast(map() as map<string,int>) AS m")
    assert not changed("0.0D AS d", "-0.0D AS d") and not changed("double('NaN') AS d", "double('NaN') AS d")
    assert changed("0.3D AS d", "0.1D + 0.2D AS d") and changed("double('NaN') AS d", "cast(null as double) AS d")
    nested = "named_struct('x', array(timestamp_micros({}))) AS s"
    assert changed(nested.format(7), nested.format(8)) and not changed(nested.format(7), nested.format(7))
    assert changed(nested.format(7), "cast(null as struct<x:array<timestamp>>) AS s")


KEYED = "stream_id string, timestamp bigint, value bigint, event_id bigint"


def test_repeated_events_give_one_receipt_and_late_ones_are_told(spark):
    source, out, offsets = (scratch_path(spark, n) for n in ("source", "out", "offsets"))
    hour, jobs = 3_600_000, [("h/u/job.1", "h", "u", "s", {}, False)]

    def run(*events):
        spark.createDataFrame(list(events), KEYED).coalesce(1).write.mode("append").parquet(source)
        late = run_on_stream_incremental(
            read_new_files(spark, source, spark.createDataFrame([], KEYED).schema), lambda: spark.createDataFrame(jobs, JOBS),
            POSITIVE, fields_of({"value": F.col("value")}), out, offsets, event_key="event_id", repeats_within="1 hour",
        )
        return late, sorted(r["seq"] for r in spark.read.parquet(out).collect())

    assert run(("s", hour, 5, 1), ("s", hour, 5, 1), ("s", hour, 5, 2)) == (0, [1, 2])
    assert run(("s", hour, 5, 1), ("s", 2 * hour, 5, 3)) == (0, [1, 2, 3])  # a copy in another file and run
    assert run(("s", 9 * hour, 5, 4)) == (0, [1, 2, 3, 4])
    assert run(("s", 2 * hour, 5, 9), ("s", 9 * hour, 5, 5)) == (1, [1, 2, 3, 4, 5])  # one came seven hours late


PUTS = "stream_id string, timestamp bigint, object_id string, seq bigint"


def test_puts_on_a_stream_are_those_of_the_batch(spark):
    source, out, offsets = (scratch_path(spark, n) for n in ("source", "out", "offsets"))
    parts = [
        [("s", 1, "a", 1), ("s", 1, "b", 3), ("s", 2, "c", 1), ("t", 1, "d", 1)],
        [("s", 1, "late", 2), ("s", 2, "e", 2), ("t", 1, "d", 1)],  # behind a later put; a repeated one
        [("s", 1, "f", 4), ("u", 7, "g", 1)],
    ]
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        for rows in parts:
            spark.createDataFrame(rows, PUTS).coalesce(1).write.mode("append").parquet(source)
            stream_put_live(read_new_files(spark, source, spark.createDataFrame([], PUTS).schema), out, offsets)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    every = spark.createDataFrame([r for rows in parts for r in rows], PUTS)
    want = sorted(tuple(r) for r in stream_put(every).select("stream_id", "timestamp", "object_id", "seq").collect())
    got = read_puts(spark, out).select("stream_id", "timestamp", "object_id", "seq")
    assert sorted(tuple(r) for r in got.collect()) == want
    written = sorted(r["object_id"] for r in spark.read.parquet(out).collect())
    assert written == ["b", "c", "d", "e", "f", "g"]  # neither the late put nor the repeated one
