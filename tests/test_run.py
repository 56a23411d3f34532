import pytest
from pyspark.sql import functions as F

from rowloom.operators.actions import Action, fail, succeed
from rowloom.operators.jobs import normalise_status, resolve_jobs, validate_jobs
from rowloom.operators.rollup import finish_jobs, job_counts, latest_receipt, trigger_stats
from rowloom.plans.run import run_jobs
from rowloom.schemas import JOBS, MAPPINGS


def _grade(inputs):
    mark = inputs["mark"].try_cast("int")
    return F.when(mark >= inputs["floor"].cast("int"), succeed({"grade": mark + 1})).otherwise(
        fail(F.lit("low"))
    )


GRADE = Action("grade", ("mark", "floor"), native=_grade)


def job(spark, *rows):
    fields = spark.createDataFrame([], JOBS).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


BASE = {"username": "u", "hostname": "h"}


@pytest.fixture
def jobs(spark):
    kind = lambda n, t, **more: {**BASE, "object_id": f"h/u/job.{n}", "job_type": t, "input_data": {"floor": "5"}, **more}
    return job(
        spark,
        kind("c", "run_on_collection", collection_owner="o"),
        kind("all", "run_on_collection", collection_owner="o", input_data={"floor": "99"}),
        kind("ok", "run_on_collection", collection_owner="o", input_data={"floor": "0"}),
        kind("none", "run_on_collection", collection_owner="nobody"),
        kind("bad", "run_on_collection", status="RUNNING"),
        kind("stop", "run_on_collection", collection_owner="o", request_cancel=True, success_count=3, error_count=1),
        kind("s", "run_on_stream", stream_id="st"),
        kind("f", "run_on_files", file_keys=["a/9", "b"], prefix="p/", input_data={"floor": "5", "mark": "7"}),
        kind("nofiles", "run_on_files", file_keys=[]),
        kind("one", "singleton", input_data={"floor": "1", "mark": "3"}),
        kind("odd", "never_heard_of", input_data={"floor": "5", "mark": "3"}),
    )


def test_whole_run(spark, jobs):
    items = spark.createDataFrame(
        [("o", "o.1", "1", {"mark": "9"}), ("o", "o.2", "2", {"mark": "2"}), ("o", None, "3", {"mark": "8"}),
         ("o", "h/u/job.9", "9", {"mark": "9"}), ("x", "x.1", "1", {"mark": "9"})],
        "owner string, pk string, object_id string, fields map<string,string>",
    )
    events = spark.createDataFrame(
        [("st", 1, "a", {"mark": "9"}), ("st", 2, "b", {"mark": "1"}), ("st", 3, "c", {"mark": "9"})],
        "stream_id string, timestamp bigint, object_id string, fields map<string,string>",
    )
    run = run_jobs(jobs, GRADE, 1234, items=items, events=events, limit=2)
    rows = {
        r["object_id"].split(".")[-1]: (r["status"], r["error_message"], r["percent"], r["success_count"], r["error_count"])
        for r in run.jobs.collect()
    }
    assert rows == {
        "c": ("SUCCEEDED", "1 of 3 items failed", 100, 2, 1),
        "all": ("FAILED", "All 3 items failed", 100, 0, 3),
        "ok": ("SUCCEEDED", None, 100, 3, 0),
        "none": ("SUCCEEDED", "No items found in collection", None, None, None),
        "stop": ("FAILED", "Job was cancelled by user", None, 3, 1),
        "s": ("SUCCEEDED", "1 of 2 items failed", 100, 1, 1),
        "f": ("SUCCEEDED", None, 100, 2, 0),
        "one": ("SUCCEEDED", None, 100, 1, 0),
        "odd": ("FAILED", "low", 100, 0, 1),
    }
    assert {r["object_id"]: (r["status"], r["reject_reason"]) for r in run.rejected.collect()} == {
        "h/u/job.bad": ("RUNNING", "collection_owner is required for run_on_collection"),
        "h/u/job.nofiles": (None, "file_keys is required for run_on_files"),
    }
    receipts = run.receipts.filter("job_id = 'h/u/job.c'").collect()
    assert {(r["object_id"], r["success"], r["stream_id"], r["timestamp"]) for r in receipts} == {
        ("o.1", True, "h/u/stream-run-all.c", 1234), ("o.2", False, "h/u/stream-run-all.c", 1234),
        ("3", True, "h/u/stream-run-all.c", 1234),
    }
    assert {r["object_id"] for r in run.receipts.filter("job_id = 'h/u/job.s'").collect()} == {"st@1", "st@2"}
    assert run.progress.filter("job_id = 'h/u/job.c' and seq = 3").first()["percent"] == 100

    mappings = spark.createDataFrame([("h/u/job.c", [("grade", "score")])], f"object_id string, mappings {MAPPINGS}")
    updated = {r["item_id"]: r["fields"] for r in run.updated_items(items, mappings).collect()}
    assert updated["o.1"] == {"mark": "9", "score": "10"}
    assert updated["o.2"] == {"mark": "2"}
    assert updated["3"] == {"mark": "8", "score": "9"}


def test_jobs_pick_their_actions(spark):
    items = spark.createDataFrame([("o", "o.1", "1", {"mark": "9"})], "owner string, pk string, object_id string, fields map<string,string>")
    table = spark.createDataFrame(
        [(f"h/u/job.{a}", "h", "u", "run_on_collection", "o", {"floor": "1"}, a) for a in ("grade", "script", "lost")],
        "object_id string, hostname string, username string, job_type string, collection_owner string, "
        "input_data map<string,string>, action_id string",
    )
    script = Action("script", ("mark",), python=lambda mark: {"twice": int(mark) * 2})
    run = run_jobs(table, {"own": {"grade": GRADE, "script": script}}, 1, items=items)
    got = {r["object_id"]: (r["success"], r["outputs"], r["error_message"]) for r in run.receipts.withColumn("object_id", F.col("job_id")).collect()}
    assert got == {
        "h/u/job.grade": (True, {"grade": "10"}, None), "h/u/job.script": (True, {"twice": "18"}, None),
        "h/u/job.lost": (False, None, "Action not found: lost. Searched: ['own']"),
    }


def test_forced_type_and_fallbacks(spark):
    table = job(spark, {**BASE, "object_id": "a"}, {**BASE, "object_id": "b", "job_type": "singleton", "stream_id": ""})
    forced = resolve_jobs(table, "run_on_stream", stream_id="s0")
    assert {r["job_type"] for r in forced.collect()} == {"run_on_stream"}
    assert {r["stream_id"] for r in forced.collect()} == {"s0"}
    assert validate_jobs(resolve_jobs(table, "run_on_stream")).filter("reject_reason is not null").count() == 2


def test_statuses_and_counts(spark):
    df = spark.createDataFrame([("PENDING",), ("FAILED",), (None,)], "s string")
    assert [r[0] for r in df.select(normalise_status(F.col("s"))).collect()] == ["INITIALIZING", "FAILED", "INITIALIZING"]
    receipts = spark.createDataFrame([("a", True), ("a", False)], "job_id string, success boolean")
    table = spark.createDataFrame([("a", "run_on_files"), ("b", "run_on_files")], "object_id string, job_type string")
    got = {r["object_id"]: r["error_message"] for r in finish_jobs(table, job_counts(receipts)).collect()}
    assert got == {"a": "1 of 2 files failed", "b": "No files to process"}


def test_latest_and_stats_break_ties_by_seq(spark):
    rows = [("t", 5, 1, "a", True, None), ("t", 5, 2, "b", False, "e1"), ("t", 4, 3, "c", False, "e0")]
    df = spark.createDataFrame(rows, "k string, timestamp bigint, seq int, object_id string, success boolean, error_message string")
    assert latest_receipt(df, ["k"]).first()["object_id"] == "b"
    stats = trigger_stats(df, ["k"]).first()
    assert (stats["run_count"], stats["error_count"], stats["last_err_message"], stats["last_object_id"]) == (3, 2, "e1", "b")
    quiet = trigger_stats(df.filter("success"), ["k"]).first()
    assert quiet["last_err_at"] is None and quiet["last_err_message"] is None


def test_context_source_and_typed_outputs(spark):
    items = spark.createDataFrame([("o", "o.1", "1", {}), ("o", None, None, {})], "owner string, pk string, object_id string, fields map<string,string>")
    table = spark.createDataFrame(
        [("h/u/job.c", "h", "u", "run_on_collection", "", None), ("h/u/job.s", "h", "u", "run_on_stream", None, "st")],
        "object_id string, hostname string, username string, job_type string, collection_owner string, stream_id string",
    ).withColumn("input_data", F.create_map().cast("map<string,string>"))
    script = Action("who", ("username",), python=lambda username: {"who": username, "l": [1, "a"], "b": b"ab", "t": True})
    run = run_jobs(table, script, 1, items=items, collection_owner="o")
    rows = {r["object_id"]: r["outputs"] for r in run.receipts.collect()}
    assert rows == {k: {"who": "u", "l": '[1, "a"]', "b": "YWI=", "t": "true"} for k in ("o.1", "unknown")}
    assert {r["object_id"]: r["reject_reason"] for r in run.rejected.collect()} == {"h/u/job.s": "no items were given for run_on_stream"}
    links = spark.createDataFrame([("h/u/job.c", "who", "owner_name")], "object_id string, source string, target string")
    updated = {r["item_id"]: r["fields"] for r in run.updated_items(items, links).collect()}
    assert updated == {"o.1": {"owner_name": "u"}, "unknown": {}}


def test_receipts_of_a_run_are_appended(spark):
    from rowloom.session import scratch_path
    from rowloom.sinks.receipts import read_receipts

    items = spark.createDataFrame([("o", f"o.{i}", str(i), {"mark": "x" if i == 2 else "9"}) for i in range(4)], "owner string, pk string, object_id string, fields map<string,string>")
    table = spark.createDataFrame(
        [("h/u/job.c", "h", "u", "run_on_collection", "o", {"floor": "1"})],
        "object_id string, hostname string, username string, job_type string, collection_owner string, input_data map<string,string>",
    )
    path = scratch_path(spark, "all-receipts")
    for clock in (1, 2):
        run_jobs(table, GRADE, clock, items=items, receipts_path=path)
    got = read_receipts(spark, path).collect()
    assert len(got) == 8 and sorted(r["object_id"] for r in got if not r["success"]) == ["o.2", "o.2"]
    again = scratch_path(spark, "receipts-once")
    for clock in (1, 2):
        run = run_jobs(table, GRADE, clock, items=items, receipts_path=again, run_id="the run")
    kept = read_receipts(spark, again)
    assert kept.count() == 4 and {r["timestamp"] for r in kept.collect()} == {2}
    assert sorted(run.receipts.inputFiles()) == sorted(f for f in kept.inputFiles())  # written once, and read from there
    blocked = run_jobs(table, GRADE, 3, items=items, receipts_path="file:///proc/nowhere")
    assert blocked.receipts.count() == 4


def test_outputs_are_written_back_on_top_of_other_writers(spark):
    from rowloom.plans.run import store_items
    from rowloom.session import scratch_path
    from rowloom.sinks.documents import read_documents, upsert_into

    schema = "owner string, pk string, object_id string, fields map<string,string>"
    items = spark.createDataFrame([("o", f"o.{i}", str(i), {"mark": str(i)}) for i in range(6)] + [("o", None, None, {})], schema)
    table = spark.createDataFrame(
        [("h/u/job.c", "h", "u", "run_on_collection", "o", {})],
        "object_id string, hostname string, username string, job_type string, collection_owner string, input_data map<string,string>",
    )
    twice = Action("twice", ("mark",), python=lambda mark: {"twice": 2 * int(mark)})
    links = spark.createDataFrame([("h/u/job.c", "twice", "double")], "object_id string, source string, target string")
    root = scratch_path(spark, "items")
    assert store_items(items, root) == 1
    run = run_jobs(table, twice, 1, items_root=root, mappings=links)
    assert run.items_version == 2 and run.jobs.first()["error_count"] == 1
    held = lambda: {r["item_id"]: r["fields"] for r in read_documents(spark, root).collect()}
    assert held() == {"unknown": {}, **{f"o.{i}": {"mark": str(i), "double": str(2 * i)} for i in range(6)}}
    # another writer changes an item; writing back again sets our field and leaves its
    other = read_documents(spark, root).filter("item_id = 'o.3'").withColumn("fields", F.create_map(F.lit("mark"), F.lit("new")))
    upsert_into(other, root, "item_id")
    assert run.write_back(links, root) == 4 and held()["o.3"] == {"mark": "new", "double": "6"}
