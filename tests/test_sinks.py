from concurrent.futures import ThreadPoolExecutor

import pytest

from rowloom.session import scratch_path
from rowloom.sinks.destinations import write_destination
from rowloom.sinks.documents import (
    Conflict,
    current_version,
    merge_documents,
    read_documents,
    rebucket,
    save_documents,
    snapshot,
    upsert_documents,
    upsert_into,
    vacuum,
)
from rowloom.sinks.files import write_files
from rowloom.sinks.receipts import (
    append_receipts,
    commit_receipts,
    read_receipts,
    stage_receipts,
    stream_put,
    write_batch_receipts,
)

RECEIPTS = "stream_id string, object_id string, seq bigint, timestamp bigint"


def receipts(spark, *streams):
    return spark.createDataFrame([(s, str(i), i, 1) for i, s in enumerate(streams)], RECEIPTS)


def test_receipts_append_and_read_one_stream(spark):
    path = scratch_path(spark, "r")
    assert append_receipts(receipts(spark, "a", "b", "a"), path)
    assert append_receipts(receipts(spark, "a"), path)
    assert read_receipts(spark, path).count() == 4
    assert read_receipts(spark, path, "a").count() == 3
    plan = read_receipts(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_a_run_appended_again_replaces_its_receipts(spark):
    path = scratch_path(spark, "r")
    append_receipts(receipts(spark, "a", "b"), path, "one")
    append_receipts(receipts(spark, "c"), path, "two")
    append_receipts(receipts(spark, "a", "b"), path, "one")
    assert sorted(r["stream_id"] for r in read_receipts(spark, path).collect()) == ["a", "b", "c"]
    append_receipts(receipts(spark, "d"), path, "one")
    assert sorted(r["stream_id"] for r in read_receipts(spark, path).collect()) == ["c", "d"]
    append_receipts(receipts(spark).filter("false"), path, "two")
    assert [r["stream_id"] for r in read_receipts(spark, path).collect()] == ["d"]


def test_a_killed_append_leaves_nothing(spark):
    path = scratch_path(spark, "r")
    staged = stage_receipts(receipts(spark, "a", "b"), path)  # and no commit
    with pytest.raises(FileNotFoundError):
        read_receipts(spark, path)
    append_receipts(receipts(spark, "c"), path)
    assert [r["stream_id"] for r in read_receipts(spark, path).collect()] == ["c"]
    assert commit_receipts(spark, staged) == 2 and read_receipts(spark, path).count() == 3


def test_appends_at_the_same_time_are_all_kept(spark):
    path = scratch_path(spark, "r")
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda k: append_receipts(receipts(spark, f"s{k}"), path, f"run{k}"), range(6)))
    assert sorted(r["stream_id"] for r in read_receipts(spark, path).collect()) == [f"s{k}" for k in range(6)]


def test_runs_with_other_columns(spark):
    path = scratch_path(spark, "r")
    append_receipts(receipts(spark, "a"), path)
    append_receipts(receipts(spark, "b").selectExpr("*", "1.5D AS cost"), path)
    assert sorted((r["stream_id"], r["cost"]) for r in read_receipts(spark, path).collect()) == [("a", None), ("b", 1.5)]


def test_only_the_copy_of_receipts_may_fail(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("in the way")
    assert append_receipts(receipts(spark, "a"), f"file://{blocked}/sub") is False
    with pytest.raises(Exception):
        write_batch_receipts(receipts(spark, "a"), f"file://{blocked}/sub", 0)
    broken = receipts(spark, "a", "b").selectExpr("stream_id", "object_id", "seq", "cast(stream_id as bigint) AS timestamp")
    with pytest.raises(Exception):  # the work itself, not the copy
        append_receipts(broken, scratch_path(spark, "r"))


def test_a_second_write_adds_to_a_collection(spark):
    where = {"kind": "COLLECTION", "owner": "o", "path": scratch_path(spark, "c")}
    write = lambda *rows: write_destination(spark.createDataFrame(rows, "object_id string, v int"), where)
    write(("a", 1), ("b", 1))
    write(("b", 2), ("c", 2))
    assert sorted((r["object_id"], r["v"]) for r in read_documents(spark, where["path"]).collect()) == [("a", 1), ("b", 2), ("c", 2)]


DOCUMENT = "object_id string, v int"


def stored(spark, root, *rows, **how):
    return upsert_into(spark.createDataFrame(rows, DOCUMENT), root, **how)


def held(spark, root, version=None):
    return sorted(tuple(r) for r in read_documents(spark, root, version).collect())


def test_of_two_writers_from_one_version_the_later_fails(spark):
    root = scratch_path(spark, "d")
    stored(spark, root, ("a", 1))
    seen = snapshot(spark, root)
    assert stored(spark, root, ("b", 1), base=seen) == 2
    with pytest.raises(Conflict):
        stored(spark, root, ("c", 1), base=seen)
    with pytest.raises(Conflict):
        save_documents(spark.createDataFrame([("d", 1)], DOCUMENT), root, base=seen)
    assert held(spark, root) == [("a", 1), ("b", 1)] and current_version(spark, root) == 2
    assert stored(spark, root, ("c", 1), base=seen, retries=1) == 3  # begins anew from what the first left
    assert held(spark, root) == [("a", 1), ("b", 1), ("c", 1)]


def test_writers_at_the_same_time_lose_nothing(spark):
    root = scratch_path(spark, "d")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda k: stored(spark, root, (f"k{k}", k), ("shared", k), retries=20, buckets=4), range(6)))
    assert sorted(done) == list(range(1, 7))
    rows = held(spark, root)
    assert [r[0] for r in rows] == ["k0", "k1", "k2", "k3", "k4", "k5", "shared"]
    assert dict(rows)["shared"] == done.index(6)  # the last version's


def test_only_changed_buckets_are_written(spark):
    root = scratch_path(spark, "d")
    stored(spark, root, *[(f"k{i}", 0) for i in range(300)], buckets=16)
    before = snapshot(spark, root)
    stored(spark, root, ("k5", 1), ("k5x", 1))
    after = snapshot(spark, root)
    changed = [b for b in after.parts if after.parts[b] != before.parts[b]]
    assert 1 <= len(changed) <= 2 and len(before.parts) == 16
    assert all(set(before.folders([b])) == set(after.folders([b])) for b in after.parts if b not in changed)
    assert dict(held(spark, root))["k5"] == 1 and len(held(spark, root)) == 301
    assert dict(held(spark, root, 1))["k5"] == 0 and len(held(spark, root, 1)) == 300  # older versions stay readable


def test_documents_without_a_key_stay_and_are_spread(spark):
    root = scratch_path(spark, "d")
    for _round in range(2):
        stored(spark, root, *[(None, i) for i in range(200)], ("a", _round), buckets=8)
    rows = read_documents(spark, root).collect()
    assert len(rows) == 401 and [r["v"] for r in rows if r["object_id"] == "a"] == [1]
    assert len(snapshot(spark, root).parts) == 8


def test_empty_writes_and_missing_stores(spark):
    root = scratch_path(spark, "d")
    with pytest.raises(FileNotFoundError):
        read_documents(spark, root)
    assert stored(spark, root, ("a", 1)) == 1
    nothing = spark.createDataFrame([], DOCUMENT)
    assert upsert_into(nothing, root) == 1  # nothing to commit
    assert save_documents(nothing, root) == 2
    assert held(spark, root) == [] and held(spark, root, 1) == [("a", 1)]


def test_rebucket_and_vacuum(spark):
    root = scratch_path(spark, "d")
    for k in range(4):
        stored(spark, root, *[(f"k{i}", k) for i in range(50)], buckets=4)
    rebucket(spark, root, 9)
    assert len(snapshot(spark, root).parts) == 9
    assert vacuum(spark, root, keep_versions=1) == []  # young writes stay
    gone = vacuum(spark, root, keep_versions=1, older_than_ms=-60_000)
    assert len(gone) == 4 and held(spark, root) == sorted((f"k{i}", 3) for i in range(50))
    with pytest.raises(Exception):
        read_documents(spark, root, 2)


def test_replayed_batch_replaces_itself(spark):
    path = scratch_path(spark, "b")
    for _attempt in range(2):
        write_batch_receipts(receipts(spark, "a", "b"), path, 3)
    write_batch_receipts(receipts(spark, "c"), path, 4)
    assert spark.read.parquet(path).count() == 3


def test_stream_put_keeps_the_last(spark):
    rows = [("s", 1, "old", 1), ("s", 1, "new", 2), ("s", 2, "x", 1), ("t", 1, "y", 1)]
    got = stream_put(spark.createDataFrame(rows, "stream_id string, timestamp bigint, object_id string, seq int"))
    assert sorted(r["object_id"] for r in got.collect()) == ["new", "x", "y"]


def test_upsert_versions(spark):
    root = scratch_path(spark, "d")
    assert current_version(spark, root) == 0
    schema = "object_id string, v int"
    save_documents(spark.createDataFrame([("a", 1), ("b", 1)], schema), root)
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], schema + ", at int")
    merged = upsert_documents(read_documents(spark, root), new, order="at")
    assert save_documents(merged, root) == 2
    assert sorted(tuple(r) for r in read_documents(spark, root).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_merge_needs_a_table_format_that_has_it(spark):
    spark.sql("create or replace temp view plain as select 'a' as object_id")
    with pytest.raises(Exception):
        merge_documents(spark.sql("select 'a' as object_id"), "plain")


@pytest.mark.parametrize("extension", ["parquet", ".json", "csv", "orc"])
def test_write_files(spark, extension):
    folder = write_files(receipts(spark, "a", "b"), scratch_path(spark, "f") + "/", extension)
    reader = spark.read.option("header", "true").schema(RECEIPTS)
    assert reader.format(extension.lstrip(".")).load(folder).count() == 2


def test_unknown_extension_and_inactive_destination(spark):
    with pytest.raises(ValueError):
        write_files(receipts(spark, "a"), scratch_path(spark, "f"), "xyz")
    assert write_destination(receipts(spark, "a"), {"kind": "INACTIVE"}) is None
