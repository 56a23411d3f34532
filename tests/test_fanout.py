import random
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from rowloom.operators.fanout import fan_out_collection, fan_out_files, fan_out_stream, hash_blocks, range_blocks
from rowloom.operators.topn import first_per_group
from rowloom.sources.collections import exclude_jobs, multi_get, union_pages, with_item_id
from rowloom.sources.streams import read_stream

ITEMS = "owner string, pk string, object_id string"


def skewed_items():
    """One owner with a third of all rows, many small ones, rows without pk."""
    rows = [("hot", f"hot.{i}", str(i)) for i in range(400)]
    rows += [(f"o{i % 97}", f"o{i % 97}.{i}" if i % 5 else None, str(i)) for i in range(800)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("digits", [0, 1, 3, 8])
def test_every_job_numbers_every_item_once_at_any_width(spark, digits):
    rows = skewed_items()
    jobs = [("j1", "hot"), ("j2", "hot"), ("j3", "o5"), ("j4", "nobody"), ("j5", "o6")]
    out = fan_out_collection(
        spark.createDataFrame(jobs, "object_id string, collection_owner string"),
        spark.createDataFrame(rows, ITEMS).repartition(5),
        digits,
    ).collect()
    of_owner, found = defaultdict(list), defaultdict(list)
    for owner, pk, object_id in rows:
        item = pk or object_id
        of_owner[owner].append(item)
    for row in out:
        found[row["object_id"]].append((row["seq"], row["item_id"], row["n"]))
    for job, owner in jobs:
        mine = of_owner[owner]
        ordered = sorted(mine, key=lambda item: (md5(item.encode()).hexdigest(), item))
        assert sorted(found[job]) == [(i, item, len(ordered)) for i, item in enumerate(ordered, 1)]


def test_first_per_group_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(9)}", rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, t int, i int").repartition(7)
    out = first_per_group(df, ["g"], [F.col("t"), F.col("i")], 12).collect()
    expected = set()
    for group in {r[0] for r in rows}:
        first = sorted((t, i) for g, t, i in rows if g == group)[:12]
        expected |= {(group, t, i, at) for at, (t, i) in enumerate(first, 1)}
    assert {(r["g"], r["t"], r["i"], r["seq"]) for r in out} == expected
    assert len(out) == len(expected)


EVENTS = "stream_id string, timestamp bigint, object_id string"


def test_stream_limit_and_empty_stream(spark):
    events = [("s1", t, f"{t}-{k}") for t in range(1, 30) for k in range(3)] + [("s2", 5, "x")]
    jobs = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2"), ("d", "s3")], "object_id string, stream_id string")
    out = fan_out_stream(jobs, spark.createDataFrame(events, EVENTS).repartition(4), limit=10, after_timestamp=2).collect()
    per_job = defaultdict(list)
    for r in out:
        per_job[r["object_id"]].append((r["seq"], r["item_timestamp"], r["item_object_id"], r["n"]))
    wanted = sorted((t, i) for s, t, i in events if s == "s1" and t > 2)[:10]
    assert sorted(per_job["a"]) == sorted(per_job["b"]) == [(n, t, i, 10) for n, (t, i) in enumerate(wanted, 1)]
    assert per_job["c"] == [(1, 5, "x", 1)]
    assert "d" not in per_job


def test_streams_are_read_whole_by_default(spark):
    times = [None, -5, 0, 3, 3, 12, 99_999_999]
    events = [("s", t, str(k)) for k, t in enumerate(times)] + [("t", 1, "x")]
    jobs = spark.createDataFrame([("j", "s")], "object_id string, stream_id string")
    out = fan_out_stream(jobs, spark.createDataFrame(events, EVENTS).repartition(3)).collect()
    assert sorted((r["seq"], r["item_timestamp"], r["n"]) for r in out) == [(i, t, 7) for i, t in enumerate(times, 1)]
    assert read_stream(spark.createDataFrame(events, EVENTS), "s").count() == 7


def test_read_stream_is_strictly_after_and_ordered(spark):
    events = spark.createDataFrame([("s", 3, "b"), ("s", 1, "a"), ("s", 2, "c"), ("s", 3, "a"), ("t", 9, "z")], EVENTS)
    assert [(r[1], r[2]) for r in read_stream(events, "s", 1, 2).collect()] == [(2, "c"), (3, "a")]


def test_files_keep_list_order_and_copies(spark):
    jobs = spark.createDataFrame([("j", ["b/x", "a", "b/x"]), ("e", []), ("n", None)], "object_id string, file_keys array<string>")
    out = sorted((r["seq"], r["key"], r["filename"], r["n"]) for r in fan_out_files(jobs).collect())
    assert out == [(1, "b/x", "x", 3), (2, "a", "a", 3), (3, "b/x", "x", 3)]


def test_multi_get_and_pages(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "object_id string, v int")
    keys = spark.createDataFrame([("a",), ("a",), ("z",), ("z",), (None,)], "object_id string")
    found, missing = multi_get(docs, keys)
    assert [r["v"] for r in found.collect()] == [1]
    assert [r[0] for r in missing.collect()] == ["z"]

    pages = spark.createDataFrame([("o", "p1", "1"), ("o", None, "2"), ("o", None, None), ("o", None, None)], ITEMS)
    again = spark.createDataFrame([("o", "p1", "1"), ("o", None, "2")], ITEMS)
    assert union_pages(again, pages).count() == 4
    assert exclude_jobs(spark.createDataFrame([("o", "h/job.1", "1"), ("o", None, "2"), ("o", "job.1", "3")], ITEMS)).count() == 2


@pytest.fixture
def eight_ranges(spark):
    """Ranges that adaptive execution doesn't join again, as the rows here are few."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("time", [None, 77])
def test_items_of_one_moment_or_none_are_spread(spark, eight_ranges, time):
    """A task ranks and sorts one block: here an eighth of a stream whose times say nothing."""
    events = [("s", time, f"{k:05}") for k in range(4_000)] + [("t", k, str(k)) for k in range(30)]
    df = spark.createDataFrame(events, EVENTS).repartition(3)
    sizes = range_blocks(df, "stream_id", [F.col("timestamp"), F.col("object_id")], "items").groupBy("_block").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 4_030 / 8
    jobs = spark.createDataFrame([("j", "s"), ("k", "t"), ("l", None)], "object_id string, stream_id string")
    out = fan_out_stream(jobs, df).collect()
    seqs = sorted((r["seq"], r["item_object_id"]) for r in out if r["object_id"] == "j")
    assert seqs == [(i, f"{i - 1:05}") for i in range(1, 4_001)]
    assert sorted(r["seq"] for r in out if r["object_id"] == "k") == list(range(1, 31))


def test_items_of_equal_order_are_spread_by_what_they_hold(spark, eight_ranges):
    df = spark.range(4_000).selectExpr("'s' AS stream_id", "5L AS timestamp", "'same' AS object_id", "id", "map('k', id) AS props")
    sizes = range_blocks(df, "stream_id", [F.col("timestamp"), F.col("object_id")], "items").groupBy("_block").count().collect()
    assert max(r["count"] for r in sizes) < 2 * 4_000 / 8
    jobs = spark.createDataFrame([("j", "s")], "object_id string, stream_id string")
    assert sorted(r["seq"] for r in fan_out_stream(jobs, df).collect()) == list(range(1, 4_001))


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_items_without_an_id_are_spread_and_stay_in_place(spark, digits):
    rows = [("o", None, None, i) for i in range(2_000)] + [("o", f"k{i}", None, i) for i in range(500)]
    items = spark.createDataFrame(rows, ITEMS + ", v int").repartition(3)
    if digits:
        blocks = hash_blocks(with_item_id(items), digits, items.columns).groupBy("_block").count()
        assert blocks.agg(F.max("count")).first()[0] < 3 * 2_500 / 16**digits + 20
    jobs = spark.createDataFrame([("j", "o")], "object_id string, collection_owner string")
    out = sorted((r["seq"], r["item_id"]) for r in fan_out_collection(jobs, items, digits).collect())
    ids = sorted((r[1] or "unknown" for r in rows), key=lambda i: (md5(i.encode()).hexdigest(), i))
    assert out == list(enumerate(ids, 1))
