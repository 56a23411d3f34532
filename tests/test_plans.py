"""What the optimizer makes of the operators: pruning, pushdown, no hot task."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from rowloom.operators.fanout import fan_out_collection, fan_out_stream
from rowloom.plans.catalog import QUERIES
from rowloom.operators.progress import job_progress
from rowloom.operators.rollup import job_counts
from rowloom.session import scratch_path
from rowloom.sources.collections import exclude_jobs, scan_collection
from rowloom.sources.layout import of_jobs, read_clustered, write_clustered

SF_DIR = "/root/testdata/sf0.001"


def plan(df, what="executedPlan"):
    return re.sub(r"#\d+L?", "", getattr(df._jdf.queryExecution(), what)().toString())


@pytest.fixture(scope="module")
def items(spark):
    path = scratch_path(spark, "items")
    rows = [(f"o{i % 5}", f"o{i % 5}.{i}", str(i), i, "x" * 20) for i in range(200)]
    df = spark.createDataFrame(rows, "owner string, pk string, object_id string, size int, text string")
    df.write.partitionBy("owner").parquet(path + "/by_owner")
    df.write.parquet(path + "/plain")
    return path


def test_collection_filter_reaches_the_scan(spark, items):
    plain = plan(scan_collection(spark.read.parquet(items + "/plain"), "o1").select("object_id"))
    assert "EqualTo(owner,o1)" in plain
    assert "ReadSchema: struct<owner:string,object_id:string>" in plain
    parted = plan(scan_collection(spark.read.parquet(items + "/by_owner"), "o1").select("object_id"))
    assert "PartitionFilters: [isnotnull(owner), (owner = o1)]" in parted
    assert "ReadSchema: struct<object_id:string>" in parted


def test_fan_out_prunes_partitions_of_owners_without_jobs(spark, items):
    jobs = spark.createDataFrame([("j", "o1")], "object_id string, collection_owner string")
    out = fan_out_collection(jobs, exclude_jobs(spark.read.parquet(items + "/by_owner")))
    shown = plan(out)
    assert "dynamicpruning" in shown.lower()
    assert out.count() == 40


def test_fan_out_ranks_rows_by_block_not_by_owner(spark, items):
    jobs = spark.createDataFrame([("j", "o1")], "object_id string, collection_owner string")
    # even when the rows already lie by owner
    lying = spark.read.parquet(items + "/plain").repartition(4, "owner")
    shown = plan(fan_out_collection(jobs, lying).select("seq", "n", "item_id"))
    for window in re.findall(r"Window \[row_number.*", shown):
        assert "windowspecdefinition(owner, _block" in window
    assert "Exchange hashpartitioning(owner, _block" in shown


def test_stream_limit_works_before_each_shuffle(spark, items):
    events = spark.read.parquet(items + "/plain").selectExpr("owner stream_id", "cast(size as bigint) timestamp", "object_id")
    jobs = spark.createDataFrame([("j", "o1")], "object_id string, stream_id string")
    shown = plan(fan_out_stream(jobs, events, limit=20_000))
    limits = re.findall(r"WindowGroupLimit \[(.*?)\].*(Partial|Final)", shown)
    assert limits == [("stream_id", "Final"), ("stream_id", "Partial"), ("stream_id, _slice", "Final"), ("stream_id, _slice", "Partial")]
    # between the scan and the first limit there is no exchange of the events
    below = shown.split("WindowGroupLimit [stream_id, _slice]")[-1].split("FileScan")[0]
    assert "Exchange" not in below.split("BroadcastExchange")[0]


def test_running_counters_never_cover_a_whole_job(spark):
    df = spark.createDataFrame([("a", 1, True)], "job_id string, seq bigint, success boolean")
    shown = plan(job_progress(df.repartition(2, "job_id")))
    rows_window = [w for w in re.findall(r"Window \[.*", shown) if "seq ASC" in w]
    assert rows_window and all("windowspecdefinition(job_id, _block" in w for w in rows_window)
    assert "Exchange hashpartitioning(job_id, _block" in shown


def test_counts_read_two_columns_and_fold_before_the_shuffle(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    receipts = events.select("*", F.col("event_type").alias("job_id"), (F.col("value") > 50).alias("success"))
    shown = plan(job_counts(receipts))
    assert "ReadSchema: struct<event_type:string,value:double>" in shown
    assert "partial_count" in shown


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_query_compares_all_pairs(spark, name):
    shown = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown


def test_a_run_reads_its_items_twice_and_its_labels_once(spark):
    shown = plan(QUERIES["label_run"](spark, SF_DIR))
    assert shown.count("labels.parquet") == 1
    # twice for the items; the jobs of this query are derived from the same table
    assert shown.count("documents.parquet") <= 4


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty owners, one of which holds a third of all items, in many small row groups."""
    path = scratch_path(spark, "clustered")
    owner = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 40))
    items = spark.range(60_000).select(owner.alias("owner"), F.col("id").alias("timestamp"), F.uuid().alias("text"))
    write_clustered(items.repartition(7), path, sort=("timestamp",), folders=8, row_group=64 << 10)
    return path


def scanned(df):
    """Files and rows that the scans of a query read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = [0, 0]

    def walk(node):
        if node.nodeName().startswith("Scan parquet") or "FileScan" in node.getClass().getSimpleName() or "FileSourceScan" in node.getClass().getSimpleName():
            found[0] += node.metrics().apply("numFiles").value()
            found[1] += node.metrics().apply("numOutputRows").value()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.finalPhysicalPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            walk(node.plan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return found


def test_a_clustered_read_opens_one_folder_and_few_row_groups(spark, clustered):
    every = len(spark.read.parquet(clustered).inputFiles())
    one = read_clustered(spark, clustered, ["o7"], folders=8)
    shown = plan(one)
    assert re.search(r"PartitionFilters: \[[^]]*__folder__", shown) and "PushedFilters: [IsNotNull(owner), EqualTo(owner,o7)]" in shown
    files, rows = scanned(one)
    assert one.count() == 1_000 and files < every / 2
    part = read_clustered(spark, clustered, ["hot"], folders=8).filter("timestamp BETWEEN 30000 AND 30300")
    files, rows = scanned(part)
    assert part.count() == 101 and rows < 8_000  # of 20,000 items of this owner


def test_folders_are_pruned_by_the_jobs_of_a_query(spark, clustered):
    jobs = spark.createDataFrame([("j", "o7"), ("k", "nobody")], "job string, wanted string")
    found = of_jobs(spark.read.parquet(clustered), jobs, "wanted", folders=8)
    assert found.count() == 1_000 and "dynamicpruning" in plan(found).lower()
