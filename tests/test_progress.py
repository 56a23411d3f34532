import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import progress as thin
from rowloom.operators.progress import job_progress, percent_of, thin_progress


def test_percent_is_double_arithmetic(spark):
    rows = spark.sql("select i, n from (select explode(sequence(1, 120)) n) lateral view explode(sequence(1, n)) as i")
    for row in rows.withColumn("p", percent_of(F.col("i"), F.col("n"))).collect():
        assert row["p"] == int((row["i"] / row["n"]) * 100)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_job_progress_in_blocks(spark, block):
    random.seed(block)
    rows = [(f"j{j}", seq, random.random() < 0.6) for j, n in enumerate((1, 7, 50)) for seq in range(1, n + 1)]
    random.shuffle(rows)
    got = job_progress(spark.createDataFrame(rows, "job_id string, seq bigint, success boolean"), block)
    expected = {}
    for job in ("j0", "j1", "j2"):
        mine, good = sorted(r for r in rows if r[0] == job), 0
        for done, (_j, seq, ok) in enumerate(mine, 1):
            good += ok
            expected[job, seq] = (good, done - good, int(done / len(mine) * 100), len(mine))
    found = {(r["job_id"], r["seq"]): (r["success_count"], r["error_count"], r["percent"], r["n"]) for r in got.collect()}
    assert found == expected


def sequential(rows, started, interval):
    kept, last_percent, last_time = [], 0, started
    for seq, at, percent in rows:
        if percent != last_percent or at - last_time >= interval:
            kept.append(seq)
            last_percent, last_time = percent, at
    return kept


@pytest.mark.parametrize("seed", range(6))
def test_thin_progress_equals_sequential_loop(spark, seed):
    random.seed(seed)
    interval, span = 60, random.choice([61, 150, 700, 100_000])
    table, expected = [], set()
    for job in range(8):
        n = random.choice([1, 5, 40, 300, 900])
        at = started = random.randrange(0, 5_000)
        step = random.choice([1, 7, 40, 200])
        rows = []
        for seq in range(1, n + 1):
            at += random.choice([0, 0, 1, random.randrange(step + 1), random.randrange(3 * step + 1)])
            rows.append((seq, at, int(seq / n * 100)))
        expected |= {(f"j{job}", seq) for seq in sequential(rows, started, interval)}
        table += [(f"j{job}", seq, n, p, t, started) for seq, t, p in rows]
    df = spark.createDataFrame(table, "job_id string, seq bigint, n bigint, percent int, timestamp bigint, started_at bigint")
    kept = thin_progress(df, interval_ms=interval, span_ms=span).select("job_id", "seq").collect()
    assert len(kept) == len(expected)
    assert {(r["job_id"], r["seq"]) for r in kept} == expected


PROGRESS = "job_id string, seq bigint, n bigint, percent int, timestamp bigint, started_at bigint"


def test_step_functions_compose_to_that_of_the_whole():
    draw = random.Random(4)
    for _ in range(300):
        interval, width = draw.randint(2, 30), draw.randint(30, 90)
        times = np.array(sorted(draw.sample(range(width * 4), draw.randint(1, 120))))
        parts = [times[(times >= k * width) & (times < (k + 1) * width)] for k in range(4)]
        steps = [thin._exits(p, k * width, interval) for k, p in enumerate(parts) if len(p)]
        left, right = steps[0], steps[-1]
        for other in steps[1:]:
            left = thin._then(left, other)
        for other in reversed(steps[:-1]):
            right = thin._then(other, right)
        for x in range(-40, 0):
            kept = thin._kept(times, x, interval)
            want = times[kept[-1]] if kept else x
            assert thin._step(*left, np.array([x]))[0] == want == thin._step(*right, np.array([x]))[0]


def test_a_long_chain_is_never_one_group(spark):
    """One job on one percent for 3,000 spans: no row holds more than one span or two step functions."""
    interval, width, draw = 60, 200, random.Random(8)
    times = sorted(draw.sample(range(600_000), 30_000))
    rows = [("j", seq, 10**9, 0, at, 0) for seq, at in enumerate(times, 1)]
    df = spark.createDataFrame(rows, PROGRESS)
    spans = thin.materialise(thin._spans(df, interval, width), "spans")
    assert spans.count() > 2_900 and spans.selectExpr("max(size(times))").first()[0] <= width
    nodes = spans.selectExpr("job_id", "percent", "node", "array(1L) AS bounds", "array(1L) AS exits")
    pairs = thin._pairs(nodes)
    assert pairs.count() <= spans.count() // 2 + 1
    assert nodes.groupBy("job_id", "percent", F.floor(F.col("node") / 2)).count().agg(F.max("count")).first()[0] <= 2
    kept = [r["seq"] for r in thin_progress(df, interval, width).select("seq").collect()]
    assert sorted(kept) == sequential([(seq, at, 0) for _, seq, _, _, at, _ in rows], 0, interval)
