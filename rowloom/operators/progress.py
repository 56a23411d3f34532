"""Progress of jobs: running counters, percent, and which rows to keep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowloom.session import materialise

BLOCK_ROWS = 1_000_000
SAVE_INTERVAL_MS = 60_000
SPAN_MS = 3_600_000


def percent_of(done: Column, total: Column) -> Column:
    """``int((done / total) * 100)`` in double arithmetic, in that order of steps.

    Integer arithmetic would differ: 29 of 50 is 57 here, not 58.
    """
    return F.floor((done.cast("double") / total.cast("double")) * F.lit(100.0)).cast("int")


def job_progress(receipts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """After each item: running counters and percent. Needs job_id, seq and success.

    A running sum over a job would put the whole job in one task. ``seq`` counts the
    items of a job, so blocks of it have a bounded size: counters run inside a block
    and start from the totals of the blocks before it. The totals table has one row
    per block, and the block is also the key of the join, so no key is hot.
    """
    blocked = receipts.withColumn("_block", F.floor((F.col("seq") - 1) / block_rows))
    totals = blocked.groupBy("job_id", "_block").agg(
        F.count_if(F.col("success")).alias("_good"), F.count(F.lit(1)).alias("_rows")
    )
    whole = Window.partitionBy("job_id")
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "job_id",
        "_block",
        F.coalesce(F.sum("_good").over(earlier), F.lit(0)).alias("_good_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    inside = Window.partitionBy("job_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        blocked.withColumn("_good_here", F.count_if(F.col("success")).over(inside))
        .withColumn("_rows_here", F.count(F.lit(1)).over(inside))
        .join(totals, ["job_id", "_block"])
    )
    done = F.col("_rows_before") + F.col("_rows_here")
    good = F.col("_good_before") + F.col("_good_here")
    return counted.select(
        *receipts.columns,
        "n",
        good.alias("success_count"),
        (done - good).alias("error_count"),
        percent_of(done, F.col("n")).alias("percent"),
    )


def _exits(times: np.ndarray, base: int, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """What a span does to a chain, as a step function of the time ``x`` kept last before it.

    (bounds, values): the last time kept inside is that of the first bound >= x; beyond the
    last bound nothing is kept and x stays. As x lies before ``base``, a chain enters within
    one interval of it, so only times up to there can be entries. Both arrays ascend.
    """
    entry = np.arange(min(np.searchsorted(times, base + interval) + 1, len(times)))
    follow, last = np.searchsorted(times, times + interval), entry
    while (inside := follow[last] < len(times)).any():
        last = np.where(inside, follow[last], last)
    bounds, values = times[entry] - interval, times[last]
    turns = np.append(values[1:] != values[:-1], True)
    return bounds[turns], values[turns]


def _step(bounds: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(bounds, x)
    return np.where(at < len(bounds), np.append(values, 0)[at], x)


def _then(first: tuple, second: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two neighbouring spans, from theirs; this is associative."""
    (bounds, values), (more_bounds, more_values) = first, second
    later = more_bounds > (bounds[-1] if len(bounds) else -np.inf)
    bounds = np.concatenate([bounds, more_bounds[later]])
    values = np.concatenate([_step(more_bounds, more_values, values), more_values[later]])
    turns = np.append(values[1:] != values[:-1], True)
    return bounds[turns], values[turns]


def _kept(times: np.ndarray, x: int, interval: int) -> list[int]:
    """Places of the times kept in a span that is entered with ``x`` kept last."""
    kept, at = [], int(np.searchsorted(times, x + interval))
    while at < len(times):
        kept.append(at)
        at = int(np.searchsorted(times, times[at] + interval))
    return kept


STEPS = "bounds array<bigint>, exits array<bigint>"


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, np.int64) if x is not None else None for x in column.to_numpy(zero_copy_only=False)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _each_batch(df: DataFrame, schema: str, keep: tuple[str, ...], make) -> DataFrame:
    """Row by row: columns ``keep`` of ``df`` and those that ``make(batch)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + list(made.values()), names=[*keep, *made]
            )

    return df.mapInArrow(run, schema)


def _spans(progress: DataFrame, interval: int, width: int) -> DataFrame:
    """Chains that last an interval or more, a row per span of them: its distinct times in
    order and the first row of each (``times``, ``seqs``), the chain's ``start`` and ends, and
    the span's number in the chain as ``node``."""
    chains = (
        progress.groupBy("job_id", "percent")
        .agg(F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to"), F.min("started_at").alias("_at"))
        .withColumn("start", F.when(F.col("percent") == 0, F.col("_at")).otherwise(F.col("_from")))
        .filter(F.col("_to") - F.col("start") >= interval)
        .select(
            "job_id", "percent", "start",
            F.floor(F.col("_from") / width).alias("first"), F.floor(F.col("_to") / width).alias("last"),
        )
    )
    steps = progress.groupBy("job_id", "percent", "timestamp").agg(F.min("seq").alias("seq"))
    return (
        steps.join(chains, ["job_id", "percent"])
        .groupBy("job_id", "percent", "start", "first", "last", F.floor(F.col("timestamp") / width).alias("span"))
        .agg(F.sort_array(F.collect_list(F.struct("timestamp", "seq"))).alias("_steps"))
        .select(
            "job_id", "percent", "start", "first", "last", "span", (F.col("span") - F.col("first")).alias("node"),
            F.col("_steps.timestamp").alias("times"), F.col("_steps.seq").alias("seqs"),
        )
    )


def _pairs(nodes: DataFrame) -> DataFrame:
    """Neighbouring nodes side by side, one or both of them: a row per node of the next level."""
    side = lambda odd: F.max(F.when(F.col("node") % 2 == odd, F.struct("bounds", "exits")))
    up = F.floor(F.col("node") / 2).alias("node")
    return nodes.groupBy("job_id", "percent", up).agg(side(0).alias("left"), side(1).alias("right"))


def _composed(pairs: DataFrame) -> DataFrame:
    """The step function of each pair."""
    key = pairs.select("job_id", "percent", "node").schema

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        both = []
        for name in ("left", "right"):
            column = batch.column(name)
            both.append(list(zip(_arrays(column.field("bounds")), _arrays(column.field("exits")), column.is_valid().to_pylist(), strict=True)))
        made = []
        for (lb, le, left), (rb, re, right) in zip(*both, strict=True):
            made.append(_then((lb, le), (rb, re)) if left and right else (lb, le) if left else (rb, re))
        return {"bounds": _lists([m[0] for m in made]), "exits": _lists([m[1] for m in made])}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key) + ", " + STEPS
    return _each_batch(pairs, schema, ("job_id", "percent", "node"), make)


def _entered(spans: DataFrame, interval: int, width: int) -> DataFrame:
    """``before``: the time kept last before each span of chains that reach over several.

    A scan in rounds. Going up, neighbours are composed, pair by pair, until each chain is one
    node; going down, a node's left child begins with what the node begins with, and its right
    child with what the left one makes of that. A chain of n spans takes log2(n) rounds.
    """
    cut = spans.filter("first < last")
    rounds = int(cut.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0).bit_length()
    kinds = dict(spans.dtypes)
    head = f"job_id {kinds['job_id']}, percent {kinds['percent']}, node bigint"

    def summed(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lines = zip(_arrays(batch.column("times")), batch.column("span").to_pylist(), batch.column("start").to_pylist(), strict=True)
        # a chain's first span is entered with the chain's start, which may lie inside it
        made = [_exits(times, max(span * width, start + 1), interval) for times, span, start in lines]
        return {"bounds": _lists([m[0] for m in made]), "exits": _lists([m[1] for m in made])}

    nodes = _each_batch(cut.select("job_id", "percent", "node", "span", "start", "times"), f"{head}, {STEPS}", ("job_id", "percent", "node"), summed)
    levels = []
    for _round in range(rounds):
        levels.append(materialise(_pairs(nodes), "pairs"))
        nodes = _composed(levels[-1])
    begun = cut.filter("node = 0").select("job_id", "percent", "node", F.col("start").alias("before"))
    for pairs in reversed(levels):
        both = pairs.join(begun, ["job_id", "percent", "node"])
        fitting = F.filter(F.arrays_zip("left.bounds", "left.exits"), lambda step: step["bounds"] >= F.col("before"))
        after = F.coalesce(F.get(fitting, F.lit(0))["exits"], F.col("before"))
        child = F.array(
            F.when(F.col("left").isNotNull(), F.struct((F.col("node") * 2).alias("node"), "before")),
            F.when(F.col("right").isNotNull(), F.struct((F.col("node") * 2 + 1).alias("node"), after.alias("before"))),
        )
        begun = both.select("job_id", "percent", F.inline(F.filter(child, lambda c: c.isNotNull())))
    return begun


def thin_progress(
    progress: DataFrame, interval_ms: int = SAVE_INTERVAL_MS, span_ms: int = SPAN_MS
) -> DataFrame:
    """Keep a row if its percent differs from the last kept row's, or if the last
    kept row is ``interval_ms`` or more before it. A job starts at percent 0 and
    ``started_at`` (ms). Time must not run backwards along ``seq``.

    The rule looks back to the last *kept* row, so it is a chain. It is cut where
    that is exact:

    * The last kept percent is always the previous row's percent. A change of
      percent thus follows from seq and n alone, and starts a new chain.
    * Of rows with one time and percent only the first can be kept; the others drop
      before the shuffle. A chain shorter than the interval keeps nothing more.
    * A chain inside one span of time is folded alone. In a longer one each span is a
      monotone step function from the time kept last before it to the time kept last in
      it. These compose associatively, so what each span begins with comes from composing
      pairs in rounds; then each span is folded alone too.

    No row or group holds more than one span's distinct milliseconds, or two step functions.
    """
    previous = F.when(F.col("seq") > 1, percent_of(F.col("seq") - 1, F.col("n"))).otherwise(F.lit(0))
    spans = materialise(_spans(progress, interval_ms, span_ms), "spans")
    begun = spans.filter("first = last").withColumn("before", F.col("start"))
    scanned = spans.filter("first < last").join(_entered(spans, interval_ms, span_ms), ["job_id", "percent", "node"])
    every = begun.unionByName(scanned).select("job_id", "times", "seqs", "before")

    def fold(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lines = zip(_arrays(batch.column("times")), _arrays(batch.column("seqs")), batch.column("before").to_pylist(), strict=True)
        return {"seqs": _lists([seqs[_kept(times, x, interval_ms)] for times, seqs, x in lines])}

    kept = _each_batch(every, f"job_id {dict(progress.dtypes)['job_id']}, seqs array<bigint>", ("job_id",), fold)
    timed = kept.select("job_id", F.explode("seqs").alias("seq"), F.lit(True).alias("_timed"))
    return (
        progress.join(timed, ["job_id", "seq"], "left")
        .filter((F.col("percent") != previous) | F.col("_timed"))
        .select(*progress.columns)
    )
