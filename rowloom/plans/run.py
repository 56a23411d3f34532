"""Whole runs: from a table of jobs to receipts, write-backs and final job rows."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.ids import receipt_stream_id, stream_item_id
from rowloom.functions.inputs import bind_inputs, fields_of
from rowloom.operators.actions import Action, build_receipts, dispatch_actions, known_actions, run_action
from rowloom.operators.fanout import fan_out_collection, fan_out_files, fan_out_stream
from rowloom.operators.outputs import shred, variant_outputs
from rowloom.operators.jobs import resolve_jobs, split_cancelled, validate_jobs
from rowloom.operators.progress import job_progress
from rowloom.operators.rollup import finish_jobs, job_counts
from rowloom.operators.updates import update_back
from rowloom.schemas import MAPPINGS, SINGLETON
from rowloom.session import materialise
from rowloom.sinks.commits import Conflict
from rowloom.sinks.documents import read_documents, snapshot, upsert_into
from rowloom.sinks.receipts import commit_receipts, stage_receipts
from rowloom.sources.collections import exclude_jobs, with_item_id

log = logging.getLogger(__name__)

CARRIED = ("job_id", "action_id", "hostname", "username")


def _job_columns(jobs: DataFrame) -> list[Column]:
    return [
        F.col("object_id").alias("job_id"),
        receipt_stream_id(F.col("hostname"), F.col("username"), F.col("object_id")).alias("receipt_stream"),
        F.col("hostname"),
        F.col("username"),
        F.col("input_data"),
        (F.col("action_id") if "action_id" in jobs.columns else F.lit(None).cast("string")).alias("action_id"),
    ]


def _document() -> list[Column]:
    """An item's fields: its typed keys where they are set, under its open fields."""
    pk = F.when(F.col("item_pk").isNotNull(), fields_of({"pk": F.col("item_pk")}))
    return [fields_of({"owner": F.col("item_owner")}), pk, F.col("item_fields")]


def _spread(work: DataFrame) -> DataFrame:
    """Even out work before actions run. The items of one stream or one file list
    come out of one task; actions on them should not stay there. (Items of a
    collection are already spread over its slices.)"""
    return work.repartition("job_id", "seq")


def collection_work(jobs: DataFrame, items: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    wanted = jobs.filter(F.col("job_type") == "run_on_collection").select("collection_owner", *_job_columns(jobs))
    rows = fan_out_collection(wanted, exclude_jobs(items), counted=None if counted is None else exclude_jobs(counted))
    return rows.select(
        *CARRIED, F.col("receipt_stream").alias("stream_id"), "seq", "n", "item_id",
        bind_inputs(F.col("input_data"), _document(), {"object_id": F.col("item_id")}).alias("inputs"),
    )


def stream_work(jobs: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    wanted = jobs.filter(F.col("job_type") == "run_on_stream").select("stream_id", *_job_columns(jobs))
    rows = fan_out_stream(wanted, events, limit)
    at, source = F.col("item_timestamp"), F.col("stream_id")
    bound = bind_inputs(F.col("input_data"), F.col("item_fields"), {"stream_id": source, "timestamp": at})
    return _spread(
        rows.select(
            *CARRIED, F.col("receipt_stream").alias("stream_id"), "seq", "n",
            stream_item_id(source, at).alias("item_id"), bound.alias("inputs"),
        )
    )


def single_work(jobs: DataFrame) -> DataFrame:
    """Jobs that run once, on their own input; the job id is one of the inputs."""
    wanted = jobs.filter(F.col("job_type") == SINGLETON).select(*_job_columns(jobs))
    return wanted.select(
        *CARRIED, F.col("receipt_stream").alias("stream_id"), F.lit(1).cast("bigint").alias("seq"),
        F.lit(1).cast("bigint").alias("n"), F.col("job_id").alias("item_id"),
        bind_inputs(F.col("input_data"), F.lit(None).cast("map<string,string>"), {"job_id": F.col("job_id")}).alias("inputs"),
    )


def file_work(jobs: DataFrame) -> DataFrame:
    wanted = jobs.filter(F.col("job_type") == "run_on_files").select("file_keys", "prefix", *_job_columns(jobs))
    rows = fan_out_files(wanted)
    system = {
        "key": F.col("key"), "src_key": F.col("key"), "filename": F.col("filename"),
        "prefix": F.coalesce(F.col("prefix"), F.lit("")),
    }
    return _spread(
        rows.select(
            *CARRIED, F.col("receipt_stream").alias("stream_id"), "seq", "n", F.col("key").alias("item_id"),
            bind_inputs(F.col("input_data"), F.lit(None).cast("map<string,string>"), system).alias("inputs"),
        )
    )


@dataclass
class Run:
    """What a run leaves: ``receipts`` and ``results`` are stored tables, the rest
    are plans over them."""

    jobs: DataFrame
    rejected: DataFrame
    receipts: DataFrame
    items_version: int | None = None

    def typed(self, action: Action) -> DataFrame:
        """Receipts of one action that declares its outputs, with a typed column for each."""
        return shred(self.receipts.filter(F.col("action_id") == action.action_id), action.outputs).drop("typed", "outputs")

    @property
    def counts(self) -> DataFrame:
        return job_counts(self.receipts)

    @property
    def progress(self) -> DataFrame:
        return job_progress(self.receipts)

    def updated_items(self, items: DataFrame, mappings: DataFrame) -> DataFrame:
        """Items with outputs written back; ``mappings`` is (object_id, mappings) per job, or
        (object_id, source, target) as ``derive_mappings`` gives. Collections only."""
        if "mappings" not in mappings.columns:
            pairs = F.sort_array(F.collect_list(F.struct("source", "target")))  # a script's links
            mappings = mappings.groupBy("object_id").agg(pairs.cast(MAPPINGS).alias("mappings"))
        good = self.receipts.filter(F.col("success") & F.col("outputs").isNotNull())
        planned = good.join(mappings.withColumnRenamed("object_id", "job_id"), "job_id").select(
            F.col("object_id").alias("item_id"), "outputs", "mappings",
            F.struct("timestamp", "job_id").alias("completed_at"),
        )
        return update_back(with_item_id(items), planned)

    def write_back(self, mappings: DataFrame, root: str, retries: int = 5) -> int:
        """Save the outputs of succeeded items onto their documents in the store under ``root``,
        keyed by ``item_id``; the store's version.

        Only documents that get an output are written, on top of what the store holds by now: if
        another writer comes first, its fields are read again and ours set on them.
        """
        spark = self.receipts.sparkSession
        while True:
            base = snapshot(spark, root)
            changed = self.updated_items(base.read(spark).drop("item_id"), mappings).filter("updated").drop("updated")
            try:
                return upsert_into(changed, root, "item_id", base=base)
            except Conflict:
                if not retries:
                    raise
                retries -= 1


def store_items(items: DataFrame, root: str) -> int:
    """Keep items by their id, as ``run_jobs`` reads and writes them; the store's version."""
    return upsert_into(with_item_id(items), root, "item_id")


def _declared(action: Action | Mapping[str, Mapping[str, Action]]) -> dict[str, Mapping[str, str]]:
    """Declared outputs by action id."""
    known = {action.action_id: action} if isinstance(action, Action) else known_actions(action)
    return {name: one.outputs for name, one in known.items() if one.outputs}


def _stored(receipts: DataFrame, once: Column, path: str | None, run_id: str | None) -> DataFrame:
    """Receipts, computed and written once: in the table at ``path`` where one is given. Those of
    jobs that run once stand aside there."""
    if path is None:
        return materialise(receipts, "receipts")
    spark = receipts.sparkSession
    try:
        staged = stage_receipts(receipts, path, aside=once)
        commit_receipts(spark, staged, run_id)
    except Exception as error:  # keeping receipts never fails a run, its work does
        log.warning("receipts were not written to %s: %s", path, error)
        return materialise(receipts, "receipts")
    return staged.read(spark)


def run_jobs(
    jobs: DataFrame,
    action: Action | Mapping[str, Mapping[str, Action]],
    clock_ms: int,
    items: DataFrame | None = None,
    events: DataFrame | None = None,
    forced_type: str | None = None,
    limit: int | None = None,
    collection_owner: str | None = None,
    stream_id: str | None = None,
    receipts_path: str | None = None,
    run_id: str | None = None,
    items_root: str | None = None,
    mappings: DataFrame | None = None,
) -> Run:
    """Run an action over everything the jobs point at: one action for all jobs, or
    registries from which every job picks by its ``action_id``.

    Actions may have side effects and must run once per item, so receipts are
    written to the shared folder before anything branches off them. hostname and username
    of the job reach actions that declare them. A job whose kind of source was not given
    is rejected. With ``receipts_path`` they are written to that table of receipts at once, where
    a run of the same ``run_id`` replaces what it left before; only if that fails, elsewhere.

    ``items_root`` names a store of items (``store_items``) to run over; with ``mappings`` (as for
    ``Run.updated_items``) the outputs are saved onto its items before this returns.
    """
    if items_root is not None:
        items = read_documents(jobs.sparkSession, items_root).drop("item_id")
    run = _run(jobs, action, clock_ms, items, events, forced_type, limit, collection_owner, stream_id, receipts_path, run_id)
    if items_root is not None and mappings is not None:
        run.items_version = run.write_back(mappings, items_root)
    return run


def _run(
    jobs: DataFrame,
    action: Action | Mapping[str, Mapping[str, Action]],
    clock_ms: int,
    items: DataFrame | None,
    events: DataFrame | None,
    forced_type: str | None,
    limit: int | None,
    collection_owner: str | None,
    stream_id: str | None,
    receipts_path: str | None,
    run_id: str | None,
) -> Run:
    """``run_jobs`` without the write-back.
    """
    checked = validate_jobs(resolve_jobs(jobs, forced_type, collection_owner, stream_id))
    for kind, source in (("run_on_collection", items), ("run_on_stream", events)):
        if source is None:
            missing = (F.col("job_type") == kind) & F.col("reject_reason").isNull()
            reason = F.when(missing, f"no items were given for {kind}").otherwise(F.col("reject_reason"))
            checked = checked.withColumn("reject_reason", reason)
    rejected = checked.filter(F.col("reject_reason").isNotNull())
    valid, cancelled = split_cancelled(checked.filter(F.col("reject_reason").isNull()))

    parts: Sequence[tuple[str, DataFrame | None]] = [
        ("run_on_collection", collection_work(valid, items) if items is not None else None),
        ("run_on_stream", stream_work(valid, events, limit) if events is not None else None),
        ("run_on_files", file_work(valid) if "file_keys" in jobs.columns else None),
        (SINGLETON, single_work(valid)),
    ]
    work = reduce(
        DataFrame.unionByName,
        [part.withColumn("job_type", F.lit(kind)) for kind, part in parts if part is not None],
    )
    run = run_action if isinstance(action, Action) else dispatch_actions
    results = run(work, action, hostname=F.col("hostname"), username=F.col("username"))
    keep = ("job_id", "job_type", "stream_id", "seq")
    declared = _declared(action)
    if declared:
        ran = F.lit(action.action_id) if isinstance(action, Action) else F.col("action_id")
        outputs = F.when(F.col("result.success"), F.col("result.outputs"))
        results = results.withColumn("action_id", ran).withColumn("typed", variant_outputs(outputs, ran, declared))
        keep += ("action_id", "typed")
    once = F.col("job_type") == SINGLETON
    stored = _stored(build_receipts(results, F.lit(clock_ms), keep), once, receipts_path, run_id)
    receipts = stored.filter(~once).drop("job_type")

    final = finish_jobs(valid.filter(~once), job_counts(receipts))
    singles = stored.filter(once).select(
        F.col("job_id").alias("object_id"), "job_type",
        F.when(F.col("success"), "SUCCEEDED").otherwise("FAILED").alias("status"),
        "error_message", F.lit(100).alias("percent"),
        F.col("success").cast("int").cast("bigint").alias("success_count"),
        (~F.col("success")).cast("int").cast("bigint").alias("error_count"),
    )
    stopped = cancelled.select(
        "object_id", "job_type", "status", "error_message",
        *[
            (F.col(c) if c in cancelled.columns else F.lit(None)).cast(kind).alias(c)
            for c, kind in (("percent", "int"), ("success_count", "bigint"), ("error_count", "bigint"))
        ],
    )
    return Run(jobs=final.unionByName(singles).unionByName(stopped), rejected=rejected, receipts=receipts)
