"""Triggers: actions started by stream events, new files and changed documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowloom.functions.inputs import fields_of, map_params, map_params_column
from rowloom.operators.actions import Action, dispatch_actions, run_action
from rowloom.sources.files import file_selected
from rowloom.sources.streams import stream_events


def stream_trigger(
    events: DataFrame,
    action: Action,
    in_map: Sequence[Mapping[str, str]],
    out_map: Sequence[Mapping[str, str]],
    data: str = "data",
    stream_id: str | None = None,
    etype: str | None = None,
) -> DataFrame:
    """For each event: map its fields in, run the action, map its outputs out.

    Keeps the event's columns and adds ``result`` and ``mapped``. Row by row and
    stateless, so it serves a table and a ``readStream`` source alike.
    """
    chosen = stream_events(events, stream_id, etype)
    bound = chosen.withColumn("inputs", map_params(F.col(data), in_map))
    done = run_action(bound, action)
    outputs = F.coalesce(F.col("result.outputs"), F.create_map().cast("map<string,string>"))
    return done.withColumn("mapped", F.when(F.col("result.success"), map_params(outputs, out_map))).drop("inputs")


def stream_triggers(
    events: DataFrame,
    triggers: DataFrame,
    registries: Mapping[str, Mapping[str, Action]],
    data: str = "data",
) -> DataFrame:
    """All triggers at once: ``triggers`` has a row per trigger with its stream as
    ``owner``, ``action_id``, ``in_map`` and ``out_map``
    (``array<struct<src,dest,static>>``).

    One row per (event, trigger) with ``trigger_id``, ``result`` and ``mapped``. The
    triggers are a table of records, so a stream joins them as its static side.
    """
    side = triggers.select(
        F.col("object_id").alias("trigger_id"), F.col("owner").alias("stream_id"), "action_id", "in_map", "out_map"
    )
    bound = events.join(side, "stream_id").withColumn("inputs", map_params_column(F.col(data), F.col("in_map")))
    done = dispatch_actions(bound, registries)
    outputs = F.coalesce(F.col("result.outputs"), F.create_map().cast("map<string,string>"))
    mapped = F.when(F.col("result.success"), map_params_column(outputs, F.col("out_map")))
    return done.withColumn("mapped", mapped).drop("inputs", "in_map", "out_map")


def file_trigger(
    files: DataFrame,
    action: Action,
    prefix: str,
    patterns: Sequence[str] = (),
    recursive: bool = False,
    values: Mapping[str, Column] | None = None,
    key: Column | None = None,
    columns: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Run an action with fixed parameters on each file that is selected.

    ``files`` is a batch or streaming ``binaryFile`` source; the file's key is added
    to the inputs as ``key``. ``columns`` gives a native action typed inputs, such as the
    file's bytes; ``content`` is read only if one asks for it.
    """
    at = key if key is not None else F.col("path")
    chosen = files.filter(file_selected(at, prefix, patterns, recursive))
    bound = chosen.withColumn("inputs", fields_of({**(values or {}), "key": at}))
    return run_action(bound, action, columns=columns).drop("inputs")


def read_new_binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Streaming source of whole files."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def collection_changes(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Documents that are in both versions and differ in any compared column.

    Comparison is typed and null-safe: times to the microsecond, maps as sets of entries, not a
    number equal to itself, and zero to minus zero. Each side is first reduced to its key and a
    digest of the compared columns, so the shuffle carries neither old texts nor columns that
    are only compared; a digest of 256 bits stands for the row.
    """
    compared = list(columns) if columns else [c for c in new.columns if c != key]
    before = old.select(key, _digest(old, compared).alias("_before"))
    after = new.withColumn("_after", _digest(new, compared))
    return (
        after.join(before, key)
        .filter(F.col("_after") != F.col("_before"))
        .drop("_after", "_before")
    )


def _digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """Digest of typed values as JSON, in which nulls, texts and numbers are told apart."""
    values = [_plain(F.col(c), df.schema[c].dataType).alias(f"c{k}") for k, c in enumerate(columns)]
    return F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)


def _needs_care(kind: T.DataType) -> bool:
    """Whether JSON would lose what a value of this type holds, at any depth."""
    if isinstance(kind, T.ArrayType):
        return _needs_care(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_needs_care(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.TimestampType, T.TimestampNTZType, T.DoubleType, T.FloatType))


def _plain(value: Column, kind: T.DataType) -> Column:
    """``value`` with only such types inside as JSON writes out whole."""
    if not _needs_care(kind):
        return value
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), value).cast("timestamp"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value), F.lit("NaN")).otherwise((value + F.lit(0.0).cast(kind)).cast("string"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(
            _plain(e["key"], kind.keyType).alias("key"), _plain(e["value"], kind.valueType).alias("value")
        )
        # entries as texts: a text can be sorted whatever is inside
        written = lambda e: F.to_json(entry(e), {"ignoreNullFields": "false"})
        return F.sort_array(F.transform(F.map_entries(value), written))
    fields = [_plain(value[f.name], f.dataType).alias(f.name) for f in kind]
    return F.when(value.isNotNull(), F.struct(*fields))
