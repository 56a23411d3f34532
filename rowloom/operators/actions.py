"""Actions: a declared function run on every row, with errors kept as data."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.inputs import fields_of, inject_context, project_params
from rowloom.functions.text import empty_to_null
from rowloom.operators.outputs import as_output, checked
from rowloom.schemas import FIELDS, RESULT


class ActionFailed(Exception):
    """Raised by a Python action to report a failure with a plain message."""


class Inputs:
    """The inputs of a native action: ``inputs["name"]`` is a column.

    Only declared names can be read, which projects the inputs without building a
    second map. hostname and username come from the context where the item has none.
    """

    def __init__(
        self, fields: Column, params: Sequence[str], accepts_any: bool, context: Mapping[str, Column],
        columns: Mapping[str, Column] | None = None,
    ):
        self.fields, self._params, self._any, self._context = fields, params, accepts_any, context
        self._columns = columns or {}

    def __getitem__(self, name: str) -> Column:
        if not self._any and name not in self._params:
            raise KeyError(f"{name} is not a declared parameter")
        value = F.try_element_at(self.fields, F.lit(name))
        if name in self._params and name in self._context:
            return F.when(self.has(name), value).otherwise(self._context[name])
        return value

    def column(self, name: str) -> Column:
        """A declared input that comes as a column of its own type, such as a file's bytes."""
        if name not in self._params:
            raise KeyError(f"{name} is not a declared parameter")
        return self._columns[name]

    def number(self, name: str) -> Column:
        """An input as a double; null where it is none, so that one bad value fails one item."""
        return self[name].try_cast("double")

    def has(self, name: str) -> Column:
        return F.map_contains_key(self.fields, name)


@dataclass(frozen=True)
class Action:
    """An action with its declared parameters.

    ``native`` builds a result column from ``Inputs`` (see ``succeed`` and ``fail``)
    and stays inside the JVM. ``python`` takes the inputs as keyword
    arguments and returns a mapping of outputs; it runs on Arrow batches. ``outputs`` declares
    tags for outputs; an item whose output isn't of its tag's type fails.
    """

    action_id: str
    params: tuple[str, ...] = ()
    native: Callable[[Inputs], Column] | None = None
    python: Callable[..., Mapping] | None = None
    accepts_any: bool = False
    primary_output: str = ""
    cost: float | None = None
    outputs: Mapping[str, str] | None = None

    def inputs(self, inputs: Column, hostname: Column | None = None, username: Column | None = None) -> Column:
        """The inputs map as the action gets it."""
        declared = F.array(*[F.lit(p) for p in self.params]).cast("array<string>")
        if hostname is not None and username is not None:
            inputs = inject_context(inputs, declared, hostname, username)
        return project_params(inputs, declared, self.accepts_any)

    def result(
        self, inputs: Column, hostname: Column | None = None, username: Column | None = None,
        columns: Mapping[str, Column] | None = None,
    ) -> Column:
        """Result column of a native action."""
        context = {}
        if hostname is not None and username is not None:
            context = {"hostname": empty_to_null(hostname), "username": username}
        return checked(self.native(Inputs(inputs, self.params, self.accepts_any, context, columns)), self.outputs)


def succeed(
    outputs: Mapping[str, Column] | None = None, primary: str = "", cost: float | None = None,
    types: Mapping[str, str] | None = None,
) -> Column:
    """A good result. ``types`` are the declared tags of outputs that aren't plain values."""
    outputs = {name: as_output(value, types[name]) if name in (types or {}) else value for name, value in (outputs or {}).items()}
    return F.struct(
        F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error_message"),
        fields_of(outputs or {}).alias("outputs"),
        F.lit(primary).alias("primary_output"),
        F.lit(cost).cast("double").alias("cost"),
    )


def fail(message: Column) -> Column:
    return F.struct(
        F.lit(False).alias("success"),
        message.alias("error_message"),
        F.lit(None).cast(FIELDS).alias("outputs"),
        F.lit("").alias("primary_output"),
        F.lit(None).cast("double").alias("cost"),
    )


def as_text(value) -> str | None:
    """An output as text that other tools can read: lists and mappings as JSON, bytes as base64."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    try:
        return json.dumps(value, default=lambda x: as_text(x) if isinstance(x, (bytes, bytearray)) else str(x))
    except (TypeError, ValueError, RecursionError):
        return str(value)


def _python_result(actions: Mapping[str, Action]):
    """One UDF for all Python actions. Only the inputs travel to Python; rows of
    other actions arrive as null and are passed over."""

    def call(action_id, inputs):
        if action_id is None:
            return False, None, None, "", None
        action = actions[action_id]
        try:
            outputs = action.python(**dict(inputs or {}))
            texts = {str(k): as_text(v) for k, v in (outputs or {}).items()}
        except Exception as error:  # an item's failure is data, never a failed batch
            return False, str(error), None, "", action.cost
        return True, None, texts, action.primary_output, action.cost

    @F.pandas_udf(RESULT)
    def run(action_ids: pd.Series, inputs: pd.Series) -> pd.DataFrame:
        rows = [call(a, i) for a, i in zip(action_ids, inputs)]
        frame = pd.DataFrame(
            rows, columns=["success", "error_message", "outputs", "primary_output", "cost"]
        )
        return frame.astype({"success": bool, "cost": "float64"})

    return run.asNondeterministic()


def run_action(
    df: DataFrame,
    action: Action,
    inputs: str = "inputs",
    hostname: Column | None = None,
    username: Column | None = None,
    into: str = "result",
    columns: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Run one action on every row; adds ``result``. ``columns`` are typed inputs of a native
    action; a Python action gets its inputs as texts."""
    if action.native is not None:
        return df.withColumn(into, action.result(F.col(inputs), hostname, username, columns))
    bound = action.inputs(F.col(inputs), hostname, username)
    done = df.withColumn(into, _python_result({action.action_id: action})(F.lit(action.action_id), bound))
    return done.withColumn(into, checked(F.col(into), action.outputs)) if action.outputs else done


def not_found(action_id: Column, registries: Sequence[str]) -> Column:
    searched = "[" + ", ".join(f"'{name}'" for name in registries) + "]"
    return F.concat(
        F.lit("Action not found: "), F.coalesce(action_id, F.lit("None")), F.lit(f". Searched: {searched}")
    )


def known_actions(registries: Mapping[str, Mapping[str, Action]]) -> dict[str, Action]:
    """Actions by id; the first registry that has an id wins."""
    known: dict[str, Action] = {}
    for registry in registries.values():
        for name, action in registry.items():
            known.setdefault(name, action)
    return known


def dispatch_actions(
    df: DataFrame,
    registries: Mapping[str, Mapping[str, Action]],
    action_id: str = "action_id",
    inputs: str = "inputs",
    hostname: Column | None = None,
    username: Column | None = None,
    into: str = "result",
) -> DataFrame:
    """Run the action each row names; adds ``result``.

    The first registry that has the id wins. An unknown id is a failed row. One
    pass over the rows whatever the number of actions: native ones are branches of
    one CASE expression, Python ones share one UDF.
    """
    known = known_actions(registries)
    wanted, given = F.col(action_id), F.col(inputs)

    result = fail(not_found(wanted, list(registries)))
    for name, action in known.items():
        if action.native is not None:
            done = action.result(given, hostname, username)
            result = F.when(wanted == name, done).otherwise(result)

    scripted = {name: action for name, action in known.items() if action.native is None}
    if scripted:
        bound = F.lit(None).cast(FIELDS)
        for name, action in scripted.items():
            bound = F.when(wanted == name, action.inputs(given, hostname, username)).otherwise(bound)
        is_scripted = wanted.isin(*scripted)
        df = df.withColumn("_scripted", _python_result(scripted)(F.when(is_scripted, wanted), bound))
        ran = F.col("_scripted")
        for name, action in scripted.items():
            if action.outputs:
                ran = F.when(wanted == name, checked(F.col("_scripted"), action.outputs)).otherwise(ran)
        result = F.when(is_scripted, ran).otherwise(result)
    return df.withColumn(into, result).drop("_scripted")


def build_receipts(
    results: DataFrame, timestamp: Column, keep: Sequence[str] = ("job_id", "stream_id", "seq"),
    item_id: str = "item_id", result: str = "result",
) -> DataFrame:
    """One receipt per item from its result.

    An item that did not fail is a success; an empty message is null; outputs are
    kept only when there are any. ``timestamp`` (ms) is an argument, so a retried
    task writes the same receipt.
    """
    got = F.col(result)
    success = F.coalesce(got.getField("success"), F.lit(True))
    outputs = got.getField("outputs")
    return results.select(
        *keep,
        F.col(item_id).alias("object_id"),
        success.alias("success"),
        empty_to_null(got.getField("error_message")).alias("error_message"),
        timestamp.cast("bigint").alias("timestamp"),
        F.when(success & (F.size(outputs) > 0), outputs).alias("outputs"),
        got.getField("cost").alias("cost"),
    )


def single_action_result(results: DataFrame, completed_at: Column, result: str = "result") -> DataFrame:
    """Final record of a job that ran one action (times in seconds).

    The job keeps a receipt when it failed, or when it has outputs.
    """
    got = F.col(result)
    success = F.coalesce(got.getField("success"), F.lit(False))
    message = F.coalesce(got.getField("error_message"), F.lit("Unknown error"))
    # a result that exists keeps its own, possibly empty, message
    message = F.when(got.isNotNull(), F.coalesce(got.getField("error_message"), F.lit(""))).otherwise(message)
    outputs = got.getField("outputs")
    receipt = F.when(
        success & (F.size(outputs) > 0),
        F.struct(
            F.lit(True).alias("success"),
            F.lit(None).cast("string").alias("error_message"),
            outputs.alias("outputs"),
            F.coalesce(got.getField("primary_output"), F.lit("")).alias("primary_output"),
        ),
    ).when(
        ~success,
        F.struct(
            F.lit(False).alias("success"),
            message.alias("error_message"),
            F.lit(None).cast(FIELDS).alias("outputs"),
            F.lit(None).cast("string").alias("primary_output"),
        ),
    )
    return results.withColumns(
        {
            "status": F.when(success, "SUCCEEDED").otherwise("FAILED"),
            "error_message": F.when(~success, message),
            "percent": F.lit(100),
            "updated_at": completed_at.cast("bigint"),
            "completed_at": completed_at.cast("bigint"),
            "receipt": receipt,
        }
    )


def count_actions(nodes: Column) -> Column:
    """Number of ACTION nodes of a script, at least 1."""
    return F.greatest(F.size(F.filter(nodes, lambda n: n.getField("ntype") == "ACTION")), F.lit(1))


def action_percent(completed: Column, nodes: Column) -> Column:
    return F.floor(completed.cast("double") / count_actions(nodes).cast("double") * 100).cast("int")
