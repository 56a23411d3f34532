"""Steps of a chain, as transforms for ``df.transform``. The declared names fix
what each step is for; where they leave the meaning open, the choice is stated."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def step_static(values: Mapping[str, object]) -> Callable[[DataFrame], DataFrame]:
    """Constant columns."""
    return lambda df: df.withColumns({name: F.lit(value) for name, value in values.items()})


def step_io(names: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Keep the declared inputs or outputs. One that is not there is a null column."""
    return lambda df: df.select(
        *[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]
    )


def step_coalesce(into: str, *sources: str) -> Callable[[DataFrame], DataFrame]:
    """First incoming column that is not null."""
    return lambda df: df.withColumn(into, F.coalesce(*[F.col(s) for s in sources]))


def step_bundle(into: str, *sources: str) -> Callable[[DataFrame], DataFrame]:
    """Several columns as one struct, so their types stay."""
    return lambda df: df.withColumn(into, F.struct(*[F.col(s) for s in sources]))


def step_receipt_meta(receipt: str = "receipt") -> Callable[[DataFrame], DataFrame]:
    """A receipt's success, message, time and cost as columns."""
    fields = ("success", "error_message", "timestamp", "cost")
    return lambda df: df.withColumns({f: F.col(f"{receipt}.{f}") for f in fields})


def step_guard(condition: str, changes: Mapping[str, Column]) -> Callable[[DataFrame], DataFrame]:
    """Apply column changes only to rows whose condition column is true.

    Other rows pass unchanged; a new column is null there.
    """
    def apply(df: DataFrame) -> DataFrame:
        holds = F.coalesce(F.col(condition), F.lit(False))
        return df.withColumns(
            {
                name: F.when(holds, change).otherwise(F.col(name) if name in df.columns else F.lit(None))
                for name, change in changes.items()
            }
        )

    return apply


def wait_for_step(success: Column, on_success: bool, on_failure: bool) -> Column:
    """True once the awaited step ended in a wanted way. ``success`` is null while
    that step has no receipt."""
    return F.coalesce((success & F.lit(on_success)) | (~success & F.lit(on_failure)), F.lit(False))


def wait_for_register(register: Column, run_value=None, skip_value=None) -> Column:
    """``RUN``, ``SKIP`` or ``WAIT`` by the value of a register; skip is tested first."""
    gate = F.lit("WAIT")
    for name, wanted in (("RUN", run_value), ("SKIP", skip_value)):
        if wanted is not None:
            gate = F.when(register == wanted, F.lit(name)).otherwise(gate)
    return gate


def apply_param_types(
    df: DataFrame, params: Mapping[str, str], inputs: str = "inputs", errors: str = "type_errors"
) -> DataFrame:
    """Cast raw text inputs to declared types; one column per parameter.

    ``errors`` lists, in declared order, the parameters that have a value which
    does not convert.
    """
    from rowloom.functions.values import cast_param

    raw = {name: F.try_element_at(F.col(inputs), F.lit(name)) for name in params}
    cast = {name: cast_param(raw[name], tag) for name, tag in params.items()}
    failed = [F.when(raw[n].isNotNull() & cast[n].isNull(), F.lit(n)) for n in params]
    return df.withColumns({**cast, errors: F.filter(F.array(*failed), lambda n: n.isNotNull())})
