"""Typed outputs: what an action declares to give, checked per item and kept by type.

An action's outputs travel as texts (lists and maps as JSON, bytes as base64), as a table mixes
actions. Where an action declares tags for them, each output must convert to its tag's type, or
the item fails; what converts is kept as one VARIANT per item, whatever the action, and a
table of one action is shredded into columns of the declared types.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.values import cast_param
from rowloom.schemas import FIELDS, TYPE_OF_TAG


def as_output(value: Column, tag: str) -> Column:
    """A native column as the text of an output of this tag."""
    _field, kind = TYPE_OF_TAG[tag]
    if kind == "binary":
        return F.base64(value)
    if kind.startswith(("array", "map", "struct")) or kind == "variant":
        return F.to_json(value)
    return value.cast("string")


def typed_output(outputs: Column, name: str, tag: str) -> Column:
    """One output by its declared type; null where it is absent, null or of another type."""
    return cast_param(F.try_element_at(outputs, F.lit(name)), tag)


def misfits(outputs: Column, declared: Mapping[str, str]) -> Column:
    """Names of outputs that don't convert to their declared type, in declared order."""
    wrong = [
        F.when(F.try_element_at(outputs, F.lit(name)).isNotNull() & typed_output(outputs, name, tag).isNull(), F.lit(name))
        for name, tag in declared.items()
    ]
    return F.filter(F.array(*wrong), lambda name: name.isNotNull())


def checked(result: Column, declared: Mapping[str, str] | None) -> Column:
    """``result``, or a failure that names the outputs that aren't of their declared types."""
    if not declared:
        return result
    wrong = misfits(result.getField("outputs"), declared)
    failure = F.struct(
        F.lit(False).alias("success"),
        F.concat(F.lit("Not of the declared type: "), F.array_join(wrong, ", ")).alias("error_message"),
        F.lit(None).cast(FIELDS).alias("outputs"),
        F.lit("").alias("primary_output"),
        result.getField("cost").alias("cost"),
    )
    return F.when(result.getField("success") & (F.size(wrong) > 0), failure).otherwise(result)


def variant_outputs(outputs: Column, action_id: Column, declared: Mapping[str, Mapping[str, str]]) -> Column:
    """Outputs of any action as one VARIANT: fields of the types that its action declares (``declared``
    by action id), or texts where it declares none. Null without outputs."""
    out = F.to_variant_object(outputs)
    for name, tags in declared.items():
        fields = F.struct(*[typed_output(outputs, field, tag).alias(field) for field, tag in tags.items()])
        out = F.when(action_id == name, F.to_variant_object(fields)).otherwise(out)
    return F.when(outputs.isNotNull(), out)


def shred(df: DataFrame, declared: Mapping[str, str], typed: str = "typed") -> DataFrame:
    """A column of its own type for each declared output, read from the VARIANT ``typed``."""
    def column(name: str, tag: str) -> Column:
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return F.try_variant_get(F.col(typed), f"$['{quoted}']", TYPE_OF_TAG[tag][1])

    return df.withColumns({name: column(name, tag) for name, tag in declared.items()})
