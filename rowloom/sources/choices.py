"""Choice lists offered for a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LABEL_COLUMNS = ("label", "name", "title", "object_id")


def lookup_choices(
    items: DataFrame,
    value_column: str = "",
    label_column: str = "",
    filter_by: str = "",
    filter_value: str | None = None,
) -> DataFrame:
    """(value, label) of a collection. The value defaults to ``object_id``; the label
    to the first of label, name, title, object_id that is filled."""
    if filter_by:
        items = items.filter(F.col(filter_by).cast("string") == filter_value)
    value = F.col(value_column or "object_id").cast("string")
    if label_column:
        label = F.col(label_column).cast("string")
    else:
        present = [c for c in LABEL_COLUMNS if c in items.columns]
        label = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in present])
    return items.select(value.alias("value"), label.alias("label"))


def static_choices(params: DataFrame, key: str, choices: str = "svals") -> DataFrame:
    """One row per literal choice of every parameter record, in list order."""
    return params.select(key, F.posexplode(choices).alias("position", "_choice")).select(
        key,
        "position",
        F.col("_choice.value").alias("value"),
        F.col("_choice.label").alias("label"),
        F.coalesce(F.col("_choice.disabled"), F.lit(False)).alias("disabled"),
    )


def inverted_map(records: DataFrame, picked: DataFrame, mapping: str = "mapping", value: str = "value") -> DataFrame:
    """Every key that maps to a picked value, as rows (value, match).

    Matches stay rows and are not gathered into one list, since one value may have
    any number of them.
    """
    pairs = records.select(F.explode(mapping).alias("match", value))
    return pairs.join(picked.select(value), value, "left_semi").select(value, "match").distinct()
