"""Scalar expressions on text, numbers and time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def narrow_decimal(value: Column) -> Column:
    """``struct(ival, dval)``: integral decimals as long, others as double.

    An integral value too large for a long is kept as a double.
    """
    whole = F.when(value % F.lit(1) == 0, value.try_cast("bigint"))
    return F.struct(whole.alias("ival"), F.when(whole.isNull(), value.cast("double")).alias("dval"))


def mask_secret(name: Column, value: Column) -> Column:
    """First four characters of values whose name says KEY or SECRET."""
    secret = name.contains("KEY") | name.contains("SECRET")
    masked = F.concat(F.substring(F.nullif(value, F.lit("")), 1, 4), F.lit("..."))
    return F.when(secret, masked).otherwise(value)


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def normalize_url(url: Column) -> Column:
    """Force ``https://``. A plain ``http`` url keeps only the text after its last
    slash, so a path is lost; this matches observable results and is kept."""
    return (
        F.when(url.rlike("^http[:|/]"), F.concat(F.lit("https://"), F.substring_index(url, "/", -1)))
        .when(~url.startswith("https"), F.concat(F.lit("https://"), url))
        .otherwise(url)
    )


def dest_key(prefix: Column, at: Column, item_id: Column, extension: str = ".png") -> Column:
    """``{prefix}/{time}-{4 characters}{extension}``.

    The four characters come from a hash of the item id, not from a random value,
    so a retried task writes to the same key.
    """
    folder = F.when(prefix.endswith("/"), prefix).otherwise(F.concat(prefix, F.lit("/")))
    stamp = F.date_format(at, "yyyy-MM-dd-'at'-HH-mm-ss")
    return F.concat(
        folder, stamp, F.lit("-"), F.substring(F.sha2(item_id, 256), 1, 4), F.lit(extension)
    )


def clamp(value: Column, low, high) -> Column:
    """Limit to ``[low, high]``; null stays null."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def epoch_seconds(at: Column) -> Column:
    """Whole seconds, truncated. Job times use this unit."""
    return F.unix_seconds(at.cast("timestamp"))


def epoch_millis(at: Column) -> Column:
    """Whole milliseconds, truncated. Receipt and event times use this unit."""
    return F.unix_millis(at.cast("timestamp"))


def to_millis(value: Column, unit: str | Column) -> Column:
    """Milliseconds of an epoch value in ``unit``: "s" or "ms", for all rows or per row.
    Any other unit gives null."""
    value, unit = value.cast("bigint"), F.lit(unit) if isinstance(unit, str) else unit
    return F.when(unit == "s", value * 1000).when(unit == "ms", value)
