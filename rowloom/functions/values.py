"""Typed values: a tag and the one field that carries the value."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from rowloom.schemas import TYPE_OF_TAG, VALUE_FIELDS


def encode_value(value: Column, tag: str) -> Column:
    """Wrap a native column as a typed value with the given tag."""
    target, _kind = TYPE_OF_TAG[tag]
    if target == "json_data":
        value = F.to_json(value)
    elif tag == "DATETIME":
        value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    parts = [F.lit(tag).alias("ptype")]
    for name, kind in VALUE_FIELDS.items():
        filled = value.cast(kind) if name == target else F.lit(None).cast(kind)
        parts.append(filled.alias(name))
    return F.struct(*parts)


def decode_value(value: Column, tag: str) -> Column:
    """Native column of the tag's type; null if the value carries another tag."""
    source, kind = TYPE_OF_TAG[tag]
    raw = value.getField(source)
    if kind == "variant":
        raw = F.try_parse_json(raw)
    elif kind.startswith("struct"):
        raw = F.from_json(raw, kind)
    elif kind != VALUE_FIELDS[source]:
        raw = raw.try_cast(kind)
    return F.when(value.getField("ptype") == tag, raw)


def flatten_outputs(outputs: Column, tags: Mapping[str, str]) -> list[Column]:
    """One typed column per declared output of a ``map<string, typed value>``."""
    return [
        decode_value(F.try_element_at(outputs, F.lit(name)), tag).alias(name)
        for name, tag in tags.items()
    ]


def cast_param(raw: Column, tag: str) -> Column:
    """Convert raw text to the tag's type; null where it does not convert."""
    _field, kind = TYPE_OF_TAG[tag]
    if kind == "string":
        return raw
    if kind == "variant":
        return F.try_parse_json(raw)
    if kind.startswith(("array", "map", "struct")):
        return F.from_json(raw, kind)
    if kind == "binary":
        return F.try_to_binary(raw, F.lit("base64"))
    return raw.try_cast(kind)
