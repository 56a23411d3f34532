"""Building the input of one item. Open fields live in a map so that an absent
key, a null value and an empty string stay three different things."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from rowloom.schemas import FIELDS


def empty_fields() -> Column:
    return F.create_map().cast(FIELDS)


def overlay(base: Column, *layers: Column) -> Column:
    """Merge maps, later layers winning by key presence; a null map counts as empty.

    Relies on the LAST_WIN key policy that ``session.configure`` sets. Without it a
    repeated key is an error, never a wrong value.
    """
    return F.map_concat(*[F.coalesce(m, empty_fields()) for m in (base, *layers)])


def fields_of(values: Mapping[str, Column]) -> Column:
    """A fields map from named columns."""
    pairs = [part for name, value in values.items() for part in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs).cast(FIELDS) if pairs else empty_fields()


def bind_inputs(constants: Column, item: Column | Sequence[Column], system: Mapping[str, Column]) -> Column:
    """Job constants, hidden by item fields, hidden by system fields. An item may come
    as several maps, so that all are merged in one step."""
    layers = [item] if isinstance(item, Column) else list(item)
    return overlay(constants, *layers, fields_of(system))


def project_params(inputs: Column, params: Column, accepts_any: bool | Column = False) -> Column:
    """Keep the inputs an action declares, or all of them if it accepts any."""
    kept = F.map_filter(inputs, lambda k, _v: F.array_contains(params, k))
    if isinstance(accepts_any, bool):
        return inputs if accepts_any else kept
    return F.when(accepts_any, inputs).otherwise(kept)


def inject_context(inputs: Column, params: Column, hostname: Column, username: Column) -> Column:
    """Add hostname and username where declared and absent.

    An empty or null hostname is not added; username is added as it is.
    """
    wants_host = (
        (F.coalesce(hostname, F.lit("")) != "")
        & F.array_contains(params, "hostname")
        & ~F.map_contains_key(inputs, "hostname")
    )
    wants_user = F.array_contains(params, "username") & ~F.map_contains_key(inputs, "username")
    with_host = F.when(
        wants_host, F.map_concat(inputs, F.create_map(F.lit("hostname"), hostname))
    ).otherwise(inputs)
    return F.when(
        wants_user, F.map_concat(with_host, F.create_map(F.lit("username"), username))
    ).otherwise(with_host)


def map_params(inputs: Column, mapping: Sequence[Mapping[str, str]]) -> Column:
    """Rename ``src`` to ``dest``, or set ``dest`` to ``static``.

    A source that is absent sets nothing; of two entries for one ``dest`` the later
    one that applies wins.
    """
    layers = []
    for entry in mapping:
        dest = F.lit(entry["dest"])
        if entry.get("static") is not None:
            layers.append(F.create_map(dest, F.lit(entry["static"])))
        else:
            src = entry["src"]
            layers.append(
                F.when(
                    F.map_contains_key(inputs, src),
                    F.create_map(dest, F.try_element_at(inputs, F.lit(src))),
                ).otherwise(empty_fields())
            )
    return overlay(empty_fields(), *layers)


def map_params_column(inputs: Column, mapping: Column) -> Column:
    """``map_params`` with a mapping held in a column,
    ``array<struct<src,dest,static>>``, so that every row may have its own."""
    entries = F.transform(
        mapping,
        lambda m: F.when(
            m.getField("static").isNotNull(),
            F.struct(m.getField("dest").alias("key"), m.getField("static").alias("value")),
        ).when(
            F.map_contains_key(inputs, m.getField("src")),
            F.struct(
                m.getField("dest").alias("key"), F.try_element_at(inputs, m.getField("src")).alias("value")
            ),
        ),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).cast(FIELDS)


def fill_defaults(inputs: Column, defaults: Mapping[str, object]) -> Column:
    """Set defaults where the input is absent or null. A list default is JSON text."""
    plain = {n: json.dumps(v) if isinstance(v, (list, dict)) else v for n, v in defaults.items()}
    wanted = fields_of({name: F.lit(value) for name, value in plain.items()})
    unset = F.map_filter(wanted, lambda k, _v: F.try_element_at(inputs, k).isNull())
    return overlay(inputs, unset)


def expand_template(text: Column, **values: Column) -> Column:
    """Fill ``{name}`` placeholders; a null value fills as empty text."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return text


def truthy_fallback(value: Column, *fallbacks: Column) -> Column:
    """First value that is neither null nor empty; the last fallback as it is."""
    candidates = [F.nullif(c, F.lit("")) for c in (value, *fallbacks[:-1])]
    return F.coalesce(*candidates, fallbacks[-1]) if fallbacks else value
