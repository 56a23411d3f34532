"""Predicates and value rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from rowloom.schemas import BASE_REQUIRED, MODE_REQUIRED

URL_PATTERN = r"^https?://[^\s/?#]+\.[^\s/?#]+([/?#]\S*)?$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def is_blank(value: Column) -> Column:
    """Null or empty text."""
    return value.isNull() | (value == "")


def missing_required(
    record: Column,
    mode: Column,
    base: Sequence[str] = BASE_REQUIRED,
    by_mode: Mapping[str, Sequence[str]] = MODE_REQUIRED,
) -> Column:
    """Ordered names of required fields that are absent, null or empty.

    ``record`` is a fields map. A mode without an entry needs the base set only.
    """
    required = F.array(*[F.lit(name) for name in base])
    extra = F.array().cast("array<string>")
    for name, needed in by_mode.items():
        if needed:
            extra = F.when(mode == name, F.array(*[F.lit(n) for n in needed])).otherwise(extra)
    return F.filter(
        F.concat(required, extra),
        lambda name: F.coalesce(F.try_element_at(record, name), F.lit("")) == "",
    )


def _operand(rule: Mapping):
    for name in ("ival", "dval", "sval"):
        if rule.get(name) is not None:
            return rule[name]
    return None


def _any_of(rule: Mapping, test) -> Column:
    options = list(rule.get("svals") or []) or [rule.get("sval") or ""]
    return reduce(lambda a, b: a | b, [test(option) for option in options])


# rule name -> test(value, rule); several texts in one rule mean any of them
RULE_TESTS = {
    "ENDS_WITH": lambda v, r: _any_of(r, lambda s: v.endswith(s)),
    "STARTS_WITH": lambda v, r: _any_of(r, lambda s: v.startswith(s)),
    "VALID_URL": lambda v, r: v.rlike(URL_PATTERN),
    "EMAIL": lambda v, r: v.rlike(EMAIL_PATTERN),
    "MIN_LENGTH": lambda v, r: F.length(v) >= _operand(r),
    "MAX_LENGTH": lambda v, r: F.length(v) <= _operand(r),
    "GREATER_THAN": lambda v, r: v > _operand(r),
    "LESS_THAN": lambda v, r: v < _operand(r),
    "GREATER_THAN_OR_EQUAL": lambda v, r: v >= _operand(r),
    "LESS_THAN_OR_EQUAL": lambda v, r: v <= _operand(r),
}


def check_rule(value: Column, rule: Mapping) -> Column:
    """True where the value satisfies the rule. A null value is not judged."""
    return F.coalesce(RULE_TESTS[rule["rule"]](value, rule), F.lit(True))


def violations(checks: Sequence[tuple[str, Column, Mapping]]) -> Column:
    """``array<struct(name, rule, message)>`` of the rules that fail.

    ``checks`` holds (parameter name, value column, rule).
    """
    found = [
        F.when(
            ~check_rule(value, rule),
            F.struct(
                F.lit(name).alias("name"),
                F.lit(rule["rule"]).alias("rule"),
                F.lit(rule.get("error_message") or f"{name} fails {rule['rule']}").alias("message"),
            ),
        )
        for name, value, rule in checks
    ]
    return F.filter(F.array(*found), lambda v: v.isNotNull())


def is_member(value: Column, allowed: Sequence) -> Column:
    """Single select: the value is one of the allowed ones. Null is not judged."""
    return F.coalesce(value.isin(list(allowed)), F.lit(True))


def not_members(values: Column, allowed: Sequence[str]) -> Column:
    """Multi select: the chosen values that are not allowed, in order."""
    fixed = F.array(*[F.lit(a) for a in allowed])
    return F.filter(values, lambda v: ~F.array_contains(fixed, v))


def is_present(value: Column, optional: bool | Column = False) -> Column:
    """A parameter that is not optional must not be null."""
    return (F.lit(optional) if isinstance(optional, bool) else optional) | value.isNotNull()


def is_active(inputs: Mapping[str, Column], conditionals: Mapping[str, object], match_all: bool) -> Column:
    """A parameter is active when its conditionals hold; without any it always is."""
    if not conditionals:
        return F.lit(True)
    tests = [F.coalesce(inputs[name] == value, F.lit(False)) for name, value in conditionals.items()]
    return reduce((lambda a, b: a & b) if match_all else (lambda a, b: a | b), tests)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression for a wildcard: ``*``, ``?``, ``[abc]``, ``[!abc]``."""
    out, rest = [], pattern
    while rest:
        group = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if rest[0] == "*":
            out.append(".*")
        elif rest[0] == "?":
            out.append(".")
        elif group and group.group(2):
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", group.group(2))
            out.append(f"[{'^' if group.group(1) else ''}{body}]")
            rest = rest[group.end():]
            continue
        else:
            out.append(re.escape(rest[0]))
        rest = rest[1:]
    return r"\A(?s:" + "".join(out) + r")\z"


def match_glob(value: Column, *patterns: str) -> Column:
    """True where the value matches any of the patterns."""
    return reduce(lambda a, b: a | b, [value.rlike(glob_regex(p)) for p in patterns])


def match_glob_column(value: Column, pattern: Column) -> Column:
    """Wildcards held in a column (``*`` and ``?`` only)."""
    quoted = F.regexp_replace(pattern, r"([\\.^$|()\[\]{}+])", r"\\$1")
    regex = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.rlike(value, F.concat(F.lit(r"\A(?s:"), regex, F.lit(r")\z")))
