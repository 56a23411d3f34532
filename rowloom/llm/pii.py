"""Personal data: expressions propose spans, checksums confirm them, context adjusts scores.

Everything is SQL functions. A pattern's matches and the pieces between them, both in the
order of the text, give the places of its spans. Places count code points, the end is
exclusive. Patterns never give back what they took and look at the character before them,
so the work grows with the text, whatever it holds.

Base kinds are always reported when their check holds: ``email``, ``ip`` (parts up to 255),
``card`` (14 to 19 digits, Luhn), ``phone`` (international, 10 to 15 digits). Further kinds
are reported from a score of ``LEAST`` on: ``iban`` (mod-97), ``ssn``, ``local_phone`` and
``secret``, of which the last three need a word that tells what they are within
``NEAR`` characters before. A further span that touches a base span is left out.

Cases: a null text counts as empty; repeated rows are judged one by one; other columns pass
through, and those named as the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.llm.common import prepare, unused, whole, without

NEAR, LEAST = 32, 0.7


@dataclass(frozen=True)
class Kind:
    """A kind of span: ``guard`` is a cheap test of the text, ``score`` what a match alone is
    worth, ``check`` what confirms it, ``words`` what raises its score when nearby."""

    name: str
    pattern: str
    guard: str
    check: str
    score: float
    words: str
    raised: float
    base: bool


# fixed values: the contract's expressions, written so that they never backtrack over a run
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "any", 0.8, r"mail|contact|write", 0.2, True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+", ".", "octets", 0.7, r"\bip\b|address|host|server", 0.2, True),
    Kind("card", r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "", "luhn", 0.7, r"card|visa|payment|credit", 0.3, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone", 0.7, r"phone|tel|call|mobile|fax", 0.3, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+(?![A-Za-z0-9])", "", "mod97", 0.8, r"iban|account|bank", 0.2, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "any", 0.3, r"\bssn\b|social security", 0.6, False),
    Kind("local_phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "", "any", 0.3, r"phone|\btel|call|mobile|fax", 0.5, False),
    Kind("secret", r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}+(?![0-9A-Za-z])", "", "any", 0.3, r"token|secret|passw|api.?key|\bkey\b", 0.5, False),
)

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """From the right every second digit counts double, nine less where that has two digits."""
    digits = F.transform(F.split(F.reverse(_digits(match)), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return F.length(_digits(match)).between(14, 19) & (total % 10 == 0)


def _octets(match: Column) -> Column:
    """Each of the four parts is at most 255, whatever zeros stand before it."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 4) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _mod97(match: Column) -> Column:
    """An account number read from its fifth character on, letters as 10 to 35, is 1 modulo 97."""
    packed = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(packed, 5, 64), F.substring(packed, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + F.coalesce(value(c), F.lit(0))) % 97
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.length(packed).between(15, 34) & (rest == 1)


CHECKS = {
    "any": lambda m: F.lit(True),
    "octets": _octets,
    "luhn": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "mod97": _mod97,
}


def proposed(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind with their scores, in the order of the text."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, kind.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc, i):
        begin = acc["at"] + F.length(F.get(between_, i))
        match = F.get(matches_, i)
        end = begin + F.length(match)
        near = F.lower(F.substring(text, F.greatest(F.lit(1), begin - NEAR + 1), F.least(F.lit(NEAR), begin)))
        score = F.round(F.lit(kind.score) + F.when(near.rlike(kind.words), F.lit(kind.raised)).otherwise(F.lit(0.0)), 2)
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
        held = CHECKS[kind.check](match)
        if not kind.base:
            held = held & (score >= LEAST)
        return F.struct(end.alias("at"), F.when(held, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    # the two lists are bound as arguments, so that each text is searched once for each
    both = F.array(F.struct(matches.alias("m"), between.alias("b")))

    def walk(x):
        nonlocal matches_, between_
        matches_, between_ = x["m"], x["b"]
        steps = F.when(F.size(x["m"]) > 0, F.sequence(F.lit(0), F.size(x["m"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda acc: acc["spans"])

    matches_ = between_ = None
    found = F.flatten(F.transform(both, walk))
    guard = F.contains(text, F.lit(kind.guard)) if kind.guard else text.rlike(kind.pattern)
    return F.when(guard, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``pii``: array of (start, rank, end, kind, score) by place."""
    prepare(docs.sparkSession)
    docs = without(docs, "pii")
    body = whole(text)
    base = [k for k in KINDS if k.base]
    more = [k for k in KINDS if not k.base]
    base_, more_ = unused(docs, "base"), unused(docs, "more")
    rows = docs.withColumn(base_, F.concat(*[proposed(body, k, i) for i, k in enumerate(base)]))
    rows = rows.withColumn(more_, F.concat(*[proposed(body, k, len(base) + i) for i, k in enumerate(more)]))
    apart = lambda s: ~F.exists(base_, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    kept = F.when(F.size(more_) > 0, F.filter(more_, apart)).otherwise(F.col(more_))
    return rows.withColumn("pii", F.array_sort(F.concat(base_, kept))).drop(base_, more_)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, numbers of the base kinds, digest of the base spans, all spans, top score."""
    rows = find(docs.select("doc_id", text), text).select("doc_id", "pii")
    names = [k.name for k in KINDS if k.base]
    count = lambda n: F.size(F.filter("pii", lambda s: s["kind"] == n)).cast("long").alias(f"n_{n}")
    return rows.select(
        "doc_id",
        *[count(n) for n in names],
        F.sha2(written(F.filter("pii", lambda s: s["kind"].isin(names))), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets."""
    columns = docs.columns
    rows = find(docs, text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(fresh, F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("out"))).otherwise(acc)

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    masked = F.when(F.size("pii") > 0, F.aggregate("pii", start, step, rest)).otherwise(F.col(text))
    return rows.withColumn(text, masked).select(*columns)
