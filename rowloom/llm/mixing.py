"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). Each cell is to give an expected number
of tokens, at first the asked share of its own. These numbers are raked: scaled to the target
share of each source, then of each language, then of each topic, again and again until all
three margins hold. No cell gives more than it has: one that would is held at all its tokens
and the other cells of its margin value make up for it. A document is then sampled with its
cell's probability, expected over present tokens. The draw is a hash of the document, so that
runs and retries agree.

Cells and margins are tables and stay in Spark; only the largest distance from a target reaches
the driver. Tokens are words, so each document is measured by its whole text.

Cases: a null text has no tokens; such a document is kept with its cell's probability, or
if its cell has no tokens at all, with probability 0. A null source, language or topic is a
value of its own (empty text). Where fixed shares leave nothing to values that are not among
them, these keep their share of the tokens and the fixed ones share the rest in proportion;
so no value is dropped for not being named. Rows that are equal in id and text share their
fate. Columns of ``docs`` pass through; those named as the results are replaced. An empty table
gives an empty result. Targets that can't be met, as a value has too few tokens, are
approached: ``shares`` tells what each value is expected to get.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.llm.common import prepare, unused, whole
from rowloom.session import materialise

MARGINS = ("source", "lang", "topic")
#: sweeps over the margins at most, the distance from all targets at which they end, and after
#: how many sweeps that came no nearer
MOST_SWEEPS, CLOSE, STALLED = 60, 1e-6, 4


def topic_of_text(text: str = "text") -> Column:
    """Topic by form, for tables without a topic: tables, notices, contacts, prose by length."""
    body = whole(text)
    return (
        F.when(F.contains(body, F.lit(" | ")), "table")
        .when(F.lower(body).contains("licen"), "notice")
        .when(F.contains(body, F.lit("@")), "contact")
        .when(F.length(body) < 1_000, "short")
        .when(F.length(body) < 8_000, "medium")
        .otherwise("long")
    )


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def tempered(cells: DataFrame, margin: str, power: float, fixed: dict[str, float] | None = None) -> DataFrame:
    """Target shares of a margin: its token shares to ``power``; ``fixed`` values first."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0")
    weight = F.pow(F.col("t").cast("double"), F.lit(power))
    if fixed:
        given = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
        sums = sums.withColumn("given", F.try_element_at(given, F.col(margin)))
    else:
        sums = sums.withColumn("given", F.lit(None).cast("double"))
    weighed = sums.select(margin, "given", "t", F.when(F.col("given").isNull(), weight).alias("free"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    own = zero(F.sum(F.when(F.col("given").isNull(), F.col("t"))) / F.sum("t"))
    total = weighed.agg(zero(F.sum("given")).alias("g"), zero(F.sum("free")).alias("f"), own.alias("own")).first()
    g, f = total["g"], total["f"]
    left = 0.0 if not f else 1.0 - g if g < 1.0 else total["own"]
    scale = (1.0 - left) / g if g else 0.0
    share = F.coalesce(F.col("given") * F.lit(scale), F.col("free") * F.lit(left / f if f else 0.0))
    return weighed.select(margin, share.alias("target"))


def _scaled(fitted: DataFrame, margin: str) -> DataFrame:
    """One step: ``expected`` scaled to the targets of one margin, no cell beyond its tokens.

    Where a value has too much, all its cells are scaled down; where it has too little, those
    that still have tokens to give are scaled up. ``gap``: the distance before, but for values
    that have given all.
    """
    at_most = F.col("expected") >= F.col("tokens")
    now = fitted.groupBy(margin).agg(
        F.sum("expected").alias("now"), F.coalesce(F.sum(F.when(at_most, F.col("expected"))), F.lit(0.0)).alias("full")
    )
    target = F.coalesce(f"target_{margin}", F.lit(0.0))
    down = F.col("expected") * target / F.nullif("now", F.lit(0.0))
    up = F.col("expected") * (target - F.col("full")) / F.nullif(F.col("now") - F.col("full"), F.lit(0.0))
    scaled = F.when(target <= F.col("now"), down).when(at_most, F.col("expected")).otherwise(F.least(F.col("tokens").cast("double"), up))
    gap = F.when((target > F.col("now")) & (F.col("now") - F.col("full") <= 1e-9 * F.col("now")), F.lit(0.0)).otherwise(F.abs(F.col("now") - target))
    joined = fitted.join(now, margin).withColumn("gap", F.greatest("gap", gap))
    return joined.withColumn("expected", F.coalesce(scaled, F.lit(0.0))).select(*fitted.columns)


def rake(cells: DataFrame, targets: dict[str, DataFrame], share: float) -> DataFrame:
    """``cells`` (margins, tokens) with ``expected`` tokens that meet the targets as shares of
    ``share`` of all tokens, ``weight`` (expected over that number) and ``p``.

    A sweep over all margins is one plan, and is stored; one that finds all margins close to
    their targets is the last, or one after which none has come nearer for some time.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    fitted = cells.withColumn("expected", F.col("tokens") * F.lit(float(share))).withColumn("gap", F.lit(0.0))
    for margin, target in targets.items():
        aimed = target.select(margin, (F.col("target") * F.lit(share * total)).alias(f"target_{margin}"))
        fitted = fitted.join(aimed, margin, "left")
    fitted = materialise(fitted, "cells")
    best, since = float("inf"), 0
    for _ in range(MOST_SWEEPS):
        swept = fitted.withColumn("gap", F.lit(0.0))
        for margin in targets:
            swept = _scaled(swept, margin)
        fitted = materialise(swept, "cells")
        gap = fitted.agg(F.max("gap")).first()[0] or 0.0
        best, since = (gap, 0) if gap < 0.98 * best else (best, since + 1)
        if gap <= CLOSE * share * total or since >= STALLED:
            break
    tokens = F.nullif(F.col("tokens").cast("double"), F.lit(0.0))
    return fitted.select(
        *cells.columns,
        "expected",
        (F.col("expected") / F.lit(share * total or 1.0)).alias("weight"),
        F.coalesce(F.least(F.lit(1.0), F.col("expected") / tokens), F.lit(0.0)).alias("p"),
        *[f"target_{m}" for m in targets],
    )


def shares(fitted: DataFrame) -> DataFrame:
    """margin, value, target and expected share of what is sampled, from the cells of ``rake``."""
    total = fitted.agg(F.sum("expected")).first()[0] or 1.0
    out = None
    for margin in MARGINS:
        one = fitted.groupBy(F.lit(margin).alias("margin"), F.col(margin).alias("value")).agg(
            F.max(f"target_{margin}").alias("target"), F.sum("expected").alias("expected")
        )
        out = one if out is None else out.unionByName(one)
    asked = out.where(F.col("margin") == MARGINS[0]).agg(F.sum("target")).first()[0] or 1.0
    return out.select("margin", "value", (F.col("target") / asked).alias("target"), (F.col("expected") / total).alias("expected"))


OWN = (*MARGINS, "tokens", "draw")


def _names(docs: DataFrame) -> dict[str, str]:
    """Names of our own columns that ``docs`` doesn't have."""
    return {name: unused(docs, f"_{name}") for name in OWN}


def _measured(docs: DataFrame, topic: Column, names: dict[str, str]) -> DataFrame:
    """``docs`` with the margins, tokens and draw under names of our own."""
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", whole("text")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    made = {
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "topic": F.coalesce(topic, F.lit("")),
        "tokens": word_count("text"),
        "draw": draw,
    }
    return docs.withColumns({names[k]: v for k, v in made.items()})


def calibrate(measured: DataFrame, names: dict[str, str], share: float, power: float, languages: dict[str, float] | None) -> DataFrame:
    """Cells of ``measured`` with expected tokens, weight and p."""
    cells = measured.groupBy(*[F.col(names[m]).alias(m) for m in MARGINS]).agg(F.sum(names["tokens"]).alias("tokens"))
    cells = materialise(cells, "cells")
    targets = {m: tempered(cells, m, power, languages if m == "lang" else None) for m in MARGINS}
    return materialise(rake(cells, targets, share), "rates")


def _attach(measured: DataFrame, cells: DataFrame, names: dict[str, str], weight: str, p: str) -> DataFrame:
    rates = cells.select(*[F.col(m).alias(names[m]) for m in MARGINS], F.col("weight").alias(weight), F.col("p").alias(p))
    return measured.join(rates, [names[m] for m in MARGINS])


def mix(docs: DataFrame, share=0.5, power=0.7, languages=None, topic: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens, weight, p, kept."""
    prepare(docs.sparkSession)
    topic = topic_of_text() if topic is None else topic
    docs = docs.select("doc_id", "source", "lang", "text")
    names = _names(docs)
    measured = materialise(_measured(docs, topic, names).drop("text", "source", "lang"), "measured")
    rows = _attach(measured, calibrate(measured, names, share, power, languages), names, "weight", "p")
    return rows.select(
        "doc_id",
        *[F.col(names[m]).alias(m) for m in MARGINS],
        F.col(names["tokens"]).alias("n_tokens"),
        "weight",
        "p",
        (F.col(names["draw"]) < F.col("p")).alias("kept"),
    )


def sample(docs: DataFrame, share=0.5, power=0.7, languages=None, topic: Column | None = None) -> DataFrame:
    """The sampled rows of ``docs``, with their columns."""
    prepare(docs.sparkSession)
    topic = topic_of_text() if topic is None else topic
    names, weight, p = _names(docs), unused(docs, "_weight"), unused(docs, "_p")
    measured = _measured(docs, topic, names)
    cells = calibrate(measured.drop("text"), names, share, power, languages)
    rows = _attach(measured, cells, names, weight, p)
    return rows.where(F.col(names["draw"]) < F.col(p)).select(*docs.columns)
