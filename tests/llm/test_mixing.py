import random
from collections import defaultdict

import numpy as np
import pytest

from rowloom.llm import mixing


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    out = []
    for i in range(400):
        lang, source = draw.choice(["en", "en", "en", "de", "fr"]), draw.choice(["a", "a", "a", "b", "c"])
        out.append((i, " ".join("w" for _ in range(draw.randint(1, 400))), lang, source))
    return out


def raked(cells, targets):
    """Shares by the same scaling, in dictionaries."""
    total = sum(cells.values())
    w = {c: t / total for c, t in cells.items()}
    for _ in range(200):
        for d, target in enumerate(targets):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[d]] += x
            w = {c: x * target[c[d]] / now[c[d]] for c, x in w.items()}
    return w


def cells_of(got):
    cells = defaultdict(int)
    for r in got:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    return cells


def targets_of(cells, languages):
    power = lambda d: {k: np.sqrt(sum(t for c, t in cells.items() if c[d] == k)) for k in {c[d] for c in cells}}
    even = lambda x: {k: v / sum(x.values()) for k, v in x.items()}
    return [even(power(0)), languages, even(power(2))]


def test_weights_and_probabilities(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    languages = {"en": 0.4, "de": 0.35, "fr": 0.25}
    got = mixing.mix(docs, share=0.2, power=0.5, languages=languages).collect()
    assert len(got) == len(rows)
    cells, total = cells_of(got), sum(r.n_tokens for r in got)
    rate = {(r.source, r.lang, r.topic): (r.weight, r.p) for r in got}
    assert max(p for _, p in rate.values()) < 1  # no cell is asked for more than it has
    for c, x in raked(cells, targets_of(cells, languages)).items():
        assert rate[c][0] == pytest.approx(x, abs=1e-5)
        assert rate[c][1] == pytest.approx(x * 0.2 * total / cells[c], rel=1e-4)
    assert sum(r.p * r.n_tokens for r in got) == pytest.approx(0.2 * total, rel=1e-3)
    assert sum(r.n_tokens for r in got if r.kept) == pytest.approx(0.2 * total, rel=0.2)


@pytest.mark.parametrize("seed", range(2))
def test_margins_hold_where_cells_give_all_they_have(spark, seed):
    """Targets that some way of giving meets, but only with cells that give all they have."""
    draw = random.Random(seed)
    names = [(s, f"l{k}", f"t{j}") for s in "abcd" for k in range(3) for j in range(2)]
    tokens = {c: draw.randint(50, 5_000) for c in names}
    gives = {c: t * draw.choice([0.2, 0.5, 1.0, 1.0, 1.0]) for c, t in tokens.items()}
    share = sum(gives.values()) / sum(tokens.values())
    cells = spark.createDataFrame([(*c, t) for c, t in tokens.items()], "source string, lang string, topic string, tokens long")
    targets = []
    for d in range(3):
        sums = defaultdict(float)
        for c, x in gives.items():
            sums[c[d]] += x / sum(gives.values())
        targets.append(dict(sums))
    frames = {m: spark.createDataFrame(list(t.items()), f"{m} string, target double") for m, t in zip(mixing.MARGINS, targets, strict=True)}
    fitted = mixing.materialise(mixing.rake(cells, frames, share), "fitted")
    got = {(r.source, r.lang, r.topic): r for r in fitted.collect()}
    assert max(r.p for r in got.values()) > 1 - 1e-9 and all(r.expected <= r.tokens for r in got.values())
    for told in mixing.shares(fitted).collect():
        assert told.expected == pytest.approx(targets[mixing.MARGINS.index(told.margin)][told.value], abs=0.005)


def test_targets_out_of_reach_are_told(spark):
    rows = [(i, "w " * 10, "en" if i % 10 else "de", f"s{i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = mixing._names(docs)
    measured = mixing._measured(docs, mixing.topic_of_text(), names)
    cells = mixing.calibrate(measured, names, 0.5, 1.0, {"en": 0.5, "de": 0.5})
    told = {(r.margin, r.value): (r.target, r.expected) for r in mixing.shares(cells).collect()}
    assert told["lang", "de"][0] == pytest.approx(0.5) and told["lang", "de"][1] < 0.4  # a tenth of all tokens is too few
    assert cells.where("lang = 'de'").agg({"p": "min"}).first()[0] > 0.999


def test_values_that_are_not_named_keep_their_share(spark):
    rows = [(i, "w " * 10, ["en", "de", "xx", None][i % 4], "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, share=0.5, languages={"en": 0.7, "de": 0.3}).collect()
    weight = {r.lang: r.weight for r in got}
    assert weight == {"en": pytest.approx(0.35), "de": pytest.approx(0.15), "xx": pytest.approx(0.25), "": pytest.approx(0.25)}


def test_sample_agrees(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in mixing.mix(docs, 0.5).where("kept").collect()}
    assert {r.doc_id for r in mixing.sample(docs, 0.5).collect()} == kept


def test_edges(edges, nothing):
    got = mixing.mix(edges)
    assert got.count() == edges.count()
    clash = edges.selectExpr("*", "'mine' AS _source", "'mine' AS _lang", "'mine' AS _tokens", "'mine' AS _draw", "'mine' AS _p")
    sampled = mixing.sample(clash, 0.9)
    assert sampled.columns == clash.columns and sampled.where("_draw = 'mine' AND _p = 'mine'").count() == sampled.count() > 0
    assert mixing.mix(nothing).count() == 0 and mixing.sample(nothing).count() == 0
