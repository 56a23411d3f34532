import random

import numpy as np
import pytest

from rowloom.llm import ordinal

WORDS = [f"word{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]


def sample(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        text, grade = [draw.choice(WORDS) for _ in range(draw.randint(5, 80))], draw.choice([0, 1, 2, 2, 2])
        if grade == 0:
            text[draw.randrange(len(text))] = draw.choice(["vile", "nasty"])
        if grade == 1:
            text = [w + "$$%" for w in text]
        rows.append((seed * 10_000 + i, " ".join(text), grade))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = sample(500, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    return ordinal.train(docs.select("doc_id", "text"), docs.select("doc_id", "grade"), 3, 2)


def test_held_out(spark, model):
    rows = sample(300, 2)
    got = {r.doc_id: r for r in ordinal.score(spark.createDataFrame(rows, "doc_id long, text string, grade int"), model).collect()}
    right = np.mean([got[i].kept == (g == 2) for i, _, g in rows])
    assert right > 0.97
    mean = [np.mean([got[i].expected_grade for i, _, g in rows if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_thresholds_are_ordered(model):
    assert (np.diff(model.thresholds) > 0).all()


def test_bound_on_rated_documents(spark):
    rows = sample(100, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    few = ordinal.train(docs, docs, 3, 2, max_rated=10)
    assert len(few.thresholds) == 2


def test_without_ratings_all_stay(edges, nothing):
    labels = edges.selectExpr("doc_id", "cast(null as int) AS quality", "cast(null as int) AS toxic")
    got = ordinal.select(edges, labels)
    assert got.count() == edges.count() and got.where("kept").count() == edges.count()
    assert ordinal.select(nothing, labels).count() == 0


def test_conflicts_and_strangers(spark, edges):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (4, 1, 1), (None, 1, 1), (999, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert ordinal.select(edges, labels).count() == edges.count()


def test_prefix_leaves_columns_alone(edges, model):
    got = ordinal.score(edges, model, "_quality_")
    assert set(edges.columns) <= set(got.columns) and got.where("kept = 'mine'").count() == edges.count()


def loss(weights, cuts, rows, grades, penalty):
    """Minus the mean log-likelihood of cumulative links, and the ridge."""
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    out = 0.0
    for r, y in zip(rows, grades, strict=True):
        score = weights[r].sum()
        link = lambda z: 1 / (1 + np.exp(-z))
        out -= np.log(link(edges[y + 1] - score) - link(edges[y] - score))
    return out / len(rows) + penalty / 2 * (weights**2).sum()


def test_fit_is_the_maximum_that_plain_steps_find():
    rng = np.random.default_rng(1)
    true = np.array([1.5, -1.0, 0.5, 0.0, -2.0])
    rows = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(250)]
    noisy = [true[r].sum() + rng.logistic() for r in rows]
    grades = np.digitize(noisy, [-1.0, 1.0])
    penalty = 0.01
    weights, cuts = ordinal.fit(rows, grades, 3, min_docs=1, least_gain=-1.0, penalty=penalty, rounds=1_500)
    found = loss(weights[:5].astype(float), cuts, rows, grades, penalty)

    x = np.concatenate([np.zeros(5), [-0.5, 0.5]])  # five weights and two thresholds
    at = lambda v: loss(v[:5], v[5:], rows, grades, penalty)
    for _ in range(250):
        slope = np.array([(at(x + h) - at(x - h)) / 2e-5 for h in 1e-5 * np.eye(7)])
        x = x - 2.0 * slope
    assert found <= at(x) + 1e-4 and np.abs(slope).max() < 0.01
    assert np.allclose(weights[:5], x[:5], atol=0.05) and np.allclose(cuts, x[5:], atol=0.05)
    assert np.all(weights[5:] == 0)


def test_scores_by_brute_force(spark, model):
    """Expected grade and tail probability from the model's own weights, document by document."""
    rows = sample(40, 9)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    texts = {i: t for i, t, _ in rows}
    for r in ordinal.score(docs, model).collect():
        memory = ordinal.Remembered(ordinal._buckets)
        score = float(model.weights[ordinal.features(texts[r.doc_id].encode(), memory)].astype(float).sum())
        above = [1 / (1 + np.exp(cut - score)) for cut in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(above), abs=1e-6)
        assert r.p_select == pytest.approx(above[1], abs=1e-6) and r.kept == (r.p_select >= 0.5)
