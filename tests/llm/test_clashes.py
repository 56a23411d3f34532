"""Columns of any name pass through every operator that keeps its caller's columns."""

import pytest
from pyspark.sql import functions as F

from rowloom.llm import divergence, exact, jaccard, mixing, ordinal, periodic, pii, piece
from rowloom.llm.catalog import piece_model

NAMES = (
    "_base _more _data _lang _text _n _id _digest _source _topic _tokens _draw _p data Data_ whole base more language words key before id "
    "part pos path node block span row hold"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"some words of text number {i} mail a{i}@b.org " * (i % 7), "en", "s") for i in range(40)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.lit(f"my {name}").alias(name) for name in NAMES])


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(i, 1, 1) for i in range(900, 950)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda d: pii.find(d),
    "piece": lambda d: piece.encode(d, piece_model()),
    "piece digests": lambda d: piece.encode_digests(d, piece_model()),
    "divergence": lambda d: divergence.judge(d),
    "ordinal": lambda d: ordinal.select(d, labels(d.sparkSession)),
    "exact": lambda d: exact.first_copies(d),
    "jaccard": lambda d: jaccard.one_of_each(d),
    "mixing": lambda d: mixing.sample(d, 0.9),
    "periodic": lambda d: periodic.find(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_stay(clashing, name):
    got = OPERATORS[name](clashing)
    assert got.columns[: len(clashing.columns)] == clashing.columns
    rows = got.select(*NAMES).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(f"my {name}" for name in NAMES)]


def test_ratings_of_unknown_documents_take_no_place(spark):
    """The bound on rated documents is on those that exist."""
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad junk there ") * 9) for i in range(60)], "doc_id long, text string")
    known = [(i, i % 2) for i in range(60)]
    ratings = spark.createDataFrame(known + [(i, 0) for i in range(1_000, 9_000)], "doc_id long, grade int")
    model = ordinal.train(docs, ratings, n_grades=2, select_from=1, max_rated=60)
    kept = {r.doc_id for r in ordinal.score(docs, model).where("kept").collect()}
    assert kept == {i for i in range(60) if i % 2}
