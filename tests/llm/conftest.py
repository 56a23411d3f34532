import random

import pytest

EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n", None, "a"),
    (4, "one two three", "en", None),
    (5, "one two three", "en", "b"),
    (5, "one two three", "en", "b"),
    (6, "one  two\tthree", "fr", "b"),
    (None, "a text without an id", "de", "b"),
    (None, None, None, None),
    (7, "x" * 30_000, "en", "c"),
    (8, "word " * 20_000, "en", "c"),
    (9, "é 🙂 中文 \u0000 ▁ mixed", "en", "c"),
    (10, "One two three four five six", "en", "c"),
    (11, "one two three four five SIX", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = spark.createDataFrame(EDGES, SCHEMA)
    for name in ("kept", "digest", "row", "n", "win", "template", "tokens", "p", "n_tokens", "pii", "Ids", "key"):
        rows = rows.selectExpr("*", f"'mine' AS {name}")
    return rows


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def prose():
    """Invented documents with exact and near copies."""
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    docs = []
    for i in range(150):
        if docs and draw.random() < 0.4:
            text = draw.choice(docs)[1].split(" ")
            for _ in range(draw.choice([0, 1, 1, 3, 10])):
                text[draw.randrange(len(text))] = draw.choice(words)
            docs.append((i, " ".join(text)))
        else:
            docs.append((i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 120)))))
    return docs
