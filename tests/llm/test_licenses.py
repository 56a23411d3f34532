import time

import pytest

from rowloom.llm import licenses

MIT = dict(licenses.TEXTS)["MIT"]


@pytest.fixture(scope="module")
def scan(spark):
    catalog = licenses.prepare_catalog(spark)
    return lambda *texts: [
        (r.license, r.notices)
        for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), catalog).orderBy("doc_id").collect()
    ]


def test_entire_texts(scan):
    changed = "MIT License\n" + MIT
    dressed = "Copyright (c) 2019 Some One\nCopyright © 2020 Another\n\n" + MIT.upper().replace("\n", "   \n") + "\n"
    british = MIT.replace("sublicense", "sub-license")
    assert scan(MIT, dressed, british, changed, MIT + " x", "", None) == [
        ("MIT", ""), ("MIT", ""), ("MIT", ""), (None, ""), (None, ""), (None, ""), (None, ""),
    ]


def test_notices(scan):
    text = "Some prose.\nReleased under the MIT Licence\nLICENSED UNDER CC BY-NC 4.0\nReleased under the MIT License."
    assert scan(text, "Released under the MIT License.", "not Released under the MIT License.") == [
        (None, "CC-BY-NC-4.0,MIT"), ("MIT", "MIT"), (None, ""),
    ]


def test_lines_of_copyright(scan):
    without_year = "Copyright (c) Some One\n  © The Authors\ncopyright by A. N. Other\nSee (c) 1999.\n" + MIT
    assert scan(without_year, MIT.replace("shall be included", "copyright notice\nshall be included")) == [("MIT", ""), (None, "")]


def test_texts_are_known_by_their_names(scan):
    assert scan(*[t for _, t in licenses.TEXTS]) == [(n, scan(t)[0][1]) for n, t in licenses.TEXTS]


def test_notices_and_lines_of_any_length(scan):
    long = "x" * 100_000
    assert scan(f"released under the {' ' * 5_000} MIT license", f"{long} license") == [("MIT", "MIT"), (None, "")]


@pytest.mark.parametrize("part", ["(c)", "copyright ", "1999 ", "©", "license ", "(c) 199"])
def test_long_lines_take_linear_time(scan, part):
    begun = time.perf_counter()
    scan("first", part * (1_000_000 // len(part)))
    assert time.perf_counter() - begun < 20  # a session's overhead; quadratic work takes hours


def test_catalogs_of_any_size_and_as_tables(spark):
    many = spark.range(30_000).selectExpr("concat('name ', id) AS license", "concat('known license text ', id) AS text")
    catalog = licenses.prepare_catalog(spark, many)
    docs = spark.range(0, 60_000, 7).selectExpr("id AS doc_id", "concat('Known licence TEXT ', id) AS text")
    got = licenses.scan(docs, catalog)
    assert got.where("license = concat('name ', doc_id)").count() == docs.where("doc_id < 30000").count()
    assert got.where("doc_id >= 30000 AND license IS NOT NULL").count() == 0


def test_edges(spark, edges, nothing):
    catalog = licenses.prepare_catalog(spark)
    assert licenses.scan(edges, catalog).count() == edges.count()
    assert licenses.scan(nothing, catalog).count() == 0
