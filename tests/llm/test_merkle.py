import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rowloom.llm import merkle
from rowloom.session import scratch_path

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, tamper=False):
    values = [row[c] for c in merkle.FIELDS]
    if tamper and values[4] is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[4])
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[k : k + 16]) for k in range(0, len(last), 16)])
    return levels


def siblings(levels, at):
    steps = []
    for level in levels[:-1]:
        begin = at - at % 16
        steps.append((level[begin:at], level[at + 1 : begin + 16]))
        at //= 16
    return steps


def expected(rows):
    """The whole manifest, by the definition."""
    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        docs = sorted(sources[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[source] = docs, levels_of([leaf(r) for r in docs])
    top = levels_of([trees[s][1][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        docs, levels = trees[source]
        for i, row in enumerate(docs):
            steps = siblings(levels, i) + siblings(top, k)
            change = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
            value = leaf(row, change)
            for left, right in steps:
                value = digest(*left, value, *right)
            proof = digest(*[x for left, right in steps for x in left + right])
            out.append((row["doc_id"], leaf(row), levels[-1][0], top[-1][0], proof, value, value == top[-1][0]))
    return sorted(out, key=str)


def check(got, rows):
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def made(n, source=lambda i: f"s{i % 3}"):
    return [
        {"doc_id": i, "source": source(i), "lang": "en" if i % 4 else None, "n_chars": i, "text": f"Text {i} ÉA" if i % 7 else None}
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_one_source(spark, n):
    rows = made(n, lambda i: "only")
    check(merkle.audit(spark.createDataFrame(rows, SCHEMA)), rows)


def test_hot_source_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PER_RANGE", 1_000)
    # one source with more than one block, and sources of one leaf, more than a run of them
    rows = made(9_000, lambda i: "hot" if i % 9 else f"cold{i % 297}" if i % 2 else None)
    check(merkle.audit(spark.createDataFrame(rows, SCHEMA).repartition(5)), rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_of_blocks(spark, levels):
    """Small blocks, so that their roots fill blocks, and so do the roots of those."""
    rows, folder = made(6_000, lambda i: "hot" if i % 3 else f"s{i % 900}"), scratch_path(spark, "manifest")
    for part in (rows[:1_000], rows[1_000:]):
        merkle.append(spark.createDataFrame(part, SCHEMA), folder, block_levels=levels)
    got = merkle.witnesses(spark, folder, levels).select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")))
    assert sorted(map(tuple, got.collect())) == sorted(r[:5] for r in expected(rows))


def test_partial_witness_grows():
    subtrees = merkle.OpenSubtrees()
    first = subtrees.append("0" * 64)
    for k in range(1, 15):
        subtrees.append(f"{k:064d}")
    assert first.witness() == []  # its run waits for one more sibling
    subtrees.append("f" * 64)
    assert len(first.witness()) == 1
    for k in range(240):
        subtrees.append(f"{k:064d}")
    assert len(first.witness()) == 2  # the sixteenth run completed the level above


@pytest.mark.parametrize("cuts", [(10, 4_096, 8_192), (1, 2)])
def test_appends_give_the_same_manifest(spark, cuts):
    rows, folder = made(9_500, lambda i: "hot" if i % 5 else f"s{i % 4}" if i > 3 else None), scratch_path(spark, "manifest")
    for k, (a, b) in enumerate(zip((0, *cuts), (*cuts, len(rows)), strict=True)):
        assert merkle.append(spark.createDataFrame(rows[a:b], SCHEMA), folder) == k + 1
    got = merkle.witnesses(spark, folder)
    got = got.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.folded(F.col("leaf"), F.col("path")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(*r[:5], r[3]) for r in expected(rows)], key=str)
    roots = merkle.subroots(spark, folder).collect()
    assert {r.source for r in roots} == {r["source"] for r in rows} and {r.root for r in roots} == {expected(rows)[0][3]}


def test_append_leaves_closed_blocks_alone_and_refuses_late_documents(spark):
    rows, folder = made(6_000, lambda i: "one"), scratch_path(spark, "manifest")
    merkle.append(spark.createDataFrame(rows[:5_000], SCHEMA), folder)
    merkle.append(spark.createDataFrame(rows[5_000:], SCHEMA), folder)
    assert spark.read.parquet(f"{folder}/v2/closed").count() == 0  # the first block isn't written again
    assert spark.read.parquet(f"{folder}/v2/open").selectExpr("size(members)").first()[0] == 6_000 - 4_096
    with pytest.raises(ValueError):
        merkle.append(spark.createDataFrame(rows[3:4], SCHEMA), folder)
    assert merkle.witnesses(spark, folder).count() == 6_000


def test_edges(spark, edges, nothing):
    docs = edges.withColumn("n_chars", F.length("text").cast("long"))
    rows = [r.asDict() for r in docs.collect()]
    got = merkle.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    check(got, rows)
    assert merkle.audit(docs.where("false")).count() == 0
