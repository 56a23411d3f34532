import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import exact


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 500, 4_096])
def test_hash_is_perfect_and_minimal(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    displacements, slots = exact.build_hash(digests)
    assert sorted(slots) == list(range(n))
    words = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)
    assert (exact.look_up(words, displacements, n) == slots).all()


def test_strangers_are_not_members():
    import pandas as pd

    known = [hashlib.sha256(str(i).encode()).digest() for i in range(50)]
    index = exact._build(pd.DataFrame({"bucket": 0, "digest": known, "locator": range(50)}))
    asked = known[:5] + [hashlib.sha256(b"x%d" % i).digest() for i in range(40)]
    got = exact._probe(pd.DataFrame({"digest": asked, "win": "", "size": 1}), index)
    assert got["locator"].notna().tolist() == [True] * 5 + [False] * 40
    assert got["locator"].tolist()[:5] == list(range(5))


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("historical", [None, "false", "true", "doc_id % 2 = 0"])
def test_groups(spark, historical):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a b", "a  b", "a\tb", "A b", "", None, "c", f"own {i}"])) for i in range(200)]
    got = exact.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), historical and F.expr(historical)).collect()
    want, texts = expected(rows), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        key = normal(texts[r.doc_id])
        assert r.group_size == want[key][1]
        assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()
        if historical is None:
            assert r.keep_id == want[key][0] and r.kept == (r.doc_id == r.keep_id)
    assert sum(r.kept for r in got) == len(want)


def test_history_wins(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, "b")]
    got = exact.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 2).collect()
    assert {r.doc_id: (r.keep_id, r.kept, r.repeat) for r in got} == {
        1: (2, False, True), 2: (2, True, False), 3: (3, True, False), 4: (3, False, False),
    }


def test_edges(edges, nothing):
    got = exact.deduplicate(edges).collect()
    assert len(got) == edges.count()
    assert sum(r.kept for r in got) == len({normal(r.text) for r in edges.collect()})
    kept = exact.first_copies(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r.kept for r in got)
    assert exact.deduplicate(nothing).count() == 0 and exact.first_copies(nothing).count() == 0


@pytest.mark.parametrize("old", [1, 20_000])
def test_many_new_texts_after_a_short_history_are_spread(spark, old):
    docs = spark.range(20_001).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    digests = docs.select(exact.digest("text").alias("digest"), F.struct(F.col("doc_id").alias("row")).alias("win"))
    buckets = -(-20_001 // exact.PER_BUCKET)
    sizes = digests.groupBy(exact._bucket(buckets)).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[1] == buckets and sizes[0] < 1.3 * exact.PER_BUCKET
    got = exact.deduplicate(docs, F.col("doc_id") < old)
    assert got.where("kept AND NOT repeat AND group_size = 1").count() == 20_001


def test_hash_is_built_fast():
    import time

    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(4_096)]
    begun = time.perf_counter()
    exact.build_hash(digests)
    assert time.perf_counter() - begun < 2  # half a millisecond a digest would be two seconds


def test_columns_of_any_name_stay(spark, edges):
    clash = edges.selectExpr("*", "'mine' AS _id", "'mine' AS _n", "'mine' AS _digest", "'mine' AS digest_")
    kept = exact.first_copies(clash)
    assert kept.columns == clash.columns and kept.count() == exact.first_copies(edges).count()
    assert kept.where("_id <> 'mine' OR digest_ <> 'mine' OR digest <> 'mine'").count() == 0
