import random

import numpy as np
import pytest

from rowloom.llm import jaccard


def brute(rows, width=5, percent=80):
    """Set size and smallest id reachable, by comparing every two documents."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for g, (i, _) in zip(group, rows):
        first[g] = min((x for x in (first.get(g), i) if x is not None), default=None)
    return sorted(((i, len(s), first[g]) for g, s, (i, _) in zip(group, sets, rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_trees_agree_with_all_pairs():
    draw = random.Random(3)
    for _ in range(150):
        base = [draw.sample(range(60), draw.randint(1, 25)) for _ in range(3)]
        sets = []
        for _ in range(draw.randint(2, 14)):
            s = set(draw.choice(base))
            for _ in range(draw.randint(0, 4)):
                s ^= {draw.randrange(60)}
            sets.append(np.array(sorted(s or {1}), np.int64))
        sizes = np.array([len(s) + draw.choice([0, 0, 1, 3]) for s in sets])  # members that nobody shares
        label = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 180 * both >= 80 * (sizes[a] + sizes[b]):
                    lo, hi = sorted((label[a], label[b]))
                    label = [lo if x == hi else x for x in label]
        assert jaccard.link_sets(sets, sizes, 80).tolist() == label
        known = np.zeros(len(sets), np.int64)
        assert jaccard.link_sets(sets, sizes, 80, known).tolist() == [0] * len(sets)


def test_same_as_all_pairs(spark, prose):
    got = jaccard.connected(spark.createDataFrame(prose, "doc_id long, text string"))
    assert found(got) == brute(prose)
    assert any(r.doc_id != r.component_id for r in got.collect())


def test_large_blocks_are_exact(spark, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 60)
    draw = random.Random(5)
    chain = prose[:40]
    text = [f"w{k}" for k in range(60)]
    for i in range(30):  # a chain: neighbours link, ends don't
        text[draw.randrange(60)] = f"v{i}"
        chain = chain + [(1000 + i, " ".join(text))]
    assert found(jaccard.connected(spark.createDataFrame(chain, "doc_id long, text string"))) == brute(chain)


def test_other_widths(spark, prose):
    got = jaccard.connected(spark.createDataFrame(prose[:60], "doc_id long, text string"), width=2, percent=50)
    assert found(got) == brute(prose[:60], 2, 50)


def test_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert found(jaccard.connected(edges.select("doc_id", "text"))) == [
        (i, n, i if not n else c) for i, n, c in brute(rows)
    ]
    kept = jaccard.one_of_each(edges)
    assert kept.columns == edges.columns
    assert jaccard.connected(nothing.select("doc_id", "text")).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 0 and ids.count(4) == 1 and ids.count(None) == 2


def test_many_short_sets_take_seconds():
    """Work grows with what sets share, not with the number of sets in the tree."""
    import time

    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 400_000, 8)) for _ in range(60_000)]
    for k in range(0, 2_000, 2):  # some that link
        sets[k + 1] = sets[k]
    begun = time.perf_counter()
    label = jaccard.link_sets(sets, np.array([len(s) for s in sets]), 80)
    assert time.perf_counter() - begun < 60
    assert all(label[k + 1] == label[k] == k for k in range(0, 2_000, 2))


def test_a_large_group_takes_seconds():
    import time

    base = np.arange(0, 600, 2)
    draw = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([np.delete(base, draw.integers(0, 300, 5)), draw.integers(0, 10_000, 5) * 2 + 1])) for _ in range(3_000)]
    begun = time.perf_counter()
    label = jaccard.link_sets(sets, np.array([len(s) for s in sets]), 80)
    assert time.perf_counter() - begun < 30 and len(np.unique(label)) == 1


@pytest.mark.parametrize("parts", [4, 5, 10, 100, 3_000])
def test_holds_are_dealt_over_all_parts(parts):
    holds = np.arange(2_110, dtype=np.uint64) * np.uint64(1_000_000)
    spots = np.bincount((jaccard.scramble(holds) % np.uint64(parts)).astype(np.int64), minlength=parts)
    assert spots.max() < 3 * 2_110 / parts + 8
