import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import suffix


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def training(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2


def tree_scores(rows):
    """States and smoothing by dictionaries, for corpora where every bound is two."""
    known, N = Counter(), 0
    texts = [tokens(t) for i, t in rows if training(i)]
    for t in texts:
        known.update(t)
    N, V = sum(known.values()), len(known)
    word = {w for w, c in known.items() if c >= max(2, suffix.WORD_SHARE * N)}
    context = {w for w in word if known[w] >= max(2, suffix.CONTEXT_SHARE * N)}
    root = lambda x: (known[x] + 1) / (N + V + 1)
    total, entry = Counter(), Counter()
    for t in texts:
        for k, x in enumerate(t):
            for s in (tuple(t[k - 1 : k]), tuple(t[k - 2 : k]) if k > 1 else ()):
                if s and all(w in context for w in s):
                    total[s] += 1
                    if x in word:
                        entry[s, x] += 1
    total = {s: n for s, n in total.items() if n >= max(2, suffix.STATE_SHARE * N)}
    entry = {k: n for k, n in entry.items() if n >= max(2, suffix.ENTRY_SHARE * N) and k[0] in total}
    held = Counter()
    for (s, _), n in entry.items():
        held[s] += n
    rest = {s: (n - held[s] + suffix.LAMBDA) / (n + suffix.LAMBDA) for s, n in total.items()}
    part = lambda s, x: entry.get((s, x), 0) / (total[s] + suffix.LAMBDA)

    def p(s, x):
        if not s:
            return root(x)
        return part(s, x) + rest[s] * p(s[1:], x) if s in total else p(s[1:], x)

    gain = Counter()
    for (s, x), n in entry.items():
        gain[s] += n * math.log(n / total[s] / p(s[1:], x))
    keep = {s for s in total if gain[s] >= suffix.LEAST_GAIN}
    keep |= {s[1:] for s in keep if len(s) == 2 and s[1:] in total}

    def kept(s, x):
        if not s:
            return root(x)
        return part(s, x) + rest[s] * kept(s[1:], x) if s in keep else kept(s[1:], x)

    out = {}
    for i, t in rows:
        w = tokens(t)
        score = sum(math.log10(kept(tuple(w[max(0, k - 2) : k]), x)) for k, x in enumerate(w))
        base = sum(math.log10(root(x)) for x in w)
        out[i] = (not training(i), len(w), sum(known[x] > 0 for x in w), N, base, score)
    return out, len(keep)


def corpus():
    rng = np.random.default_rng(4)
    words, rows = [f"w{k}" for k in range(30)], []
    for i in range(120):
        text, at = [], 0
        for _ in range(rng.integers(0, 120)):
            at = int((3 * at + 1) % 30) if rng.random() < 0.7 else int(rng.integers(30))
            text.append(words[at] if rng.random() < 0.97 else f"rare{rng.integers(1000)}")
        rows.append((i, " ".join(text)))
    return rows


def test_same_as_dictionaries(spark):
    rows = corpus()
    want, states = tree_scores(rows)
    assert states > 5
    got = suffix.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-9) and r.score == pytest.approx(w[5], abs=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def uncapped(rows, monkeypatch):
    """The scores if all words and pairs were held by every task."""
    with monkeypatch.context() as patch:
        for share in ("WORD_SHARE", "CONTEXT_SHARE", "ENTRY_SHARE"):
            patch.setattr(suffix, share, 0.0)
        return tree_scores(rows)[0]


def same_scores(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], abs=1e-6) and r.score == pytest.approx(w[5], abs=1e-6)


@pytest.mark.parametrize("words, entries", [(1e-6, 5e-3), (3e-3, 5e-3), (3e-3, 1.0)])
def test_what_tasks_hold_changes_no_score(spark, monkeypatch, words, entries):
    """Rarer words and pairs than every task holds are counted in parts, and lose nothing."""
    rows = corpus()
    after = np.random.default_rng(7).integers(0, 30, (20, 10))
    rows += [(200 + i, " ".join(f"w{i % 2} odd{(10 * i + k) % 40} w{after[i, k]}" for k in range(10))) for i in range(20)]
    want = uncapped(rows, monkeypatch)
    for name, value in (("WORD_SHARE", words), ("ENTRY_SHARE", entries), ("PER_PART", 900), ("HELD", 800), ("PER_ROW", 300)):
        monkeypatch.setattr(suffix, name, value, raising=False)
    same_scores(suffix.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), want)


def test_words_of_frequent_contexts_are_context_words(spark, monkeypatch):
    """A context of a share of STATE_SHARE is judged by its gain, however rare its words are."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 40, 1_000))) for i in range(200)]
    rows += [(200 + i, "seldom follows closely") for i in range(12)]
    want = uncapped(rows, monkeypatch)
    got = suffix.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same_scores(got, want)
    assert all(r.score > r.base_score + 3 for r in got if r.doc_id >= 200)


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = suffix.score(edges.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    known = Counter(x for i, t in rows if training(i) for x in tokens(t))
    n, v = sum(known.values()), len(known)
    want = sorted(sum(math.log10((known[x] + 1) / (n + v + 1)) for x in tokens(t)) for _, t in rows)
    assert sorted(r.base_score for r in got) == pytest.approx(want)
    assert suffix.score(nothing.select("doc_id", "text")).count() == 0
    only = spark.createDataFrame([(next(i for i in range(100) if not training(i)), "a b")], "doc_id long, text string")
    row = suffix.score(only).first()
    assert (row.train_tokens, row.n_known, row.base_score, row.score) == (0, 0, 0.0, 0.0)
