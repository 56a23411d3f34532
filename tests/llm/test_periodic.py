import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from rowloom.llm import periodic


def brute(words):
    """Runs by the definition: every period, every maximal stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = end + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def fibonacci(k):
    a, b = "a", "ab"
    for _ in range(k):
        a, b = b, b + a
    return b


def odd_words(draw):
    kind = draw.randrange(7)
    n = draw.randint(0, 140)
    if kind == 0:
        return [draw.choice("ab") for _ in range(n)]
    if kind == 1:
        return [draw.choice("abc") for _ in range(n)]
    if kind == 2:
        return ["a"] * n
    if kind == 3:  # runs in runs in runs
        inner = "a" * draw.randint(1, 9) + "b"
        middle = inner * draw.randint(1, 6) + draw.choice(["", "c", "a"])
        return list((middle * draw.randint(1, 7) + draw.choice(["", "d", "b"])) * draw.randint(1, 5))
    if kind == 4:
        return list(fibonacci(draw.randint(3, 9)))
    if kind == 5:
        period = [draw.choice("aab") for _ in range(draw.randint(1, 30))]
        head = [draw.choice("abx") for _ in range(draw.randint(0, 40))]
        body = (period * 9)[: draw.randint(1, 9 * len(period))]
        return head + body + [draw.choice("aby") for _ in range(draw.randint(0, 40))]
    return [str(bin(i).count("1") % 2) for i in range(n)] * draw.randint(1, 5)


def numbers(words):
    names = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_the_definition(seed):
    draw = random.Random(seed)
    for _ in range(250):
        words = odd_words(draw)
        assert [tuple(r) for r in periodic.find_runs(numbers(words))] == brute(words), words


def test_documents_searched_together_do_not_meet():
    draw = random.Random(3)
    docs = [odd_words(draw) for _ in range(200)]
    runs, collapsed = periodic._search([" ".join(x).encode() for x in docs])
    for words, mine, text in zip(docs, runs, collapsed, strict=True):
        assert [tuple(r) for r in mine] == brute(words)
        dropped = {i for s, length, q in brute(words) for i in range(s + q, s + length)}
        assert text.decode() == " ".join(w for i, w in enumerate(words) if i not in dropped)


@pytest.mark.parametrize(
    "words, count",
    [
        (["a"] * 60_000, 1),
        (["a"] * 30_000 + ["b"] + ["a"] * 30_000, 2),
        (list(fibonacci(22)), 0),  # no part of it repeats four times
        ((["a"] * 200 + ["b"]) * 300, 301),
    ],
)
def test_long_texts_take_seconds(words, count):
    assert len(periodic.find_runs(numbers(words))) == count


def test_suffix_array_and_successor():
    draw = random.Random(5)
    for _ in range(50):
        ids = numbers([draw.choice("ab") for _ in range(draw.randint(1, 60))])
        suffixes = periodic.Suffixes(ids)
        assert suffixes.array.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:].tolist())
        tree = periodic.WaveletTree(suffixes.array)
        low, high = sorted((draw.randint(0, len(ids)), draw.randint(0, len(ids))))
        for least in range(len(ids) + 3):
            want = min((x for x in suffixes.array[low:high].tolist() if x >= least), default=-1)
            one = lambda x: np.array([x])
            assert tree.successor(one(low), one(high), one(least))[0] == want


def test_every_period_has_one_block_size():
    covered = [q for k in range(1, 12) for q in range(periodic.periods_of(1 << k)[0], periodic.periods_of(1 << k)[1] + 1)]
    assert covered == list(range(1, covered[-1] + 1))
    for k in range(1, 12):
        size = 1 << k
        for q in range(*periodic.periods_of(size)):
            assert 2 * size + q - 1 <= max(6, 4 * q)


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_report(spark, edges, nothing):
    draw = random.Random(9)
    rows = [(i, draw.choice([" ", "\n", "\t "]).join(odd_words(draw))) for i in range(400)]
    got = periodic.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(expected(*r) for r in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    short = edges.where("doc_id is null or doc_id <> 8")
    assert sorted(map(str, map(tuple, periodic.report(short).collect()))) == sorted(
        str(expected(r.doc_id, r.text)) for r in short.collect()
    )
    assert periodic.report(nothing).count() == 0


def test_find_keeps_columns(edges, nothing):
    clash = edges.selectExpr("*", "'mine' AS runs", "'mine' AS words", "'mine' AS Words_")
    got = periodic.find(clash)
    assert got.columns == [*edges.columns, "words", "Words_", "runs", "collapsed"]
    long = got.where("doc_id = 8").first()
    assert [tuple(r) for r in long.runs] == [(0, 20_000, 1)] and long.collapsed == "word" and long.words == "mine"
    assert got.count() == edges.count()
    assert periodic.find(nothing).count() == 0
