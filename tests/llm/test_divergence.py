import re
from collections import Counter

import numpy as np

from rowloom.llm import divergence


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    marked = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


def fields(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_distance():
    p, q = np.array([1.0, 0, 3]), np.array([0, 2.0, 0])
    assert divergence.distance(p, p) == 0 and abs(divergence.distance(p, q) - 1) < 1e-12
    a, b = p / 4, np.array([0.5, 0.25, 0.25])
    m = (a + b) / 2
    by_hand = sum(x * np.log2(x / y) for x, y in zip(a, m) if x) / 2 + sum(x * np.log2(x / y) for x, y in zip(b, m)) / 2
    assert abs(divergence.distance(p, b) - np.sqrt(by_hand)) < 1e-12


def test_junk_is_far_and_short_texts_are_spared(spark):
    rng = np.random.default_rng(2)
    words = ["the", "of", "and", "to", "in"] + [f"{a}{b}ing" for a in "bcdfghjkl" for b in "aeiou"]
    weight = np.array([9, 7, 6, 5, 5] + [1] * 45, float)
    draw = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    rows = [(i, draw(300), "en") for i in range(60)]
    rows += [(100 + i, " ".join(w + "$%&" for w in draw(300).split()), "en") for i in range(3)]
    rows += [(200 + i, draw(25), "en") for i in range(20)]
    got = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in list(range(60)) + list(range(200, 220)))
    assert not any(got[100 + i].kept or got[100 + i].base_failed for i in range(3))
    for i, text, _ in rows:
        assert fields(got[i]) == base(text)


def test_edges(edges, nothing):
    got = divergence.judge(edges)
    rows = got.collect()
    assert len(rows) == edges.count()
    for r in rows:
        assert fields(r) == base(r.text)
        assert r.kept in (True, False) and (not r.base_failed or not r.kept)
    assert divergence.judge(nothing).count() == 0


def far(text, n, chars, words_far, chars_far):
    """The verdict's limits, written out."""
    return chars_far > 0.19 + 2.0 / max(1, chars) ** 0.5 or words_far > 0.33 + 1.2 / max(1, n) ** 0.5


def js(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return max(0.0, (half(p, q) + half(q, p)) / 2) ** 0.5


def kind(c):
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n\v\f", ".,;:!?", "'\"()[]{}-", "#*$%&|<>"]
    return next((k for k, g in enumerate(groups) if c in g), 8 if c < "\x80" else 9)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_verdict_and_distances_by_brute_force(spark):
    rng = np.random.default_rng(7)
    vocabulary = {"en": [f"{a}{b}" for a in "bcdfgh" for b in ("ing", "est", "Or", "a")] + ["the", "of"], "fr": [f"{a}é{b}" for a in "lmnprst" for b in "aeiou"] + ["le", "là"]}
    rows = []
    for i in range(160):
        lang = ["en", "fr", None][i % 3] if i % 11 else "xx"
        own = vocabulary.get(lang, vocabulary["en"])
        words = [own[int(k)] for k in rng.zipf(1.3, int(rng.integers(5, 400))) % len(own)]
        if i % 9 == 4:
            words = [w + "#$%"[k % 3] * 4 for k, w in enumerate(words)]
        if i % 13 == 5:
            words = [vocabulary["fr" if lang == "en" else "en"][k % 20] for k in range(len(words))]
        rows.append((i, (" " if i % 2 else "\n").join(words) + ("." if i % 5 else "\t1999!"), lang))
    rows += [(500, None, "en"), (501, "", None)]
    classes, counts = {}, {}
    for _, text, lang in rows:
        classes.setdefault(lang, Counter()).update(kind(c) for c in text or "")
        counts.setdefault(lang, Counter()).update(re.findall(r"[^\x20\x09-\x0D]+", lower(text or "")))
    got = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    verdicts = set()
    for i, text, lang in rows:
        text, failed = text or "", base(text)[5]
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        common = sorted(counts[lang], key=lambda w: (-counts[lang][w], w.encode()))[:50]
        in_reference = [counts[lang][w] for w in common]
        in_text = [words.count(w) for w in common]
        mine = Counter(map(kind, text))
        by_chars = js([mine[k] for k in range(10)], [classes[lang][k] for k in range(10)]) if len(text) >= 200 else 0.0
        by_words = js([*in_text, len(words) - sum(in_text)], [*in_reference, sum(counts[lang].values()) - sum(in_reference)]) if len(words) >= 60 else 0.0
        assert abs(got[i].js_chars - by_chars) < 1e-9 and abs(got[i].js_words - by_words) < 1e-9
        assert got[i].kept == (not failed and not far(text, len(words), len(text), by_words, by_chars))
        verdicts.add((failed, got[i].kept))
    assert verdicts == {(True, False), (False, False), (False, True)}
