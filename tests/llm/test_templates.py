import random
import re
from collections import defaultdict

import pytest

from rowloom.llm import templates

URLS = [
    None, "", "x", "://", "http://A.COM", "http://É.net/fr/x?y", "a://b://c/d", "http://com/", "http://xcom/", "http://net/fr/é/",
    "http://www.example.com/en/a", "http://www.example.com/en", "http://example.com/en/a", "http://m.example.com/en/a", "http://h/" + "a/" * 3_000,
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (host, path, best[0] + best[1], best[2]) if best else (host, path, None, "allow")


def run(spark, urls, bad=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS n", "2 AS parts", "3 AS bad")
    return templates.judge(pages, spark.createDataFrame(list(bad), "page_id long, bad boolean"))


def test_rules(spark):
    got = run(spark, URLS).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: expected(u) for i, u in enumerate(URLS)}


def test_impure_templates_are_rejected(spark):
    urls = [f"http://h.org/{kind}/{i}.html" for kind in ("news", "spam", "talk") for i in range(40)]
    bad = [(i, 40 <= i < 80) for i in range(0, 120, 2)]
    got = {r.page_id: r for r in run(spark, urls, bad).collect()}
    assert {r.template for r in got.values()} == {"/{news,talk}/*", "/spam/*"}
    assert all((r.verdict == "block") == (40 <= i < 80) for i, r in got.items())


def test_few_labels_decide_nothing(spark):
    urls = [f"http://h.org/spam/{i}" for i in range(40)]
    assert {r.verdict for r in run(spark, urls, [(0, True), (0, False), (None, True), (1, None)]).collect()} == {"allow"}


def test_repeated_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    assert templates.judge(pages, labels).count() == 3
    assert templates.judge(pages.where("false"), labels).count() == 0


def tree(pages, least_share=0.05, least_count=4, chance=2.0, strength=10.0):
    """Template and smoothed purity of each (host, path, bad), level by level in dictionaries."""
    rows = []
    for host, path, bad in pages:
        parts = re.sub("^/", "", path).split("/")
        if len(parts) > templates.DEPTH:
            parts = parts[: templates.DEPTH - 1] + ["/".join(parts[templates.DEPTH - 1 :])]
        rows.append([host, parts, "", bad])
    for level in range(templates.DEPTH):
        nodes = defaultdict(lambda: defaultdict(list))
        for host, parts, name, bad in rows:
            if level < len(parts):
                nodes[host, name][parts[level]].append(bad)
        names = {}
        for node, segments in nodes.items():
            total = sum(map(len, segments.values()))
            stay = []
            for segment, bads in segments.items():
                if len(bads) >= least_count and len(bads) >= least_share * total:
                    judged = [b for b in bads if b is not None]
                    rate = (sum(judged) + 0.5) / (len(judged) + 1)
                    stay.append((rate, segment, len(judged), rate * (1 - rate) / (len(judged) + 1)))
            groups = []
            for k, (rate, segment, judged, noise) in enumerate(sorted(stay)):
                before = sorted(stay)[k - 1] if k else None
                apart = before is None or not judged or not before[2] or (rate - before[0]) / (noise + before[3]) ** 0.5 > chance
                groups = [*groups, [segment]] if apart else [*groups[:-1], [*groups[-1], segment]]
            for group in groups:
                for segment in group:
                    names[node, segment] = group[0] if len(group) == 1 else "{" + ",".join(sorted(group)) + "}"
        for row in rows:
            if level < len(row[1]):
                row[2] += "/" + names.get(((row[0], row[2]), row[1][level]), "*")
    known = [b for *_, b in rows if b is not None]
    share = sum(known) / len(known) if known else 0.0
    by_host, by_template = defaultdict(list), defaultdict(list)
    for host, _, name, bad in rows:
        if bad is not None:
            by_host[host].append(bad)
            by_template[host, name].append(bad)
    out = []
    for host, _, name, _ in rows:
        around = (sum(by_host[host]) + strength * share) / (len(by_host[host]) + strength)
        mine = by_template[host, name]
        out.append((name, (sum(mine) + strength * around) / (len(mine) + strength), len(mine)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_tree_by_brute_force(spark, seed):
    draw = random.Random(seed)
    rows, bad = [], []
    for i in range(700):
        host = draw.choice(["a.org", "a.org", "b.net", "c.de"])
        top = draw.choice(["news", "spam", "talk", "shop", f"u{i}"])
        rest = draw.choice(["", f"/{i}", f"/{draw.choice(['x', 'y', 'z'])}/{i}", f"/x/{i % 3}/a/b/{i}"])
        rows.append(f"http://{host}/{top}{rest}")
        rate = {"spam": 0.9, "shop": 0.5}.get(top, 0.1)
        if draw.random() < 0.8:
            bad.append((i, draw.random() < rate))
    got = {r.page_id: r for r in run(spark, rows, bad).collect()}
    labels = {i: int(b) for i, b in bad}
    want = tree([(got[i].host, got[i].path, labels.get(i)) for i in range(700)])
    for i, (name, purity, n) in enumerate(want):
        assert (got[i].template, got[i].n_labels) == (name, n) and got[i].purity == pytest.approx(purity)
        assert got[i].verdict == ("block" if n >= 5 and purity >= 0.6 else "allow")
    assert {r.verdict for r in got.values()} == {"allow", "block"}  # no rule names these hosts: the tree decides


def test_labels_from_html(spark):
    pages = [
        (1, "<html><head><style>p{margin:0}</style><script>var t='<p>$$$';</script></head><body><p>Plain words &amp; more of them.</p></body></html>"),
        (2, "<p>" + "junk### words$$$ here%%% " * 9 + "</p>"), (3, None), (4, ""), (5, "<p></p>"), (6, "<div " + "x" * 200_000), (7, "<" * 200_000),
        (10, "words " + "<script>" * 30_000), (11, "words" + "<style>$$$</style>" * 10_000), (12, "&a" * 100_000),
        (8, "a" * 97 + "###"), (9, "a" * 98 + "##"),
    ]
    got = {r.page_id: r.bad for r in templates.labels_from_html(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: True, 6: False, 7: True, 8: True, 9: False, 10: False, 11: False, 12: True}
