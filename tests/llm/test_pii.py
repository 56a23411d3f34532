import hashlib
import random
import re

import pytest

from rowloom.llm import pii


def base(text):
    """The base spans, one expression after the other."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


PARTS = [
    "a@b.c", "x@y@b.co", "a@b.c_d@e.f", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "0.0.0.0255",
    "4111-1111-1111-1111-1", " ", "-", "+", "+1 (017) 555-7713", "é", "🙂", "12345678901234", "9" * 25, "a", "%", "_", "@", ".",
]


def test_base_spans(spark):
    draw = random.Random(5)
    rows = [(k, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 8)))) for k in range(400)]
    rows += [(1000, "9 " * 60_000), (1001, "a" * 100_000), (1002, "+1" * 50_000), (1003, "1." * 50_000), (1004, "a@" * 30_000)]
    rows += [(1005, "4111111111111111 x " * 300)]
    texts = dict(rows)
    for r in pii.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:200]
        assert r.n_email == want.count("email") and r.n_card == want.count("card")


@pytest.mark.parametrize(
    "text, spans",
    [
        ("my account GB82 WEST 1234 5698 7654 32 here", "iban:11:38"),
        ("my account GB83 WEST 1234 5698 7654 32 here", ""),
        ("SSN 123-45-6789", "ssn:4:15"),
        ("number 123-45-6789", ""),
        ("call (555) 123-4567 now", "local_phone:5:19"),
        ("part (555) 123-4567 now", ""),
        ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret:9:49"),
        ("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", ""),
    ],
)
def test_checks_and_context(spark, text, spans):
    row = pii.summary(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.spans == spans and row.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_mask(spark):
    rows = spark.createDataFrame([(1, "é mail a@b.co, +1 (017) 555-7713 end")], "doc_id long, text string")
    assert pii.mask(rows).first().text == "é mail <email>, <phone> end"


def test_edges(edges, nothing):
    rows = pii.find(edges)
    assert rows.count() == edges.count() and set(rows.columns) == set(edges.columns)
    assert all(r.n_email == 0 for r in pii.summary(edges).collect())
    assert pii.summary(nothing).count() == 0


def test_plan_has_no_python(spark, edges):
    plan = pii.summary(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def added(text):
    """The further kinds by their definitions: spans that score 0.7 and touch no base span."""
    def digits_of(account):
        turned = account[4:] + account[:4]
        return int("".join(str(int(c, 36)) for c in turned))

    found = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?(?![A-Za-z0-9])", text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and digits_of(account) % 97 == 1:
            found.append((m.start(), m.end(), "iban", 0.8, 0.2, "iban|account|bank"))
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        found.append((m.start(), m.end(), "ssn", 0.3, 0.6, r"\bssn\b|social security"))
    for m in re.finditer(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", text):
        found.append((m.start(), m.end(), "local_phone", 0.3, 0.5, r"phone|\btel|call|mobile|fax"))
    for m in re.finditer(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])", text):
        found.append((m.start(), m.end(), "secret", 0.3, 0.5, r"token|secret|passw|api.?key|\bkey\b"))
    taken = [(int(s), int(e)) for _, s, e in (x.split(":") for x in base(text).split(",") if x)]
    out = []
    for start, end, name, score, more, words in found:
        near = text[max(0, start - 32) : start].lower()
        score = round(score + (more if re.search(words, near) else 0), 2)
        if score >= 0.7 and not any(s < end and start < e for s, e in taken):
            out.append((start, end, name, score))
    return out


TOKENS = [
    "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "DE89370400440532013000", "123-45-6789", "(555) 123-4567", "555.123.4567",
    "04dbebab91ab85687d33eeaaf9ac699e1188f962", "f" * 70, "account", "SSN", "Social Security", "call", "my phone", "token", "api key", "Password",
    "a@b.org", "4111 1111 1111 1111", "+1 555 123 4567", "10.0.0.1", "prose", "and more of it that goes on for long", "é", "\n",
]


def test_added_spans_order_and_scores_by_brute_force(spark):
    draw = random.Random(8)
    rows = [(k, " ".join(draw.choice(TOKENS) for _ in range(draw.randint(1, 9)))) for k in range(500)]
    texts, kinds = dict(rows), set()
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = [(s.start, s.end, s.kind, s.score) for s in r.pii]
        assert spans == sorted(spans, key=lambda s: s[0])
        more = [s for s in spans if s[2] in ("iban", "ssn", "local_phone", "secret")]
        assert sorted(more) == sorted(added(texts[r.doc_id])), texts[r.doc_id]
        assert ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans if (s, e, k, _) not in more) == base(texts[r.doc_id])
        kinds |= {s[2] for s in more}
    assert kinds == {"iban", "ssn", "local_phone", "secret"}
