import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowloom.operators.groups import asked_pieces, match_groups, required_runs, rule_letters
from rowloom.operators.updates import derive_mappings, missing_items, update_back
from rowloom.schemas import LINKS, MAPPINGS, NODES

RESULTS = f"item_id string, outputs map<string,string>, mappings {MAPPINGS}, completed_at int"


def test_update_back(spark):
    items = spark.createDataFrame(
        [("a", {"x": "0"}), ("b", {"x": "0"}), ("c", {"x": "0"}), ("d", None)], "item_id string, fields map<string,string>"
    )
    both = [("o", "x"), ("p", "new")]
    results = spark.createDataFrame(
        [
            ("a", {"o": "late", "p": None}, both, 2), ("a", {"o": "early", "p": "1"}, both, 1),
            ("b", {"other": "1"}, both, 1), ("d", {"p": "1"}, both, 1), ("gone", {"o": "1"}, both, 1),
        ],
        RESULTS,
    )
    got = {r["item_id"]: (r["fields"], r["updated"]) for r in update_back(items, results).collect()}
    assert got == {
        "a": ({"x": "late", "new": None}, True), "b": ({"x": "0"}, False), "c": ({"x": "0"}, False),
        "d": ({"new": "1"}, True),
    }
    assert [r[0] for r in missing_items(items, results).collect()] == ["gone"]


def test_two_sources_into_one_field_take_the_later_mapping(spark):
    items = spark.createDataFrame([("a", {"x": "0"})], "item_id string, fields map<string,string>")
    results = spark.createDataFrame([("a", {"o": "1", "p": "2"}, [("p", "x"), ("o", "x")], 1)], RESULTS)
    assert update_back(items, results).first()["fields"] == {"x": "1"}


def test_derive_mappings(spark):
    node = lambda i, kind: (i, kind, "")
    link = lambda handle, target, into: ("n", handle, target, into)
    scripts = spark.createDataFrame(
        [
            ("two", [node("n", "ACTION"), node("u", "UPDATE_VALUES"), node("v", "UPDATE_VALUES")],
             [link("A", "u", "first"), link("B", "v", "other"), link("A", "u", "last"), link("C", "u", ""), link("D", "u", "d")]),
            ("none", [node("n", "ACTION")], [link("A", "n", "x")]),
            ("bare", [], []),
            ("null", None, None),
        ],
        f"object_id string, nodes {NODES}, links {LINKS}",
    )
    got = sorted((r["object_id"], r["source"], r["target"]) for r in derive_mappings(scripts).collect())
    assert got == [("two", "A", "last"), ("two", "D", "d")]


def test_items_without_an_id_are_left_alone(spark):
    items = spark.createDataFrame([("unknown", {"x": "0"}), ("a", {"x": "0"})], "item_id string, fields map<string,string>")
    results = spark.createDataFrame([(k, {"o": "1"}, [("o", "x")], 1) for k in ("unknown", "a")], RESULTS)
    got = {r["item_id"]: r["fields"]["x"] for r in update_back(items, results).collect()}
    assert got == {"unknown": "0", "a": "1"}
    assert [r[0] for r in missing_items(items, results).collect()] == ["unknown"]


def matched(spark, users, rules):
    users = spark.createDataFrame(users, "user_id bigint, email string")
    groups = spark.createDataFrame(rules, "group_id string, email_regex_match string, add_to_user_on_signup boolean")
    return sorted((r["user_id"], r["group_id"]) for r in match_groups(users, groups).collect())


def test_match_groups(spark):
    users = [(1, "ann@x.org"), (2, "bob@y.org"), (3, None), (4, "")]
    rules = [
        ("x", "@x", True), ("b", "^b", True), ("all", ".", True), ("off", ".", False), ("blank", "", True), ("null", None, True),
        ("ann", "ann@", True), ("zero", "ann?z*", True), ("either", "bob|ann", True), ("start", "^bob@y[.]", True), ("not", "^nn@", True),
        ("none", "$", True), ("case", "(?i)ANN@X", True), ("upper", "ANN", True), ("twice", "(ann|x[.]org|org)", True),
    ]
    assert matched(spark, users, rules) == [
        (1, "all"), (1, "ann"), (1, "case"), (1, "either"), (1, "none"), (1, "twice"), (1, "x"), (1, "zero"),
        (2, "all"), (2, "b"), (2, "either"), (2, "none"), (2, "start"), (2, "twice"), (4, "none"),
    ]
    assert matched(spark, users, []) == [] and matched(spark, [], rules) == []


@pytest.mark.parametrize(
    "pattern, runs",
    [
        ("[0-9]+@shop", [["@shop"]]), ("abc", [["abc"]]), ("ab", []), ("abcd?", [["abc"]]), ("abc*de", []), ("abcc+de", [["abcc"], ["cde"]]),
        ("(foo|barn)@", [["barn", "foo"]]), ("(foo|b)@", []), ("foo|bar", [["bar", "foo"]]), ("a(?:bcd)efg", [["bcd"], ["efg"]]),
        ("(?:bcd)?efg", [["efg"]]), ("(?:bcd){2,}efg", [["bcd"], ["efg"]]), ("x\\.org$", [["x.org"]]), ("x[.]org", [["x.org"]]), ("[a]bc", [["abc"]]),
        ("\\Qabc\\E", []), ("(?=abc)def", []), ("(?x)a b c", []), ("(?i)ABC", [["abc"]]), ("[a-z&&[^b]]abc", []), ("\\bjoe\\b", [["joe"]]),
        ("abc\\ddef", [["abc"], ["def"]]), ("\\x41bcd", []), ("ab{3}cd", [["bcd"]]), ("naïve@x", [["ve@x"]]), ("(a(bcd|efgh)+i|jkl)", [["bcd", "efgh", "jkl"]]),
    ],
)
def test_required_runs(pattern, runs):
    assert required_runs(pattern) == runs


def test_matches_have_what_their_pattern_requires():
    draw = random.Random(6)

    def made(depth=0):
        parts = []
        for _ in range(draw.randint(1, 5)):
            atom = draw.choice(["abc", "b", "ca", "@", "[.]", "\\.", "[ab]", "[^c]", ".", "\\w"] + ["("] * (depth < 2))
            if atom == "(":
                atom = draw.choice(["(", "(?:"]) + "|".join(made(depth + 1) for _ in range(draw.randint(1, 3))) + ")"
            elif len(atom) > 1 and atom.isalpha():
                parts.append(atom)
                continue
            often = ["", "", "?", "{2}", "{0,1}", "{1,2}"] + ["*", "+", "+?"] * (depth == 0 and atom[0] != "(")
            parts.append(atom + draw.choice(often))  # nothing endless inside a group, or search takes forever
        return "".join(parts)

    met = 0
    for _ in range(3_000):
        pattern = draw.choice(["", "^"]) + made() + draw.choice(["", "$"])
        needs = required_runs(pattern)
        for _ in range(20):
            email = "".join(draw.choice("abc@.") for _ in range(draw.randint(0, 12)))
            if re.search(pattern, email):
                met += 1
                assert all(any(run in email for run in runs) for runs in needs), (pattern, email)
    assert met > 2_000


def test_many_rules_of_both_kinds(spark):
    """Rules are looked up by their rarest letters, so hardly any user meets a rule in vain; and
    there may be any number of rules without letters."""
    users = [(i, f"user{i:04}@shop{i % 7}.com") for i in range(400)]
    rules = [(f"g{i}", f"[0-9]+@shop{i}[.]|^user{i:04}@", True) for i in range(600)]
    opened = [(f"o{i}", f"{i % 10}{i // 10 % 10}@", True) for i in range(1_100)]
    want = [(u, g) for u, email in users for g, pattern, _ in rules + opened if re.search(pattern, email)]
    assert matched(spark, users, rules + opened) == sorted(want)
    patterns = spark.createDataFrame([(p,) for _, p, _ in rules], "pattern string")
    letters = rule_letters(spark.createDataFrame(users, "user_id bigint, email string"), patterns).collect()
    assert all(r["pieces"] for r in letters)
    tried = sum(any(piece in email for piece in r["pieces"]) for r in letters for _, email in users)
    assert tried < len(users) * len(rules) / 20


def test_no_side_of_a_match_is_broadcast(spark):
    """The planner takes exploded letters for as small as their emails, and would hold them whole."""
    users = spark.createDataFrame([(1, "ann@x.org"), (1, "ann@x.org"), (2, "bob@y.org")], "user_id bigint, email string")
    rules = [(f"g{i}", pattern, True) for i, pattern in enumerate(["ann@", "ann@", "@x.org", "[ab]", "[ab]"])]
    found = match_groups(users, spark.createDataFrame(rules, "group_id string, email_regex_match string, add_to_user_on_signup boolean"))
    got = sorted((r["user_id"], r["group_id"]) for r in found.collect())
    assert got == sorted([(1, f"g{i}") for i in range(5)] * 2 + [(2, "g3"), (2, "g4")])
    plan = found._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rules_are_looked_up_by_long_pieces(spark):
    """Three letters of a number are in many emails, so rules for one user each met more of them the
    more users there were."""
    users = [(i, f"c{i}@shop.example.com") for i in range(1_000, 4_000)]
    patterns = spark.createDataFrame([(f"(c{i}@|u{i}@)[a-z]+[.]example",) for i in range(1_000, 4_000, 10)], "pattern string")
    letters = rule_letters(spark.createDataFrame(users, "user_id bigint, email string"), patterns).collect()
    assert len(letters) == 300 and all(r["pieces"] for r in letters)
    assert sum(any(piece in email for piece in r["pieces"]) for r in letters for _, email in users) == 300


def test_rules_that_share_a_pattern_are_met_in_lists(spark):
    """No join follows the match, whatever the number of rules; a file of many emails is dealt out."""
    rules = [(f"g{i}", "ann@", True) for i in range(2_500)] + [(None, "ann@", True), ("open", "[ab]", True), (None, "[ab]", True)]
    groups = spark.createDataFrame(rules + rules[:50], "group_id string, email_regex_match string, add_to_user_on_signup boolean")
    users = spark.createDataFrame([(1, "ann@x.org"), (None, "joann@x.org"), (2, "bob@y.org")], "user_id bigint, email string").coalesce(1)
    found = match_groups(users, groups)
    got = Counter((r["user_id"], r["group_id"]) for r in found.collect())
    assert got == Counter([(u, g) for u in (1, None) for g, _, _ in rules] + [(2, "open"), (2, None)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Generate explode(group_ids") and "RepartitionByExpression [user_id" in plan


def test_pieces_of_emails_are_those_that_are_asked_for(spark):
    draw = random.Random(4)
    patterns = spark.createDataFrame([(["abc", "b@c.", "a.b@cb", "a.b@cbac"],), (["abc"],), ([],)], "pieces array<string>")
    asked = {p: int.from_bytes(p.encode(), "big") for p in ("abc", "b@c.", "a.b@cb", "a.b@cbac")}
    keys = F.transform("pieces", lambda p: F.conv(F.hex(p), 16, 10).cast("bigint"))
    of_email = asked_pieces(patterns.select(keys.alias("keys")))
    emails = ["", "ab", "abc", "éabc", "日本abcé", "abcabc", "\0abc"] + ["xa.b@cbac"] * 20_000
    emails += ["".join(draw.choice("ab@c.é") for _ in range(draw.randint(0, 60))) for _ in range(5_000)]
    table = spark.createDataFrame([(x,) for x in emails], "email string")
    got = table.select("email", of_email(F.col("email")).alias("keys")).collect()
    assert Counter(r["email"] for r in got) == Counter(emails)
    for r in got:
        # the filter may take a piece for one that is asked for; with four of them it doesn't
        assert sorted(r["keys"]) == sorted(key for piece, key in asked.items() if piece in r["email"]), r
    assert sum(len(r["keys"]) for r in got) > 40_000
