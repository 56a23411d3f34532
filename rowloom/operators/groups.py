"""Assignment of users to groups by their email.

A rule is a pattern that must be found in the email. What a match can't do without is read
from the pattern's syntax: runs of plain letters (all of them), and for alternatives one run
of each (any of them). A rule is then looked up by pieces of three to eight letters: of each run
the piece that the fewest emails have, of the rule's requirements the one that the fewest emails
meet. Users meet only rules whose piece their email has; the pattern itself decides.

A piece is known by its letters as one number. Of an email only pieces are kept that a rule asks
for, or that a filter of fixed size takes for one; so emails are shuffled a few times each, not
once for every piece that they have.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowloom.session import materialise

#: letters of the pieces by which rules and emails are joined, at most eight; a run has pieces of the largest size it has room for
SIZES = (3, 4, 6, 8)
#: the filter of pieces has two to this power bits (16 MB), whatever the number of rules
FILTER_BITS = 27
#: bits that Spark's bitmap functions keep in one bitmap
BITMAP = 32768
#: emails are cut into pieces about so many bytes at once
CUT_BYTES = 1 << 16
#: rules that share a pattern are met so many at once
RULES_AT_ONCE = 1_000
#: into how many parts the users are dealt for rules that any email may fit, and for pieces of this many emails
OPEN_PARTS, COMMON = 64, 100_000
#: escapes of one letter that stand for no letter of their own, and those that take no room
CLASSES, EDGES = set("dDwWsShHvVRtnrfae"), set("bBAzZ")


class _Unread(Exception):
    """Syntax that isn't read; the pattern is tried on every email then."""


class _Reader:
    """Requirements of a pattern: a list of lists of runs, of each list one run must be there.

    Only plain syntax is read: letters, escapes, sets of letters, groups, alternatives and
    repetition. Lookaround, flags other than i, m and s, quotation, references, nested sets and
    named classes are left unread.
    """

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1 : self.at]

    def whole(self) -> list[list[str]]:
        if self.text.startswith("(?"):
            flags, closed, _rest = self.text[2:].partition(")")
            if closed and flags and set(flags) <= set("ims"):
                self.at = len(flags) + 3
        found = self.alternatives()
        if self.at < len(self.text):
            raise _Unread
        return found

    def alternatives(self) -> list[list[str]]:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        if not all(branches):
            return []
        # a match has all that one branch requires: for each branch its longest requirement
        best = [max(b, key=lambda runs: min(map(len, runs))) for b in branches]
        return [sorted({run for runs in best for run in runs})]

    def sequence(self) -> list[list[str]]:
        needs, run = [], ""
        while self.at < len(self.text) and self.peek() not in "|)":
            letter, inner = self.atom()
            least, once = self.repetition()
            if letter == "" and inner is None:  # takes no room
                continue
            if letter and once:
                run += letter
            elif letter and least:
                needs.append([run + letter])
                run = letter
            else:
                needs.append([run])
                run = ""
                if inner and least:
                    needs += inner
        needs.append([run])
        return [runs for runs in needs if all(runs)]

    def atom(self) -> tuple[str | None, list[list[str]] | None]:
        """(a plain letter; "" for what takes no room; None for any other, requirements inside)."""
        c = self.take()
        if c in "^$":
            return "", None
        if c == ".":
            return None, []
        if c == "(":
            return None, self.group()
        if c == "[":
            return self.letters(), []
        if c == "\\":
            return self.escaped(), ([] if self.text[self.at - 1] not in EDGES else None)
        if c in "*+?{":
            raise _Unread
        return c, []

    def group(self) -> list[list[str]]:
        if self.peek() == "?":
            self.take()
            if self.take() != ":":
                raise _Unread
        found = self.alternatives()
        if self.take() != ")":
            raise _Unread
        return found

    def escaped(self) -> str | None:
        c = self.take()
        if not c or (c.isalnum() and c not in CLASSES and c not in EDGES):
            raise _Unread
        return None if c in CLASSES else "" if c in EDGES else c

    def letters(self) -> str | None:
        """A set of letters; one of a single letter is that letter."""
        inside = []
        if self.peek() == "]" or self.text[self.at : self.at + 2] == "^]":
            raise _Unread
        while (c := self.take()) != "]":
            if c in ("", "[", "&"):
                raise _Unread
            if c == "\\":
                c += self.take()
                if c[1:].isalnum() and c[1:] not in CLASSES:
                    raise _Unread
            inside.append(c)
        if len(inside) == 1 and inside[0] != "^" and not inside[0][1:].isalnum():
            return inside[0][-1]
        return None

    def repetition(self) -> tuple[bool, bool]:
        """(at least once, exactly once)."""
        c = self.peek()
        if c == "{":
            said = self.text[self.at + 1 : self.text.find("}", self.at)] if "}" in self.text[self.at :] else ""
            low, comma, high = said.partition(",")
            if not low.isdigit() or not (high.isdigit() or not high):
                raise _Unread
            self.at += len(said) + 2
            least, once = int(low) > 0, low == "1" and (not comma or high == "1")
        elif c and c in "*+?":
            self.take()
            least, once = c == "+", False
        else:
            return True, True
        if self.peek() and self.peek() in "+?":  # possessive or reluctant
            self.take()
        if self.peek() and self.peek() in "*+?{":
            raise _Unread
        return least, once


def required_runs(pattern: str) -> list[list[str]]:
    """What every match must contain: of each list one of its runs, in ASCII lower case. Runs
    shorter than the smallest piece say too little and are left out with their list."""
    try:
        needs = _Reader(pattern).whole()
    except _Unread:
        return []
    plain = lambda run: max(re.split(r"[^\x00-\x7F]+", run), key=len).lower()
    kept = {tuple(sorted({plain(run) for run in runs})) for runs in needs}
    return sorted(list(runs) for runs in kept if all(len(run) >= SIZES[0] for run in runs))


def _pieces(run: str) -> list[str]:
    """The pieces of a run of ASCII letters; an email that has the run has all of them."""
    size = max(size for size in SIZES if size <= len(run))
    return [run[i : i + size] for i in range(len(run) - size + 1)]


def _key(piece: str) -> int:
    """The letters of a piece as one number, which is never negative."""
    return int.from_bytes(piece.encode("ascii"), "big")


_READ = T.StructType([T.StructField("runs", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("keys", T.ArrayType(T.LongType()))])


@F.pandas_udf(_READ)
def _read_patterns(patterns: pd.Series) -> pd.DataFrame:
    runs = patterns.map(required_runs)
    keys = [sorted({_key(piece) for need in needs for run in need for piece in _pieces(run)}) for needs in runs]
    return pd.DataFrame({"runs": runs, "keys": keys})


def _first_bit(keys: np.ndarray) -> np.ndarray:
    """The bit of the filter that is tried for all pieces of an email."""
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).view(np.int64)


def _second_bit(keys: np.ndarray) -> np.ndarray:
    """The bit that is tried for those of which the first is set."""
    return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS)).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bits(keys: pd.Series) -> pd.Series:
    numbers = keys.map(lambda of_pattern: np.asarray(of_pattern, dtype=np.uint64))
    return numbers.map(lambda of_pattern: np.concatenate([_first_bit(of_pattern), _second_bit(of_pattern)]))


def asked_pieces(patterns: DataFrame) -> Callable[[Column], Column]:
    """A function of lower-case emails: the keys of their pieces, each once, that are among the
    ``keys`` of any pattern, and a few more that the filter takes for one."""
    # Spark's bitmap functions count bits and parts from 1
    bits = patterns.filter(F.size("keys") > 0).select(F.explode(_bits("keys")).alias("bit")).withColumn("bit", F.col("bit") + 1)
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("part"))
    has = np.zeros(2**FILTER_BITS // 8, dtype=np.uint8)
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        begin = (row["part"] - 1) * (BITMAP // 8)
        has[begin : begin + BITMAP // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return F.arrow_udf(lambda emails: _cut(emails, has), T.ArrayType(T.LongType()))


def _cut(emails: pa.Array, has: np.ndarray) -> pa.Array:
    if not len(emails):
        return pa.array([], pa.list_(pa.int64()))
    wide = pa.types.is_large_string(emails.type)
    at = np.frombuffer(emails.buffers()[1], dtype=np.int64 if wide else np.int32)[emails.offset : emails.offset + len(emails) + 1]
    if len(emails) > 1 and at[-1] - at[0] > CUT_BYTES:
        half = len(emails) // 2
        return pa.concat_arrays([_cut(emails.slice(0, half), has), _cut(emails.slice(half), has)])
    letters = np.frombuffer(emails.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].astype(np.uint64)
    email = np.repeat(np.arange(len(emails)), np.diff(at))
    room = (at[1:] - at[0])[email] - np.arange(len(letters))
    found, window = [], letters
    for size in range(2, SIZES[-1] + 1):
        window = (window[:-1] << np.uint64(8)) | letters[size - 1 :]
        if size in SIZES:
            at_piece = np.flatnonzero(_is_set(has, _first_bit(window)))
            # within one email, and of ASCII letters only
            at_piece = at_piece[(room[at_piece] >= size) & (window[at_piece] & np.uint64(0x8080808080808080) == 0)]
            at_piece = at_piece[_is_set(has, _second_bit(window[at_piece]))]
            found.append((email[at_piece], window[at_piece]))
    owner, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(emails)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[new].astype(np.int64)))


def _is_set(has: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return has[bits >> 3] & (1 << (bits & 7)).astype(np.uint8) != 0


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces a rule is looked up by, from how many emails have each."""
    for rules in batches:
        chosen, common = [], []
        for runs, known in zip(rules["runs"], rules["known"], strict=True):
            emails = {} if known is None else {x["key"]: x["emails"] for x in known}
            best = None
            for need in runs:
                rarest = [min((emails.get(_key(piece), 0), piece) for piece in _pieces(run)) for run in need]
                cost = sum(n for n, _ in rarest)
                if best is None or cost < best[0]:
                    best = cost, sorted({piece for _, piece in rarest})
            chosen.append([] if best is None else best[1])
            common.append([emails.get(_key(piece), 0) >= COMMON for piece in chosen[-1]])
        keys = [[_key(piece) for piece in pieces] for pieces in chosen]
        any_piece = ["|".join(map(re.escape, pieces)) for pieces in chosen]
        yield pd.DataFrame({"pattern": rules["pattern"], "pieces": chosen, "keys": keys, "common": common, "any_piece": any_piece})


def _dealt(users: DataFrame) -> DataFrame:
    """A few files may hold very many emails, and each of them is cut into its pieces."""
    return users.repartition("user_id", "email")


def rule_letters(users: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pieces`` for each of the distinct ``patterns``: the letters of which every email that
    it fits has one, their ``keys``, which are ``common``, and a pattern that finds them. None for
    patterns that any email may fit."""
    read = patterns.select("pattern", _read_patterns("pattern").alias("of")).select("pattern", "of.*")
    read = materialise(read, "patterns")
    emails = _dealt(users).select(F.explode(asked_pieces(read)(F.lower("email"))).alias("key"))
    # pieces are many times what the planner takes them for, so no side of a join is broadcast
    emails = emails.groupBy("key").agg(F.count(F.lit(1)).alias("emails"))
    each = read.select("pattern", F.explode("keys").alias("key")).join(emails.hint("merge"), "key")
    known = each.groupBy("pattern").agg(F.collect_list(F.struct("key", "emails")).alias("known"))
    chosen = read.drop("keys").join(known.hint("merge"), "pattern", "left")
    return chosen.mapInPandas(_choose, "pattern string, pieces array<string>, keys array<bigint>, common array<boolean>, any_piece string")


def _together(rules: DataFrame) -> DataFrame:
    """``group_ids`` of the rules of each pattern, in lists of about a thousand at most."""
    shared = rules.groupBy("pattern").agg(F.ceil(F.count(F.lit(1)) / RULES_AT_ONCE).alias("_lists"))
    of_list = F.pmod(F.xxhash64("group_id"), F.col("_lists")).alias("_list")
    dealt = rules.join(shared.hint("merge"), "pattern").select("pattern", of_list, F.struct("group_id").alias("_rule"))
    lists = dealt.groupBy("pattern", "_list").agg(F.collect_list("_rule").alias("_rules"))
    return lists.select("pattern", F.col("_rules.group_id").alias("group_ids"))


def match_groups(users: DataFrame, groups: DataFrame) -> DataFrame:
    """(user_id, group_id) for sign-up groups whose pattern is found in the email.

    Emails and patterns meet by letters that a match can't do without; a pattern is tried once for
    every thousand rules that share it, which are met with it and need no join of their own.
    Patterns without such letters are tried on every email, as they must be; users are dealt into
    parts for that, so that no task tries all. There is no limit on rules of either kind, and no
    side of a join is held whole, by the driver or a task.
    """
    rules = (
        groups.filter(F.coalesce(F.col("add_to_user_on_signup"), F.lit(False)))
        .filter(F.coalesce(F.col("email_regex_match"), F.lit("")) != "")
        .select("group_id", F.col("email_regex_match").alias("pattern"))
        .distinct()
    )
    users = users.filter(F.col("email").isNotNull()).select("user_id", "email")
    looked = materialise(rule_letters(users, rules.select("pattern").distinct()), "letters")
    met_with = looked.join(_together(rules).hint("merge"), "pattern")
    # keys of pieces are never negative; all emails have the one of open patterns
    every = F.array(F.struct(F.lit("").alias("pieces"), F.lit(-1).cast("bigint").alias("keys"), F.lit(True).alias("common")))
    at = F.when(F.size("pieces") == 0, every).otherwise(F.arrays_zip("pieces", "keys", "common"))
    placed = met_with.select("pattern", "group_ids", "any_piece", "pieces", F.explode(at).alias("_at"))
    of_many = F.when(F.size("pieces") > 1, F.col("_at.pieces")).otherwise("").alias("_piece")
    parts = F.when(F.col("_at.common"), F.sequence(F.lit(0), F.lit(OPEN_PARTS - 1))).otherwise(F.array(F.lit(0)))
    placed = placed.select("pattern", "group_ids", "any_piece", of_many, F.col("_at.keys").alias("_key"), F.explode(parts).alias("_part"))
    # emails with a common piece are dealt into parts; few pieces are common, as an email has few
    common = looked.select(F.explode(F.arrays_zip("keys", "common")).alias("at")).filter("at.common").select("at.keys").distinct()
    dealt = F.col("_key").isin([-1] + [row["keys"] for row in common.collect()])
    part = F.when(dealt, F.pmod(F.xxhash64("user_id", "email"), F.lit(OPEN_PARTS))).otherwise(0).cast("int").alias("_part")
    keys = F.concat(asked_pieces(looked)(F.lower("email")), F.array(F.lit(-1).cast("bigint")))
    asked = _dealt(users).select("user_id", "email", F.explode(keys).alias("_key")).select("user_id", "email", "_key", part)
    # the rows of a task are few for what they give, so tasks aren't merged for having few
    tasks = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(tasks, "_key", "_part")
    # patterns first: a pattern is then read once for all emails of a piece
    met = placed.join(asked.hint("merge"), ["_key", "_part"])
    # an email that has several of a pattern's pieces meets it once, at the first of them
    once = (F.col("_piece") == "") | (F.expr("regexp_extract(lower(email), any_piece, 0)") == F.col("_piece"))
    return met.filter(F.expr("email rlike pattern")).filter(once).select("user_id", F.explode("group_ids").alias("group_id"))
