"""Periodic runs: stretches of words that repeat with some period, at least four times over.

Internal pattern matching. The words of some documents lie one after another, and every
document has word numbers of its own, so that no match leaves a document.

* Suffix array by prefix doubling. Only suffixes that are not yet alone are sorted on; the
  class of each position is kept for every power of two, so longest common extensions of two
  positions, forward and backward, are found from the highest power down.
* Dyadic blocks: a run of period q holds a block of ``size`` words, a power of two of about q,
  that begins at a multiple of ``size`` and occurs again q words later. Its occurrences are
  an interval of the suffix array; a wavelet tree over the array gives the next one at or after
  a position (range successor), and so those in the window in which q may lie.
* Occurrences at most half a block apart form a progression, whose difference is the block's
  own period. It is passed over as a whole: where the stretches of that period around the block
  and around the progression end, left and right, tell the only two distances at which the
  block may lie in one run with a member of the progression. So a block has a few candidates,
  however often it occurs.
* A candidate (position, period) is extended both ways; stretches that are long enough are
  runs. Those found with a multiple of their period are found with the period as well, so the
  smallest period of a stretch is its own.

The work grows as words times the logarithm of their number, also in texts of one word.

Cases: a null or empty text has no words and no runs. Texts are taken whole; a text's memory is
about 100 bytes a word while its batch is at work. Rows are judged on their own, so ids may be
null or repeat. A caller's columns stay, but for ones named like those added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowloom.llm.common import SPACE, per_batch, prepare, raw, unused, whole, without

#: a run has at least so many words, and so many times its period
LEAST, TIMES = 6, 4
#: words that are searched at once; a longer text is searched alone
WORDS_AT_ONCE = 300_000

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Suffixes:
    """Suffix array of ``ids``, and the classes of equal substrings of each power of two.

    A class is named by its first place in the array. ``repeated[k]`` has the positions whose
    2**k words occur elsewhere too, in the array's order, and ``sizes[k]`` their class sizes.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.array = np.argsort(ids, kind="stable").astype(np.int64)
        self.classes, self.repeated, self.sizes, self.places = [], [], [], []
        names, places, keys = np.zeros(n + 1, np.int32), np.arange(n), ids[self.array]
        names[n] = -1  # behind the last word
        while len(places):
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(heads, len(places)))
            names[self.array[places]] = np.repeat(places[heads], sizes)
            sizes = np.repeat(sizes, sizes)
            places, sizes = places[sizes > 1], sizes[sizes > 1]
            if not len(places):
                return
            here = self.array[places]
            self.classes.append(names.copy())
            self.repeated.append(here)
            self.sizes.append(sizes)
            self.places.append(places)
            # of equal substrings all lie in one document, so that what follows the end is
            # another document's class or nothing, and never equal
            follow = names[np.minimum(here + (1 << (len(self.classes) - 1)), n)]
            keys = names[here].astype(np.int64) * (n + 2) + follow + 1
            order = np.argsort(keys, kind="stable")
            self.array[places], keys = here[order], keys[order]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and from ``j`` > i on."""
        i, j = i.copy(), j.copy()
        first, n = i.copy(), len(self.array)
        for k in reversed(range(len(self.classes))):
            same = self.classes[k][np.minimum(i, n)] == self.classes[k][np.minimum(j, n)]
            same &= j < n
            i[same] += 1 << k
            j[same] += 1 << k
        return i - first

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words right before ``i`` and right before ``j`` > i."""
        i, j = i.copy(), j.copy()
        first = i.copy()
        for k in reversed(range(len(self.classes))):
            step = 1 << k
            same = (i >= step) & (self.classes[k][np.maximum(i - step, 0)] == self.classes[k][np.maximum(j - step, 0)])
            i[same] -= step
            j[same] -= step
        return first - i


class WaveletTree:
    """Range successor over an array of numbers, as a tree laid out level by level."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros, self.split = [], []
        for bit in reversed(range(self.bits)):
            ones = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~ones], values[ones]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value >= ``least`` in the places [low, high) of the array; -1: none."""
        smaller, a, b = np.zeros(len(low), np.int64), low, high
        for k, zeros in enumerate(self.zeros):
            up = (least >> (self.bits - 1 - k)) & 1 == 1
            za, zb = zeros[a], zeros[b]
            smaller += np.where(up, zb - za, 0)
            a, b = np.where(up, self.split[k] + a - za, za), np.where(up, self.split[k] + b - zb, zb)
        none = (smaller >= high - low) | (least >> self.bits > 0)
        rank, value, a, b = np.where(none, 0, smaller), np.zeros(len(low), np.int64), low, high
        for k, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            up = rank >= zb - za
            rank = np.where(up, rank - (zb - za), rank)
            value = value * 2 + up
            a, b = np.where(up, self.split[k] + a - za, za), np.where(up, self.split[k] + b - zb, zb)
        return np.where(none, -1, value)


def periods_of(size: int) -> tuple[int, int]:
    """The periods whose runs are found by blocks of ``size`` words, smallest and largest.

    A run of 4 q words holds an aligned block and its copy q words later if
    2 * size + q - 1 <= 4 * q; each period goes to the largest such size.
    """
    return -((1 - 2 * size) // 3), -((1 - 4 * size) // 3) - 1


def candidates(suffixes: Suffixes, tree: WaveletTree, level: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods that blocks of 2**level words propose."""
    size = 1 << level
    shortest, longest = periods_of(size)
    aligned = suffixes.repeated[level] % size == 0
    s = suffixes.repeated[level][aligned]
    low = place[suffixes.classes[level][s]]
    high = low + suffixes.sizes[level][aligned]
    least, found_at, found = s + shortest, [], []
    while len(s):
        p = tree.successor(low, high, least)
        go = (p >= 0) & (p <= s + longest)
        s, low, high, p = s[go], low[go], high[go], p[go]
        if not len(s):
            break
        after = tree.successor(low, high, p + 1)
        many = (after >= 0) & (after - p <= size // 2)
        found_at.append(s[~many])
        found.append((p - s)[~many])
        least = p + 1
        if many.any():
            at, first, step = s[many], p[many], (after - p)[many]
            end = first + step + suffixes.forward(first, first + step)
            left = suffixes.backward(first, first + step) - suffixes.backward(at, at + step)
            own_end = at + step + suffixes.forward(at, at + step)
            found_at += [at, at, at]
            found += [step, first - at - left, end - own_end]
            least[many] = end - size + 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, period = np.concatenate(found_at), np.concatenate(found)
    fit = (period >= 1) & (period <= longest)
    return at[fit], period[fit]


def find_runs(ids: np.ndarray) -> np.ndarray:
    """Runs of ``ids`` as rows (start, length, period), by start and then period."""
    none = np.empty((0, 3), np.int64)
    if len(ids) < LEAST:
        return none
    suffixes = Suffixes(ids)
    if len(suffixes.classes) < 2:
        return none
    # the places of the array that repeated blocks of two words take, renumbered
    place = np.zeros(len(ids) + 1, np.int64)
    place[suffixes.places[1]] = np.arange(len(suffixes.places[1]))
    tree = WaveletTree(suffixes.array[suffixes.places[1]])
    got = [candidates(suffixes, tree, level, place) for level in range(1, len(suffixes.classes))]
    at, period = (np.concatenate(x) for x in zip(*got, strict=True))
    start = at - suffixes.backward(at, at + period)
    length = at + period + suffixes.forward(at, at + period) - start
    enough = length >= np.maximum(LEAST, TIMES * period)
    rows = np.column_stack([start, length, period])[enough]
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for words that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _search(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and the collapsed text of each text of a batch."""
    split, runs, collapsed = [x.split() for x in texts], [], []
    begin = 0
    while begin < len(split):
        stop, words = begin, 0
        while stop < len(split) and (stop == begin or words + len(split[stop]) <= WORDS_AT_ONCE):
            words += len(split[stop])
            stop += 1
        some = split[begin:stop]
        counts = np.fromiter(map(len, some), np.int64, len(some))
        flat = pa.array([w for x in some for w in x], pa.binary()).dictionary_encode()
        ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids += np.repeat(np.arange(len(some)), counts) * (len(flat.dictionary) + 1)
        found = find_runs(ids)
        cuts = np.searchsorted(found[:, 0], starts)
        for k, doc in enumerate(some):
            mine = found[cuts[k] : cuts[k + 1]] - np.array([starts[k], 0, 0])
            runs.append(mine)
            if len(mine):
                doc = [doc[i] for i in np.flatnonzero(kept_words(len(doc), mine))]
            collapsed.append(b" ".join(doc))
        begin = stop
    return runs, collapsed


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``runs`` (start, length, period in words, by start and then
    period) and ``collapsed``: the words of the text without repetitions, joined by one space."""
    prepare(docs.sparkSession)
    docs = without(docs, "runs", "collapsed")
    words = unused(docs, "words")

    def make():
        def compute(batch: pa.RecordBatch) -> dict:
            runs, collapsed = _search(batch.column(words).to_pylist())
            flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
            fields = [pa.array(flat[:, k]) for k in range(3)]
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            packed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, RUN.names))
            return {"runs": packed, "collapsed": pa.array(collapsed, pa.string())}

        return compute

    added = [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return per_batch(docs.withColumn(words, raw(text)), make, added, docs.columns)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, of equal ones the first; null if none.

    Cross products compare the quotients; runs come by start and then period.
    """
    better = lambda best, run: best["period"].isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    nothing = F.lit(None).cast(RUN)
    return F.reduce(runs, nothing, lambda best, run: F.when(better(best, run), run).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` where every tenth document (by checksum of its id) repeats some of its words to
    its end, from a place and with a period that follow from the checksum."""
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(whole("text"), SPACE), lambda x: x != "")
    n, g = F.size(words), F.floor(draw / 10)
    begin = (g % n).cast("int")
    period = (F.lit(1) + F.floor((n - begin) / (F.lit(3) + g % 8))).cast("int")
    times = F.ceil((n - begin) / period).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, begin + 1, period), times))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), begin), F.slice(again, F.lit(1), n - begin)), " ")
    return docs.withColumn("text", F.when((draw % 10 == 0) & (n > 0), text).otherwise(F.col("text")))


def report(docs: DataFrame) -> DataFrame:
    """Runs of the documents with planted repetitions, as digests."""
    found = find(planted(docs.select("doc_id", "text")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
