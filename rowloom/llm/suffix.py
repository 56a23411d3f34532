"""LM scoring: a probabilistic suffix tree over words.

States are contexts of one or two words. A context is kept when it is frequent (a share of
``STATE_SHARE`` of all tokens, twice at least) and its next-word distribution differs from that of
its suffix: the gain in log-likelihood over all its occurrences (count times Kullback-Leibler
divergence) must reach ``LEAST_GAIN``. The suffix of a kept context is kept too. Next words are
those seen twice or more in a context. Their distributions are smoothed with the suffix's:

    P(x | s) = n(s, x) / (n(s) + L) + rest(s) * P(x | suffix of s)
    rest(s)  = (n(s) - sum of the n(s, x) held + L) / (n(s) + L)

and at the root (c(x) + 1) / (N + V + 1). A word is scored in its longest kept context.

Counts cover every training text whole, and all of them are used, for gains and for scores. What
every task holds is bounded by shares of N, alike at every size: words of a share of
``WORD_SHARE`` (so at most 1/WORD_SHARE of them), context words of ``CONTEXT_SHARE`` (no rarer word
can be in a frequent context), pairs of context and word of ``ENTRY_SHARE``. Counts of rarer words
and rarer pairs are dealt by hash to parts: of a rare word by the word, of a rare pair by its last
two words, or by all three where those two are held. A part so has all that a probability
needs, and answers with each document's sums; no table of all words or pairs is ever in one place.

Texts are split into words twice: to count words, and to store them as ids of held words and hashes
of others. Words are told apart by 64-bit hashes. A-Z are lower-cased; an end follows the words of each
document. Cases: a null or empty text is an end only. A null id counts as empty text for the
split. Without training texts N and V are 0 and every score is 0. Rows that share an id are
scored one by one. Other columns don't matter. ``docs`` should be a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import Remembered, hashed, prepare, raw, scramble
from rowloom.session import materialise

WORD_SHARE, STATE_SHARE, ENTRY_SHARE = 1e-6, 2e-5, 1e-6
# the words of a frequent context are as frequent themselves
CONTEXT_SHARE = STATE_SHARE
LEAST_GAIN, LAMBDA, LEAST_SEEN = 30.0, 5.0, 2
HELD, PER_PART, HELD_DOCS, PER_ROW = 1_000_000, 1_500_000, 60_000, 100_000
#: parts that sums by state (at most 2 / STATE_SHARE of them) are dealt to
SLICES = 16
END = b""
RARE = np.uint64(1 << 63)
X_BITS, W_BITS, S_BITS = 20, 16, 17
X_MASK = (1 << X_BITS) - 1


def _tokens(data: bytes) -> list[bytes]:
    words = data.lower().split()
    words.append(END)
    return words


def _by_part(values: np.ndarray, parts: int):
    """(part, rows of the part) of the values."""
    part = (scramble(values) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    if len(by):
        cuts = np.flatnonzero(np.diff(part[by], prepend=-1))
        for rows in np.split(by, cuts[1:]):
            yield int(part[rows[0]]), rows


COUNTS = "part long, keys binary, counts binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of longs and binaries."""
    columns = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(columns)], names=[name for name, _ in columns]
    )


def _counting(keys_of, parts: int):
    """Deal the counted keys of each hold of training texts to their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of_batch, pending, held = keys_of(), [], 0

        def rows():
            keys, counts = np.unique(np.concatenate(pending), return_counts=True)
            out = [(p, keys[r].tobytes(), counts[r].astype(np.uint32).tobytes()) for p, r in _by_part(keys.view(np.uint64), parts)]
            return _batch(out, COUNTS)

        for batch in batches:
            for keys in keys_of_batch(batch):
                pending.append(keys)
                held += len(keys)
                if held >= HELD:
                    yield rows()
                    pending, held = [], 0
        if held:
            yield rows()

    return run


def _summed(least: float):
    """One part: keys of at least ``least`` occurrences; key null: distinct keys and sum of all."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"]])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in rows["counts"]]).astype(np.int64)
        keys, back = np.unique(keys, return_inverse=True)
        sums = np.bincount(back, weights=counts).astype(np.int64)
        often = sums >= least
        out = pd.DataFrame({"key": pd.array(keys[often].view(np.int64), dtype="Int64"), "n": sums[often], "distinct": 0})
        return pd.concat([out, pd.DataFrame({"key": pd.array([pd.NA], dtype="Int64"), "n": [sums.sum()], "distinct": [len(keys)]})])

    return run


def _count(docs: DataFrame, keys_of, parts: int, least: float, name: str) -> DataFrame:
    dealt = docs.mapInArrow(_counting(keys_of, parts), COUNTS)
    return materialise(dealt.groupBy("part").applyInPandas(_summed(least), "key long, n long, distinct long"), name)


@dataclass(frozen=True)
class Words:
    """Held words. They have ids from 1 on, by falling count; ``count`` has theirs at id - 1."""

    hashes: np.ndarray  # sorted
    ids: np.ndarray  # of the hashes
    count: np.ndarray
    n: int
    distinct: int
    contexts: int  # ids up to here are context words

    def word_ids(self) -> Remembered:
        """Id of a held word; else its hash with the highest bit set."""

        def make(word: bytes) -> int:
            h = xxhash.xxh64_intdigest(word)
            at = int(np.searchsorted(self.hashes, np.uint64(h)))
            if at < len(self.hashes) and int(self.hashes[at]) == h:
                return int(self.ids[at])
            return h | (1 << 63)

        return Remembered(make)


@dataclass(frozen=True)
class Tree:
    """The model. A state is 0 (the root), the id of a context word, or ``contexts`` + 1 + the place
    in ``pairs`` of a context of two; arrays by state have an item for each frequent one."""

    count: np.ndarray  # of word ids, at id - 1
    n: int
    distinct: int
    contexts: int
    pairs: np.ndarray  # sorted: w2 << W_BITS | w1
    total: np.ndarray  # by state
    rest: np.ndarray | None = None  # by state: the mass left to the suffix
    longest: np.ndarray | None = None  # by state: the longest kept one that ends it
    entries: np.ndarray | None = None  # sorted: state << X_BITS | x
    share: np.ndarray | None = None  # n(s, x) / (n(s) + L)
    all_held: bool = False  # whether no entry is left out of ``entries``

    def last(self, state: np.ndarray) -> np.ndarray:
        """Last word of each state, which is its suffix as a state."""
        one = np.concatenate([np.arange(self.contexts + 1), self.pairs & ((1 << W_BITS) - 1)])
        return one[state]

    def states(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The longest frequent state at each token."""
        at = _position(self.pairs, two << W_BITS | one)
        return np.where(at >= 0, self.contexts + 1 + at, one)

    def root(self, x: np.ndarray, seen: np.ndarray | int = 0) -> np.ndarray:
        """P(x) of word ids, and of rarer words (>= RARE) that were seen so often."""
        rare = x >= RARE
        c = np.zeros(len(x)) + seen
        c[~rare] = self.count[x[~rare].astype(np.int64) - 1]
        return (c + 1.0) / (self.n + self.distinct + 1.0)


def _position(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value, or -1."""
    if not len(sorted_):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


CODED = "doc_id array<long>, held_out array<boolean>, sizes binary, codes binary, rares binary"


def _coding(held: Broadcast):
    """Texts as ids of held words, 0 for others, and the hashes of those; some texts a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, docs, outs, coded, size = held.value.word_ids(), [], [], [], 0

        def row():
            v = np.concatenate(coded)
            rare = v >= RARE
            made = [np.array([len(c) for c in coded], np.int64), np.where(rare, 0, v).astype(np.uint32), v[rare]]
            lists = [pa.array([docs], pa.list_(pa.int64())), pa.array([outs], pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays(lists + [pa.array([m.tobytes()]) for m in made], names=[c.split()[0] for c in CODED.split(", ")])

        for batch in batches:
            for i, out_of, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "data"))):
                docs.append(i)
                outs.append(out_of)
                coded.append(hashed(_tokens(data), memory))
                size += len(coded[-1])
                if size >= PER_ROW or len(docs) >= HELD_DOCS:
                    yield row()
                    docs, outs, coded, size = [], [], [], 0
        if docs:
            yield row()

    return run


def _coded(batch: pa.RecordBatch, training: bool):
    """(ids of documents, whether they are held out, sizes, words) of each row."""
    for k in range(batch.num_rows):
        docs, outs, *arrays = (batch.column(c)[k].as_py() for c in ("doc_id", "held_out", "sizes", "codes", "rares"))
        sizes, codes, rares = (np.frombuffer(a, t) for a, t in zip(arrays, (np.int64, np.uint32, np.uint64)))
        v = codes.astype(np.uint64)
        v[v == 0] = rares
        if training:
            learn_from = ~np.array(outs, bool)
            v, sizes = v[np.repeat(learn_from, sizes)], sizes[learn_from]
        if len(v):
            yield docs, outs, sizes, v


def _before(sizes: np.ndarray, v: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """The context words one and two before each token, 0 where there is none."""
    w = np.where(v <= np.uint64(contexts), v, 0).astype(np.int64)
    one, two = np.zeros_like(w), np.zeros_like(w)
    one[1:], two[2:] = w[:-1], w[:-2]
    starts = np.cumsum(sizes) - sizes
    one[starts] = two[starts] = 0
    two[np.minimum(starts + 1, len(two) - 1)] = 0
    return one, two


def _pair_keys(contexts: int):
    """The contexts of two words, each time that a token follows."""

    def start():
        def keys(batch: pa.RecordBatch):
            for _, _, sizes, v in _coded(batch, training=True):
                one, two = _before(sizes, v, contexts)
                both = (one > 0) & (two > 0)
                yield two[both] << W_BITS | one[both]

        return keys

    return start


DEALT = "kind int, part long, keys binary, states binary, counts binary, seen binary"


def _split(keys: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and states of keys: state << X_BITS | id, and at the end rare words, with ``states``."""
    plain = len(keys) - len(states)
    x, state = keys.copy(), np.zeros(len(keys), np.int64)
    x[:plain] &= np.uint64(X_MASK)
    state[:plain] = (keys[:plain] >> np.uint64(X_BITS)).astype(np.int64)
    state[plain:] = states
    return x, state


def _distinct(x: np.ndarray, state: np.ndarray, last: np.ndarray, n: np.ndarray):
    """(first row, place) of distinct words and states, by word and last word of the state, and sums
    of ``n`` for each: its own, with other states of that last word, and with all of the word."""
    _, rank = np.unique(x, return_inverse=True)
    packed = (rank.astype(np.int64) << W_BITS | last) << S_BITS | state
    packed, first, place = np.unique(packed, return_index=True, return_inverse=True)
    own = np.bincount(place, weights=n, minlength=len(packed)).astype(np.int64)
    sums = [own]
    for bits in (S_BITS, S_BITS + W_BITS):
        _, group = np.unique(packed >> bits, return_inverse=True)
        sums.append(np.bincount(group, weights=own).astype(np.int64)[group])
    return first, place, *sums


def _dealing_entries(model: Broadcast, parts: int):
    """Deal each word in its longest frequent context, counted in each hold of training texts: by
    the word if it is rare, else by the word and the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, pending, held = model.value, [], 0

        def rows():
            plain, plain_n = np.unique(np.concatenate([p[0] for p in pending]), return_counts=True)
            x, state = (np.concatenate([p[k] for p in pending]) for k in (1, 2))
            by = np.lexsort((state, x))
            x, state = x[by], state[by]
            new = np.flatnonzero((np.diff(x, prepend=~x[:1]) != 0) | (np.diff(state, prepend=-1) != 0)) if len(x) else np.zeros(0, np.int64)
            rare_n = np.diff(new, append=len(x))
            x, state = x[new], state[new]
            at, word = plain >> X_BITS, plain & X_MASK
            spot = np.concatenate([(tree.last(at) << X_BITS | word).astype(np.uint64), x])
            keys, counts = np.concatenate([plain.astype(np.uint64), x]), np.concatenate([plain_n, rare_n]).astype(np.uint32)
            states = np.concatenate([at, state]).astype(np.uint32)
            out = []
            for p, r in _by_part(spot, parts):
                out.append((0, p, keys[r].tobytes(), states[r[r >= len(plain)]].tobytes(), counts[r].tobytes(), None))
            return _batch(out, DEALT)

        for batch in batches:
            for _, _, sizes, v in _coded(batch, training=True):
                state, rare = tree.states(*_before(sizes, v, tree.contexts)), v >= RARE
                plain = ~rare & (state > 0)
                pending.append((state[plain] << X_BITS | v[plain].astype(np.int64), v[rare], state[rare]))
                held += len(v)
                if held >= HELD:
                    yield rows()
                    pending, held = [], 0
        if held:
            yield rows()

    return run


def _by_slice(kind: int, sums: np.ndarray) -> list[tuple]:
    """Rows of sums by state, dealt to slices."""
    states = np.flatnonzero(sums)
    return [
        (kind, k, states[states % SLICES == k].astype(np.int64).tobytes(), None, sums[states[states % SLICES == k]].tobytes(), None)
        for k in range(SLICES)
    ]


def _entries(model: Broadcast):
    """One part: entries seen often enough (kind 0), and sums of their counts by state (kind 1)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree = model.value
        split = [_split(np.frombuffer(k, np.uint64), np.frombuffer(s, np.uint32)) for k, s in zip(rows["keys"], rows["states"])]
        x, state = (np.concatenate([s[k] for s in split]) for k in (0, 1))
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in rows["counts"]])
        first, _, own, by_last, by_word = _distinct(x, state, tree.last(state), counts)
        x, state = x[first], state[first]
        last = tree.last(state)
        # rows are ordered by word and last word: of each such group one entry has its suffix
        new = np.flatnonzero((np.diff(x, prepend=~x[:1]) != 0) | (np.diff(last, prepend=-1) != 0))
        ones, twos = new[(last[new] > 0) & (by_last[new] >= LEAST_SEEN)], np.flatnonzero((state > tree.contexts) & (own >= LEAST_SEEN))
        at = np.concatenate([ones, twos])
        states, n = np.concatenate([last[ones], state[twos]]), np.concatenate([by_last[ones], own[twos]])
        held = np.bincount(states, weights=n, minlength=len(tree.total)).astype(np.int64)
        made = [(0, int(rows["part"].iloc[0]), x[at].tobytes(), states.tobytes(), n.tobytes(), by_word[at].tobytes())]
        return pd.DataFrame(made + _by_slice(1, held), columns=[c.split()[0] for c in DEALT.split(", ")])

    return run


def _slice_sums(rows: pd.DataFrame) -> pd.DataFrame:
    states, sums = (np.concatenate([np.frombuffer(b, np.int64) for b in rows[c]]) for c in ("keys", "counts"))
    states, back = np.unique(states, return_inverse=True)
    out = np.zeros(len(states), np.int64)
    np.add.at(out, back, sums)
    return pd.DataFrame({"state": states, "n": out})


def _by_state(dealt: DataFrame, kind: int, states: int) -> np.ndarray:
    got = dealt.where(F.col("kind") == kind).groupBy("part").applyInPandas(_slice_sums, "state long, n long").toArrow()
    out = np.zeros(states, np.int64)
    out[got.column("state").to_numpy()] = got.column("n").to_numpy()
    return out


#: gains are summed as whole numbers of this unit, so that the order of tasks doesn't matter
GAIN_UNIT = 1e-6


def _gains(model: Broadcast, least: float):
    """Each part's gains by state (kind 1) and its entries that every task shall hold (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = model.value
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["keys"], np.uint64)
                state, n, seen = (np.frombuffer(row[c], np.int64) for c in ("states", "counts", "seen"))
                last = tree.last(state)
                root = tree.root(x, seen)
                _, word = np.unique(x, return_inverse=True)
                place = word.astype(np.int64) << W_BITS | last
                one = state <= tree.contexts
                p_one = n[one] / (tree.total[state[one]] + LAMBDA) + tree.rest[state[one]] * root[one]
                by = np.argsort(place[one])
                below = root.copy()
                below[~one] = p_one[by][_position(place[one][by], place[~one])]
                gain = np.bincount(state, weights=n * np.log(n / tree.total[state] / below), minlength=len(tree.total))
                often = n >= least
                held = (state[often] << X_BITS | x[often].astype(np.int64)).tobytes()
                out = _by_slice(1, np.rint(gain / GAIN_UNIT).astype(np.int64))
                yield _batch(out + [(2, row["part"], held, None, n[often].tobytes(), None)], DEALT)

    return run


def _held_words(texts: DataFrame, parts: int) -> Words:
    def words_of():
        memory = Remembered(xxhash.xxh64_intdigest)
        return lambda batch: (hashed(_tokens(data), memory) for data in batch.column("data").to_pylist())

    counted = _count(texts, words_of, parts, 2, "word-counts")
    sums = counted.where("key IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    total, distinct = int(sums[0]), int(sums[1])
    got = counted.where((F.col("key").isNotNull()) & (F.col("n") >= WORD_SHARE * total)).select("key", "n").toArrow()
    hashes, counts = got.column("key").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy()
    by = np.lexsort((hashes, -counts))
    hashes, counts = hashes[by], counts[by]
    # words of such a share are at most 1 / CONTEXT_SHARE, which W_BITS hold
    contexts = int((counts >= max(2.0, CONTEXT_SHARE * total)).sum())
    ids = np.argsort(hashes)
    return Words(hashes[ids], ids + 1, counts, total, distinct, contexts)


def learn(coded: DataFrame, words: Words, parts: int) -> Tree:
    """The tree of the training texts among ``coded``."""
    context = coded.sparkSession.sparkContext
    pairs = _count(coded, _pair_keys(words.contexts), parts, max(2.0, STATE_SHARE * words.n), "pair-counts")
    got = pairs.where("key IS NOT NULL").select("key", "n").toArrow()
    pair, n = got.column("key").to_numpy().astype(np.int64), got.column("n").to_numpy()
    by = np.argsort(pair)
    # a word is a context each time that it occurs, as an end follows at least
    total = np.concatenate([[0], words.count[: words.contexts], n[by]]).astype(np.int64)
    tree = Tree(words.count, words.n, words.distinct, words.contexts, pair[by], total)
    model = context.broadcast(tree)
    dealt = coded.mapInArrow(_dealing_entries(model, parts), DEALT)
    entries = materialise(dealt.groupBy("part").applyInPandas(_entries(model), DEALT), "entries")
    tree = replace(tree, rest=(total - _by_state(entries, 1, len(total)) + LAMBDA) / (total + LAMBDA))
    model, least = context.broadcast(tree), max(float(LEAST_SEEN), ENTRY_SHARE * words.n)
    gained = materialise(entries.where("kind = 0").mapInArrow(_gains(model, least), DEALT), "gains")
    kept = _by_state(gained, 1, len(total)) * GAIN_UNIT >= LEAST_GAIN
    kept[tree.last(np.flatnonzero(kept))] = True
    kept[0] = True
    state = np.arange(len(total))
    last = tree.last(state)
    longest = np.where(kept, state, np.where(kept[last], last, 0))
    got = gained.where("kind = 2").select("keys", "counts").collect()
    keys, n = (np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(r[c], np.int64) for r in got]) for c in ("keys", "counts"))
    stays = kept[keys >> X_BITS]
    keys, n = keys[stays], n[stays]
    by = np.argsort(keys)
    share = n[by] / (total[keys[by] >> X_BITS] + LAMBDA)
    return replace(tree, longest=longest, entries=keys[by], share=share, all_held=least <= LEAST_SEEN)


SCORED = (
    "kind int, part long, hold long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "idx binary, tokens binary, states binary, counts binary, logs binary"
)
NAMES = [c.split()[0] for c in SCORED.split(", ")]


def _chance(tree: Tree, x: np.ndarray, state: np.ndarray, root: np.ndarray, n_one=0, n_two=0):
    """P(x | state), for entries that aren't held by their counts; and which of the two were held."""
    p, last, plain = root.copy(), tree.last(state), x < RARE
    at = np.where(plain, x, 0).astype(np.int64)
    held = []
    for s, on, n in ((last, last > 0, n_one), (state, state > tree.contexts, n_two)):
        place = np.where(plain & on, _position(tree.entries, s << X_BITS | at), -1)
        n = np.where(np.greater_equal(n, LEAST_SEEN), n, 0) / (tree.total[s] + LAMBDA)
        share = np.where(place >= 0, tree.share[place], n) if len(tree.share) else n
        p = np.where(on, share + tree.rest[s] * p, p)
        held.append(place >= 0)
    return p, *held


def _scoring(model: Broadcast, parts: int):
    """Documents scored by the tree (kind 0), and their rare words and entries dealt to parts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, task, holds = model.value, TaskContext.get().partitionId(), 0
        docs, outs, sizes, words, held = [], [], [], [], 0

        def rows():
            hold = task * 1_000_000 + holds
            spot = int(scramble(np.array([hold], np.uint64))[0] % np.uint64(parts))
            lengths, v = np.concatenate(sizes), np.concatenate(words)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            state = tree.longest[tree.states(*_before(lengths, v, tree.contexts))]
            rare = v >= RARE
            # each word in its state once
            key, back = np.unique(state[~rare] << X_BITS | v[~rare].astype(np.int64), return_inverse=True)
            s, x = key >> X_BITS, (key & X_MASK).astype(np.uint64)
            root, last = tree.root(x), tree.last(s)
            p, one, two = _chance(tree, x, s, root)
            asks = ((last > 0) & ~one | (s > tree.contexts) & ~two) & (not tree.all_held)
            sums = [np.bincount(doc[~rare], weights=w[back], minlength=len(lengths)) for w in (np.log10(root), np.where(asks, 0.0, np.log10(p)))]
            known = np.bincount(doc[~rare], minlength=len(lengths))
            blank = (None,) * 4
            out = [
                (0, spot, hold, *d, np.uint16(k).tobytes(), *blank)
                for k, d in enumerate(zip(docs, outs, lengths.tolist(), known.tolist(), sums[0].tolist(), sums[1].tolist()))
            ]
            # one question per word, state and document, with its number of occurrences
            asked = asks[back]
            plain, plain_n = np.unique(back[asked].astype(np.int64) << 16 | doc[~rare][asked], return_counts=True)
            at = plain >> 16
            names, rank = np.unique(v[rare], return_inverse=True)
            packed, rare_n = np.unique((rank.astype(np.int64) << S_BITS | state[rare]) << 16 | doc[rare], return_counts=True)
            name, rare_state = names[packed >> S_BITS + 16], (packed >> 16) & ((1 << S_BITS) - 1)
            by = np.where(one, key, last << X_BITS | (key & X_MASK)).astype(np.uint64)[at]
            tokens, states = np.concatenate([key[at].astype(np.uint64), name]), np.concatenate([s[at], rare_state]).astype(np.uint32)
            idx = (np.concatenate([plain, packed]) & 0xFFFF).astype(np.uint16)
            train = 1 - np.array(outs, np.int64)[idx]
            counts = (np.concatenate([plain_n, rare_n]) << 1 | train).astype(np.uint32)
            for part, r in _by_part(np.concatenate([by, name]), parts):
                of_rare = states[r[r >= len(plain)]]
                out.append((1, part, hold, *(None,) * 6, idx[r].tobytes(), tokens[r].tobytes(), of_rare.tobytes(), counts[r].tobytes(), None))
            return _batch(out, SCORED)

        for batch in batches:
            for ids, out_of, lengths, v in _coded(batch, training=False):
                if len(docs) + len(ids) > HELD_DOCS or held + len(v) > HELD and docs:
                    if docs:
                        yield rows()
                    holds += 1
                    docs, outs, sizes, words, held = [], [], [], [], 0
                docs, outs = docs + ids, outs + out_of
                sizes.append(lengths)
                words.append(v)
                held += len(v)
        if docs:
            yield rows()

    return run


def _answer(model: Broadcast):
    """One part: chances of its words and entries from their counts in training texts; sums per document."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree = model.value
        asked, out = rows[rows["kind"] == 1], [rows[rows["kind"] == 0]]
        if len(asked):
            split = [_split(np.frombuffer(k, np.uint64), np.frombuffer(s, np.uint32)) for k, s in zip(asked["tokens"], asked["states"])]
            x, state = (np.concatenate([s[k] for s in split]) for k in (0, 1))
            idx = [np.frombuffer(i, np.uint16) for i in asked["idx"]]
            counts = np.concatenate([np.frombuffer(c, np.uint32) for c in asked["counts"]]).astype(np.int64)
            n, train = counts >> 1, counts & 1
            first, place, own, by_last, by_word = _distinct(x, state, tree.last(state), n * train)
            x, state = x[first], state[first]
            rare, root = x >= RARE, tree.root(x, by_word)
            p, _, _ = _chance(tree, x, state, root, by_last, own)
            known = n * (rare & (by_word > 0))[place]
            base, logs = n * np.where(rare, np.log10(root), 0.0)[place], n * np.log10(p)[place]
            end, made = 0, []
            for hold, i in zip(asked["hold"], idx):
                mine = slice(end, end + len(i))
                end += len(i)
                docs, at = np.unique(i, return_inverse=True)
                of_docs = [np.bincount(at, weights=w[mine]) for w in (known, base, logs)]
                made.append((1, hold, docs.tobytes(), of_docs[0].astype(np.uint32).tobytes(), np.concatenate(of_docs[1:]).tobytes()))
            out.append(pd.DataFrame(made, columns=["kind", "hold", "idx", "counts", "logs"]))
        done = pd.concat([f.reindex(columns=NAMES).astype(object) for f in out])
        return done.where(done.notna(), None)

    return run


def _gathered(n: int):
    """One hold: the documents' own sums and the answers about their rare words and entries."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs = rows[rows["kind"] == 0]
        spots = np.array([np.frombuffer(x, np.uint16)[0] for x in docs["idx"]], np.int64)
        size = int(spots.max()) + 1 if len(spots) else 0
        logs, known = np.zeros((2, size)), np.zeros(size, np.int64)
        # answers in a fixed order, so that sums of fractions agree from run to run
        for _, i, c, x in sorted(zip(*(rows.loc[rows["kind"] == 1, k] for k in ("part", "idx", "counts", "logs"))), key=lambda r: (r[1], r[3])):
            at = np.frombuffer(i, np.uint16)
            known[at] += np.frombuffer(c, np.uint32)
            logs[:, at] += np.frombuffer(x, np.float64).reshape(2, -1)
        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].to_numpy(),
                "held_out": docs["held_out"].to_numpy(bool),
                "n_tokens": docs["n_tokens"].to_numpy(np.int64),
                "n_known": docs["n_known"].to_numpy(np.int64) + known[spots],
                "train_tokens": n,
                "base_score": docs["base"].to_numpy(float) + logs[0][spots],
                "score": docs["score"].to_numpy(float) + logs[1][spots],
            }
        )

    return run


def score(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score
    and score, learning from the rows that aren't held out."""
    spark = prepare(docs.sparkSession)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), raw("text").alias("data"))
    volume = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(1, ceil(volume / 6 / PER_PART))
    words = _held_words(rows.where("NOT held_out").select("data"), parts)
    coded = materialise(rows.mapInArrow(_coding(spark.sparkContext.broadcast(words)), CODED), "coded-texts")
    tree = learn(coded, words, parts)
    model = spark.sparkContext.broadcast(tree)
    dealt = coded.mapInArrow(_scoring(model, parts), SCORED)
    answered = dealt.groupBy("part").applyInPandas(_answer(model), SCORED)
    result = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return answered.groupBy("hold").applyInPandas(_gathered(tree.n), result)
