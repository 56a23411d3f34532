"""N-gram Jaccard join: linked documents by a prefix tree over globally ordered sets.

Two documents link when their sets of n-word shingles have a Jaccard similarity of at least
``percent``/100. The global order of shingles is: rare ones first, then by hash.

1. Every text becomes its set of shingle hashes. They are dealt by hash to parts of bounded
   size, and each part answers which of its shingles occur in several documents, and in how
   many. That is all a join needs to know: shingles of one document only never meet.
2. A document with more lone shingles than a link allows has no partner. For the others, two
   that link share one of their first shingles (the prefix that a link can't avoid), so each
   document is tied to the smallest one that has the same prefix shingle; the connected
   pieces of these ties are blocks, and links stay inside blocks.
3. In a block the ordered sets are held in a prefix tree. A document walks down it, adding
   up overlaps once for all sets that share a path, and leaves subtrees whose remaining
   length can't bring the overlap that a link needs. Sets already connected are skipped, so
   a large group of near copies costs about as many steps as it has members.

Equal sets count as one (their class). Blocks over ``BLOCK_TOKENS`` are dealt to several
trees; see ``_large_blocks``. Shingles are told apart by 64-bit hashes of their words, of
which 48 bits and the shingle's frequency are kept in the join.

Cases: a null text counts as empty. A text without words has no shingles and links with
nothing; one with fewer words than a shingle is one shingle. Rows that share an id count as
documents of their own with the same id. Other columns don't matter. ``docs`` should be a
stored table, since it is read again if an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rowloom.llm.common import hashed, prepare, raw, rolling, scramble, unused, word_hashes
from rowloom.llm.graph import components
from rowloom.session import materialise

#: shingles that a task holds before it deals them out, and that a part gets on average
HELD, PER_PART = 1_500_000, 1_500_000
#: documents a task holds at most (their number in the hold takes 16 bits)
HELD_DOCS = 60_000
#: a shingle in so many documents of one hold is sent once, with its number
OFTEN = 4
#: shingles in one prefix tree
BLOCK_TOKENS = 1_000_000
LOW = np.uint64((1 << 48) - 1)
MOST_DF = (1 << 15) - 1

DEALT = "kind int, part long, hold long, doc_id long, n long, digest long, idx binary, tokens binary, df binary"


def shingle_set(data: bytes, width: int, memory) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (bytes; A-Z are lower-cased)."""
    return np.unique(rolling(hashed(data.lower().split(), memory), width))


def _deal(width: int, parts: int):
    """Documents to rows by part: kind 0 a document, 1 shingles with their documents,
    2 shingles found often in this hold (to the part), 3 the same with their documents (kept
    for the hold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, task, holds = word_hashes(), TaskContext.get().partitionId(), 0
        ids, sizes, digests, sets, held = [], [], [], [], 0

        def rows():
            hold = task * 1_000_000 + holds
            spot = int(scramble(np.array([hold], np.uint64))[0] % np.uint64(parts))
            out = [(0, spot, hold, i, n, d, np.uint16(k).tobytes(), None) for k, (i, n, d) in enumerate(zip(ids, sizes, digests))]
            tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            idx = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            order = np.argsort(tokens, kind="stable")
            tokens, idx = tokens[order], idx[order]
            first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]) != 0) if len(tokens) else np.zeros(0, np.int64)
            count = np.diff(first, append=len(tokens))
            often = np.repeat(count >= OFTEN, count)
            if often.any():
                out.append((3, spot, hold, None, None, None, idx[often].tobytes(), tokens[often].tobytes()))
            heads, number = tokens[first[count >= OFTEN]], count[count >= OFTEN].astype(np.uint16)
            for kind, values, extra in ((1, tokens[~often], idx[~often]), (2, heads, number)):
                part = (scramble(values) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[by], prepend=-1))
                for rows_of in np.split(by, cuts[1:]) if len(by) else []:
                    low = values[rows_of].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    out.append((kind, int(part[rows_of[0]]), hold, None, None, None, extra[rows_of].tobytes(), low.tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            names = ["kind", "part", "hold", "doc_id", "n", "digest", "idx", "tokens", "df"]
            return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(out), pa.binary())], names=names)

        for batch in batches:
            for i, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist()):
                s = shingle_set(data, width, memory)
                ids.append(i)
                sizes.append(len(s))
                digests.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                sets.append(s)
                held += len(s)
                if held >= HELD or len(sets) >= HELD_DOCS:
                    yield rows()
                    holds += 1
                    ids, sizes, digests, sets, held = [], [], [], [], 0
        if ids:
            yield rows()

    return run


def _low(tokens: bytes) -> np.ndarray:
    """48-bit values from their bytes."""
    raw6 = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw6), 8), np.uint8)
    out[:, :6] = raw6
    return out.view("<u8").ravel()


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One part: for each hold its shingles that several documents have, with their number."""
    through = rows[rows["kind"].isin((0, 3))]
    asked = rows[rows["kind"].isin((1, 2))]
    out = [through]
    if len(asked):
        tokens = [_low(t) for t in asked["tokens"]]
        extra = [np.frombuffer(x, np.uint16) for x in asked["idx"]]
        lengths = [len(t) for t in tokens]
        flat, idx = np.concatenate(tokens), np.concatenate(extra)
        kind = np.repeat(asked["kind"].to_numpy(), lengths)
        weight = np.where(kind == 2, idx, 1).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=~flat[order][:1]) != 0)
        total = np.add.reduceat(weight[order], first)
        df = np.empty(len(flat), np.int64)
        df[order] = np.repeat(total, np.diff(first, append=len(flat)))
        shared, ends = df > 1, np.cumsum(lengths)
        made = []
        for (k, hold), hi, size in zip(asked[["kind", "hold"]].itertuples(index=False), ends, lengths):
            pick = np.flatnonzero(shared[hi - size : hi]) + hi - size
            if len(pick):
                made.append((k, hold, idx[pick].tobytes(), flat[pick].tobytes(), np.minimum(df[pick], MOST_DF).astype(np.uint16).tobytes()))
        made = pd.DataFrame(made, columns=["kind", "hold", "idx", "tokens", "df"])
        out.append(made.assign(part=asked["part"].iloc[0], doc_id=None, n=None, digest=None))
    done = pd.concat([f[["kind", "part", "hold", "doc_id", "n", "digest", "idx", "tokens", "df"]].astype(object) for f in out])
    return done.where(done.notna(), None)


def _prefix(n, percent: int):
    """Members of a set of ``n`` of which one must be shared with any linked set."""
    return n - (percent * n + 99) // 100 + 1


def _ordered(percent: int):
    """One hold: each document's shared shingles in global order, and how many of them are
    in its prefix. A document whose lone shingles fill the prefix has no partner."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        docs = rows[rows["kind"] == 0]
        spots = np.array([np.frombuffer(x, np.uint16)[0] for x in docs["idx"]], np.int64)
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        lows, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for r in rows[rows["kind"].isin((1, 2))].itertuples():
            low, df = np.frombuffer(r.tokens, np.uint64), np.frombuffer(r.df, np.uint16).astype(np.uint64)
            if r.kind == 1:
                keys.append(low | df << np.uint64(48))
                owners.append(np.frombuffer(r.idx, np.uint16).astype(np.int64))
            else:
                lows.append(low)
                numbers.append(df)
        lows, numbers = np.concatenate(lows), np.concatenate(numbers)
        by = np.argsort(lows)
        lows, numbers = lows[by], numbers[by]
        for r in rows[rows["kind"] == 3].itertuples():
            low = np.frombuffer(r.tokens, np.uint64) & LOW
            keys.append(low | numbers[np.searchsorted(lows, low)] << np.uint64(48))
            owners.append(np.frombuffer(r.idx, np.uint16).astype(np.int64))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((keys, owners))
        keys, owners = keys[order].astype(np.int64), owners[order]
        lo, hi = np.searchsorted(owners, spots), np.searchsorted(owners, spots, "right")
        n = docs["n"].to_numpy(np.int64)
        prefix = _prefix(n, percent) - (n - (hi - lo))
        linked = (n > 0) & (prefix > 0)
        tokens = [keys[a:b] if ok else None for a, b, ok in zip(lo, hi, linked)]
        return pd.DataFrame(
            {"doc_id": docs["doc_id"].to_numpy(), "n": n, "digest": docs["digest"].to_numpy(np.int64), "prefix": np.where(linked, prefix, 0), "tokens": tokens}
        )

    return run


class PrefixTree:
    """Sorted sets in a compressed prefix tree, nodes as arrays.

    Leaves are the sets in lexical order. A node has the part of a path that its sets share
    beyond its parent: ``size`` members from ``start`` on in the joined sets.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        dense = [flat[e - len(s) : e] for e, s in zip(ends, sets)]
        self.order = sorted(range(len(sets)), key=lambda i: dense[i].astype(">u4").tobytes())
        self.sets = [dense[i] for i in self.order]
        self.sizes = np.asarray(sizes, np.int64)[self.order]
        lengths = np.array([len(s) for s in self.sets], np.int64)
        self.tokens = np.concatenate(self.sets)
        offset = np.cumsum(lengths) - lengths
        nodes: list[list[int]] = []  # parent, start, size, depth at its end, first leaf, last leaf
        stack: list[tuple[int, int]] = [(-1, 0)]  # open inner nodes with their depth
        waiting: list[int] = []
        for i, s in enumerate(self.sets):
            shared = self._common(self.sets[i - 1], s) if i else 0
            last = None
            while stack[-1][1] > shared:
                last = stack.pop()
            if i and stack[-1][1] < shared:
                # a new inner node between the open one and what was closed or the last leaf
                below = last[0] if last else waiting[-1]
                made = len(nodes)
                parent, depth = stack[-1]
                nodes.append([parent, int(offset[i]) + depth, shared - depth, shared, nodes[below][4], i])
                nodes[below][0], moved = made, shared - (nodes[below][3] - nodes[below][2])
                nodes[below][1] += moved
                nodes[below][2] -= moved
                stack.append((made, shared))
            parent, depth = stack[-1]
            nodes.append([parent, int(offset[i]) + depth, int(lengths[i]) - depth, int(lengths[i]), i, i])
            waiting = [len(nodes) - 1]
            for node, _ in stack[1:]:
                nodes[node][5] = i
        a = np.array(nodes, np.int64).reshape(-1, 6)
        self.parent, self.start, self.size, self.depth, self.lo, self.hi = a.T
        self.leaf = np.ones(len(a), bool)
        self.leaf[self.parent[self.parent >= 0]] = False
        wide = np.flatnonzero(self.hi > self.lo)
        self.least, self.most, self.longest = self.sizes[self.lo].copy(), self.sizes[self.lo].copy(), lengths[self.lo].copy()
        for k in wide:
            span = slice(self.lo[k], self.hi[k] + 1)
            self.least[k], self.most[k], self.longest[k] = self.sizes[span].min(), self.sizes[span].max(), lengths[span].max()
        by = np.argsort(self.parent, kind="stable")
        self.children = by
        tops = np.flatnonzero(self.parent < 0)
        tops = tops[np.argsort(self.lo[tops])]
        self.top = tops[np.searchsorted(self.lo[tops], np.arange(len(self.sets)), "right") - 1]
        self.child_lo = np.searchsorted(self.parent[by], np.arange(-1, len(a)))
        self.child_hi = np.searchsorted(self.parent[by], np.arange(-1, len(a)), "right")

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        at = int(differ.argmax()) if n else 0
        return at if n and differ[at] else n

    def _below(self, nodes: np.ndarray) -> np.ndarray:
        lo, hi = self.child_lo[nodes + 1], self.child_hi[nodes + 1]
        return self.children[_ranges(lo, hi - lo)]

    def walk(self, q: int, percent: int, nodes: np.ndarray, known: Known, mark: np.ndarray) -> np.ndarray:
        """Leaves after ``q`` that link with it, below ``nodes``, that aren't known to be connected."""
        mine, n = self.sets[q], self.sizes[q]
        mark[mine] = True
        sums, found = None, []
        while len(nodes):
            ok = (self.hi[nodes] > q) & ~known.same(q, nodes) & (100 * self.most[nodes] >= percent * n) & (percent * self.least[nodes] <= 100 * n)
            nodes = nodes[ok]
            sums = np.zeros(len(nodes), np.int64) if sums is None else sums[ok]
            if not len(nodes):
                break
            size = self.size[nodes]
            hit = np.concatenate([[0], np.cumsum(mark[self.tokens[_ranges(self.start[nodes], size)]])])
            ends = np.cumsum(size)
            sums = sums + hit[ends] - hit[ends - size]
            reached = np.where(size > 0, self.start[nodes] + size - 1, 0)
            left = np.where(size > 0, len(mine) - np.searchsorted(mine, self.tokens[reached], "right"), len(mine))
            best = sums + np.minimum(left, self.longest[nodes] - self.depth[nodes])
            ok = (100 + percent) * best >= percent * (n + self.least[nodes])
            nodes, sums = nodes[ok], sums[ok]
            done = self.leaf[nodes]
            leaves = self.lo[nodes[done]]
            found.append(leaves[((100 + percent) * sums[done] >= percent * (n + self.sizes[leaves])) & (leaves > q)])
            nodes, sums = nodes[~done], sums[~done]
            fan = self.child_hi[nodes + 1] - self.child_lo[nodes + 1]
            sums, nodes = np.repeat(sums, fan), self._below(nodes)
        mark[mine] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Known:
    """Which sets are connected, and which subtrees and shingles have connected sets only.

    Merges are noted at once, on labels. What subtrees and shingles tell is brought up to date
    after some share of all merges, so a tree is passed over a bounded number of times; in
    between it may say "not connected" too often, which costs steps but no link.
    """

    REFRESHES = 64

    def __init__(self, tree: PrefixTree, label: np.ndarray, prefixes: list[np.ndarray]):
        self.tree, self.label = tree, label
        self.parent = list(range(int(label.max()) + 1))
        self.left = len(np.unique(label))
        flat = np.concatenate(prefixes)
        leaf = np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
        by = np.argsort(flat, kind="stable")
        self.leaves, tokens = leaf[by], flat[by]
        self.first = np.searchsorted(tokens, np.arange(len(tree.values) + 1))
        self.each = max(16, len(label) // self.REFRESHES)
        self.refresh()

    def find(self, label: int) -> int:
        parent = self.parent
        while parent[label] != label:
            parent[label] = parent[parent[label]]
            label = parent[label]
        return label

    def refresh(self) -> None:
        self.label = np.array([self.find(x) for x in range(len(self.parent))])[self.label]
        change = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        self.even = change[self.tree.lo] == change[self.tree.hi]
        # the label of all sets that have a shingle in their prefix, -1 if they have several
        self.common = np.full(len(self.first) - 1, -1)
        used = np.flatnonzero(self.first[1:] > self.first[:-1])
        if len(used):
            labels, starts = self.label[self.leaves], self.first[used]
            low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            self.common[used] = np.where(low == high, low, -1)
        self.merges = 0

    def same(self, q: int, nodes: np.ndarray) -> np.ndarray:
        return self.even[nodes] & (self.label[self.tree.lo[nodes]] == self.label[q])

    def tops(self, q: int, prefix: np.ndarray) -> np.ndarray:
        """Where to begin: the subtrees with a later set that shares a prefix shingle with ``q``."""
        open_ = prefix[self.common[prefix] != self.label[q]]
        lo, hi = self.first[open_], self.first[open_ + 1]
        leaves = self.leaves[_ranges(lo, hi - lo)]
        return np.unique(self.tree.top[leaves[leaves > q]])

    def merge(self, q: int, found: np.ndarray) -> None:
        mine = self.find(int(self.label[q]))
        for label in np.unique(self.label[found]).tolist():
            other = self.find(label)
            if other != mine:
                self.parent[other] = mine
                self.left -= 1
                self.merges += 1
        if self.merges >= self.each:
            self.refresh()


def link_sets(sets: list[np.ndarray], sizes: np.ndarray, percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """A label per set: the smallest index of the sets it is connected with.

    ``known``: labels of what is connected already (of any kind).
    """
    m = len(sets)
    if m < 2:
        return np.zeros(m, np.int64)
    tree = PrefixTree(sets, sizes)
    order = np.array(tree.order)
    label = np.arange(m) if known is None else np.unique(np.asarray(known)[order], return_inverse=True)[1]
    lone = tree.sizes - np.array([len(x) for x in tree.sets])
    reach = np.maximum(_prefix(tree.sizes, percent) - lone, 0)
    prefixes = [x[:k] for x, k in zip(tree.sets, reach, strict=True)]
    state = Known(tree, label, prefixes)
    mark = np.zeros(len(tree.values), bool)
    for q in range(m - 1):
        if state.left == 1:
            break
        tops = state.tops(q, prefixes[q])
        found = tree.walk(q, percent, tops, state, mark) if len(tops) else tops
        if len(found):
            state.merge(q, found)
    state.refresh()
    out = np.empty(m, np.int64)
    out[order] = state.label
    first = np.full(out.max() + 1, m, np.int64)
    np.minimum.at(first, out, np.arange(m))
    return first[out]


def _join_trees(percent: int):
    """Blocks of one task: each gets a tree; (digest, root) where root is the smallest digest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, roots = [], []
        for _, block in rows.groupby("block", sort=False):
            block = block.sort_values("digest")
            known = block["known"].to_numpy() if block["known"].notna().all() else None
            label = link_sets(list(block["tokens"]), block["n"].to_numpy(), percent, known)
            digests = block["digest"].to_numpy(np.int64)
            nodes.append(digests)
            roots.append(digests[label])
        return pd.DataFrame({"node": np.concatenate(nodes), "root": np.concatenate(roots)})

    return run


def connected(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw("text").alias("data"))
    volume = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(1, ceil(volume / 6 / PER_PART))  # about six bytes a word
    dealt = rows.mapInArrow(_deal(width, parts), DEALT)
    answered = dealt.groupBy("part").applyInPandas(_answer, DEALT)
    member = "doc_id long, n long, digest long, prefix long, tokens array<long>"
    members = materialise(answered.groupBy("hold").applyInPandas(_ordered(percent), member), "members")
    classes = members.where("tokens IS NOT NULL").dropDuplicates(["digest"]).select("digest", "n", "prefix", "tokens")
    classes = materialise(classes, "classes")
    roots = _links(spark, classes, percent)
    keyed = members.select("doc_id", "n", "digest", F.col("tokens").isNotNull().alias("shared"))
    keyed = keyed.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("key", F.coalesce("root", "digest"))
    keyed = materialise(keyed.select("doc_id", "n", "key", "shared"), "keyed")
    first = keyed.where("shared").groupBy("key").agg(F.min("doc_id").alias("first"))
    return keyed.join(first, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("shared"), F.col("first")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _links(spark, classes: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes that may have links; a class that isn't listed has none."""
    posts = classes.select("digest", F.explode(F.slice("tokens", F.lit(1), F.col("prefix").cast("int"))).alias("token"))
    pivots = posts.groupBy("token").agg(F.min("digest").alias("b"), F.max("digest").alias("c")).where("b <> c")
    ties = posts.join(pivots, "token").select(F.col("digest").alias("a"), "b")
    blocks = components(ties, "ties").withColumnRenamed("node", "digest").withColumnRenamed("root", "block")
    blocks = materialise(blocks, "blocks")
    sets = blocks.join(classes.select("digest", "n", "tokens"), "digest")
    sets = materialise(sets.select("block", "digest", "n", "tokens", F.size("tokens").cast("long").alias("size")), "sets")
    totals = sets.groupBy("block").agg(F.sum("size").alias("total"))
    volume = totals.agg(F.sum("total"), F.max("total")).first()
    packs = max(1, ceil(2 * (volume[0] or 0) / BLOCK_TOKENS))
    sets = sets.join(totals, "block").withColumn("trees", F.ceil(F.col("total") / BLOCK_TOKENS))
    small = sets.where("trees = 1").withColumn("task", F.pmod(F.xxhash64("block"), F.lit(packs)))
    small = small.select("task", "block", "digest", "n", "tokens", F.lit(None).cast("long").alias("known"))
    found = small.groupBy("task").applyInPandas(_join_trees(percent), "node long, root long")
    if (volume[1] or 0) <= BLOCK_TOKENS:
        return found
    return found.unionByName(_large_blocks(sets.where("trees > 1").drop("total", "trees"), percent))


def _tree_task(sets: DataFrame, percent: int) -> DataFrame:
    """Join inside the trees that ``task`` names; ``known`` says what is connected."""
    return sets.groupBy("block", "task").applyInPandas(_join_trees(percent), "node long, root long")


def _large_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Blocks with more shingles than one tree holds, exactly and without all pairs.

    First each block is dealt by hash to trees of bounded size. Then one set per connected
    piece stands for it, and these are joined among themselves, which connects the pieces of
    large groups of near copies. What is still apart from a block's largest piece is joined
    with every tree of the block; any link that was missed has such a set at one end.
    """
    sets = materialise(sets, "large-sets")
    labels = None
    standing = sets
    while True:
        total = Window.partitionBy("block")
        sizes = standing.groupBy("block").agg(F.ceil(F.sum("size") / BLOCK_TOKENS).alias("trees"))
        dealt = standing.join(sizes, "block").withColumn("task", F.pmod(F.xxhash64("digest"), F.col("trees")))
        dealt = dealt.withColumn("known", F.lit(None).cast("long"))
        links = materialise(_tree_task(dealt.select("block", "task", "digest", "n", "tokens", "known"), percent), "tree-links")
        merged = links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        if merged.isEmpty() and labels is not None:
            break
        if labels is not None:
            merged = merged.union(labels.select("node", "root"))
        rooted = components(merged, "large-ties")
        labels = materialise(
            sets.select(F.col("digest").alias("node")).join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "large-labels"
        )
        heads = labels.select(F.col("root").alias("digest")).distinct()
        fewer = materialise(sets.join(heads, "digest", "left_semi").select(*standing.columns), "standing")
        if sizes.agg(F.max("trees")).first()[0] <= 1:
            break
        standing = fewer
    labelled = sets.join(labels.withColumnRenamed("node", "digest"), "digest")
    pieces = labelled.groupBy("block", "root").agg(F.count(F.lit(1)).alias("c"))
    main = pieces.groupBy("block").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("pieces"))
    main = main.where("pieces > 1").select("block", F.col("m.root").alias("main"))
    if main.isEmpty():
        return labels
    open_ = labelled.join(main, "block").withColumn("known", F.col("root"))
    apart = open_.where("root <> main")
    few = apart.groupBy("block").agg(F.ceil(F.sum("size") / BLOCK_TOKENS).alias("few"))
    many = open_.groupBy("block").agg(F.ceil(F.sum("size") / BLOCK_TOKENS).alias("many"))
    widths = few.join(many, "block")
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    left = apart.join(widths, "block").withColumn("i", F.pmod(F.xxhash64("digest"), F.col("few")))
    left = left.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("many") - 1), lambda j: cell(F.col("i"), j))))
    right = open_.join(widths, "block").withColumn("j", F.pmod(F.xxhash64("digest"), F.col("many")))
    right = right.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("few") - 1), lambda i: cell(i, F.col("j")))))
    columns = ["block", "task", "digest", "n", "tokens", "known"]
    both = left.select(columns).union(right.select(columns)).dropDuplicates(["block", "task", "digest"])
    links = _tree_task(both, percent).where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    rooted = components(links.union(labels.select("node", "root")), "large-ties")
    return labels.select("node").join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that link, even by others, to one with a smaller id.

    Of rows that share an id one stays; rows without an id stay.
    """
    kept = connected(docs.select("doc_id", "text"), width, percent).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    same, n = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)), unused(docs, "n")
    rows = rows.withColumn(n, F.row_number().over(same)).where(F.col(n) == 1).drop(n)
    return rows.unionByName(docs.where("doc_id IS NULL"))
