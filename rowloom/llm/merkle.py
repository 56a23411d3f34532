"""Merkle manifest of a dataset, with a witness per document that grows as documents arrive.

Each document is a leaf, each source a tree of 16 children a node over its leaves in
ascending id order, and the roots of the sources are the leaves of one more such tree. A
witness lists, level by level, the siblings left and right of the way from a leaf to the
root; folding a leaf into it gives the root again, or shows that the leaf was changed.

Incremental witnesses. Leaves are appended to aligned blocks of 4,096. A block keeps its
open subtrees, one run of at most 16 nodes a level; a leaf's witness begins as a partial one
in its open run. Whenever the last sibling of a run arrives, the run's digest becomes a node
of the level above, and the witnesses of all leaves below get one step longer (shared: each
node holds its own step and its parent). Blocks are built in different tasks; their roots are
then appended in the same way, as the leaves of blocks of blocks, until one node remains.

A manifest lives in a folder and takes further documents: closed blocks are never touched
again, so an append reads the new documents and the open block of each source.

No task holds more than one block and what lies above it. Positions in a source come from a
sort by ranges and the sums of the ranges before, so a source may hold most rows.

Cases: null values are marked as such in a leaf, so that null, empty and missing differ. The
null source is a source of its own and comes first. Within a source null ids come first and
rows of equal id are ordered by their leaf; repeated rows are leaves of their own. An empty
table has no rows and no root. Texts are hashed whole. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowloom.llm.common import prepare
from rowloom.session import materialise, scratch_path

FANOUT = 16
#: levels of nodes inside a block; a block has 16 to that power leaves
BLOCK_LEVELS = 3
#: rows that one task numbers, and members of a block that leave a task at once
PER_RANGE, PER_BATCH = 50_000, 500
#: what a leaf is made of, in this order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """Digest of values of any type: their UTF-8 byte counts and themselves, ``-`` if null."""
    marked = []
    for value in fields:
        shown = value.cast("string")
        marked.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-")))
    return F.sha2(F.concat(*marked), 256)


def joined_digest(digests: str) -> str:
    return hashlib.sha256(digests.encode()).hexdigest()


class Node:
    """A digest, and its step of the witness once its run is complete."""

    __slots__ = ("digest", "left", "parent", "right")

    def __init__(self, digest: str):
        self.digest, self.parent = digest, None

    def witness(self) -> list[dict]:
        steps, node = [], self
        while node.parent is not None:
            steps.append({"left": node.left, "right": node.right})
            node = node.parent
        return steps


class OpenSubtrees:
    """The runs of an aligned stretch of nodes that wait for siblings, a run a level."""

    def __init__(self):
        self.runs: list[list[Node]] = [[]]

    def append(self, digest: str) -> Node:
        node = Node(digest)
        self._take(0, node)
        return node

    def _take(self, level: int, node: Node) -> None:
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append(node)
        if len(self.runs[level]) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        whole = "".join(x.digest for x in run)
        parent = Node(joined_digest(whole))
        size = len(run[0].digest)
        for k, node in enumerate(run):
            node.left, node.right, node.parent = whole[: k * size], whole[(k + 1) * size :], parent
        self._take(level + 1, parent)

    def close(self, levels: int) -> Node:
        """Complete what is open below ``levels``; the node that remains there."""
        for level in range(levels):
            if level < len(self.runs) and self.runs[level]:
                self._complete(level)
        return self.runs[levels][0]


def grow(digests: Sequence[str], block: int, block_levels: int = BLOCK_LEVELS) -> tuple[list[Node], Node]:
    """Nodes of the leaves of one block, and its root. Only a first block that isn't full can be
    its key's only one, and then it ends at the first level with one node."""
    subtrees = OpenSubtrees()
    nodes = [subtrees.append(x) for x in digests]
    levels, left = 0, len(nodes)
    while left > 1:
        levels, left = levels + 1, ceil(left / FANOUT)
    return nodes, subtrees.close(block_levels if block else levels)


def numbered(rows: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` (stored, sorted by ranges) with ``pos`` from 0 within each key."""
    parts = max(1, ceil(rows.count() / PER_RANGE))
    order = [F.col(key).asc_nulls_first(), *order]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = materialise(_ranked(ranged.withColumn("part", F.spark_partition_id()), key), name)
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy(key, "part").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select(
        F.col(key).alias("_of"), F.col("part").alias("_part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_before")
    )
    same = F.col(key).eqNullSafe(F.col("_of")) & (F.col("part") == F.col("_part"))
    return ranked.join(sizes, same).withColumn("pos", F.col("pos") + F.col("_before")).drop("part", "_of", "_part", "_before")


def _ranked(sorted_rows: DataFrame, key: str) -> DataFrame:
    """Add ``pos``, counted from 0 within each key of a partition that is sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), 0
        for batch in batches:
            here = []
            for value in batch.column(key).to_pylist():
                at = at + 1 if value == last else 0
                last = value
                here.append(at)
            yield batch.append_column("pos", pa.array(here, pa.int64()))

    schema = sorted_rows.withColumn("pos", F.lit(0).cast("long")).schema
    schema["pos"].nullable = True
    return sorted_rows.mapInArrow(run, schema)


def fold_blocks(nodes: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Blocks of ``nodes`` (key, pos, node with its digest): key, block, members, root."""
    kinds = dict(nodes.dtypes)
    schema = f"key {kinds['key']}, block long, members array<{kinds['node']}>, root string"

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos").combine_chunks()
        block = rows["block"][0].as_py()
        members = rows["node"].combine_chunks()
        members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
        _, root = grow(members.field("digest").to_pylist(), block, block_levels)
        packed = pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members)
        return pa.table({"key": rows["key"].slice(0, 1), "block": rows["block"].slice(0, 1), "members": packed, "root": [root.digest]})

    blocked = nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**block_levels))
    return blocked.groupBy("key", "block").applyInArrow(fold, schema)


def crown(blocks: DataFrame, name: str = "upper", block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``blocks`` with ``above``, the witness of their root in the tree of their key, and
    ``top``, the key's root: block roots are appended to blocks of their own."""
    if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
        return blocks.withColumn("above", F.array().cast(PATH)).withColumn("top", F.col("root"))
    node = F.struct(F.col("root").alias("digest"), F.col("block").alias("of"))
    roots = blocks.select("key", F.col("block").alias("pos"), node.alias("node"))
    stored = materialise(fold_blocks(roots, block_levels), name)
    upper = expand(crown(stored, name, block_levels), block_levels)
    upper = upper.select(F.col("key").alias("_key"), F.col("node.of").alias("_of"), F.col("path").alias("above"), "top")
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_of"))
    return blocks.join(upper, same).drop("_key", "_of")


def expand(blocks: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """A row per member of crowned ``blocks``: key, node, its whole ``path``, and the block's
    other columns."""
    rest = [c for c in blocks.columns if c not in ("block", "members", "root", "above")]
    member = dict(blocks.dtypes)["members"][len("array<") : -1]
    schema = ", ".join([f"{c} {dict(blocks.dtypes)[c]}" for c in rest] + [f"node {member}", f"path {PATH}"])
    step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                line = batch.slice(k, 1)
                members, above = line.column("members").flatten(), line.column("above")[0].as_py()
                nodes, _ = grow(members.field("digest").to_pylist(), line.column("block")[0].as_py(), block_levels)
                for begin in range(0, len(nodes), PER_BATCH):
                    some = nodes[begin : begin + PER_BATCH]
                    paths = pa.array([x.witness() + above for x in some], step)
                    same = pa.array([0] * len(some), pa.int32())
                    columns = [line.column(c).take(same) for c in rest]
                    columns += [members.slice(begin, len(some)), paths]
                    yield pa.RecordBatch.from_arrays(columns, names=[*rest, "node", "path"])

    return blocks.mapInArrow(run, schema)


def leaves(docs: DataFrame, carry: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """key (the source), id and ``node``: the leaf's digest, the id, and what is carried along."""
    digest = leaf_digest(*[F.col(c) for c in fields])
    extra = [value.alias(name) for name, value in (carry or {}).items()]
    node = F.struct(digest.alias("digest"), F.col(fields[0]).alias("id"), *extra)
    return docs.select(F.col(fields[1]).alias("key"), F.col(fields[0]).alias("id"), node.alias("node"))


def _versions(spark: SparkSession, folder: str) -> int:
    """The last complete version of a manifest, 0 if there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    version = 0
    while files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/v{version + 1}/sources/_SUCCESS")):
        version += 1
    return version


def append(
    docs: DataFrame,
    folder: str,
    carry: dict[str, Column] | None = None,
    fields: Sequence[str] = FIELDS,
    block_levels: int = BLOCK_LEVELS,
) -> int:
    """Append documents to the manifest in ``folder`` (made if it isn't there); its version.

    Within a source they must have larger ids than those before, else ValueError. One writer
    at a time; an append that failed leaves the version before it. All appends and reads of a
    manifest must give the same ``block_levels`` and carry the same columns.
    """
    spark = prepare(docs.sparkSession)
    version = _versions(spark, folder)
    made = materialise(leaves(docs, carry, fields), "leaves")
    new = numbered(made, "key", [F.col("id").asc_nulls_first(), F.col("node.digest").asc()], "numbered")
    adds = made.groupBy("key").agg(
        F.count(F.lit(1)).alias("more"),
        F.min("id").alias("first"),
        F.max("id").alias("last"),
        F.count_if(F.col("id").isNull()).alias("unnamed"),
    )
    nodes, sources = new.select("key", "pos", "node"), adds.select("key", F.col("more").alias("n"), "last")
    if version:
        had = spark.read.parquet(f"{folder}/v{version}/sources").select(F.col("key").alias("_key"), "n", F.col("last").alias("until"))
        same = F.col("key").eqNullSafe(F.col("_key"))
        late = adds.join(had, same).where("unnamed > 0 OR first <= until").select("key").first()
        if late is not None:
            raise ValueError(f"source {late[0]!r} has later documents already")
        waiting = spark.read.parquet(f"{folder}/v{version}/open").select("key", "block", F.posexplode("members").alias("at", "node"))
        waiting = waiting.select("key", (F.col("block") * FANOUT**block_levels + F.col("at")).alias("pos"), "node")
        moved = nodes.join(had, same, "left").select("key", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), "node")
        nodes = waiting.unionByName(moved)
        n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
        sources = adds.join(had, same, "full").select(
            F.coalesce("key", "_key").alias("key"), n.alias("n"), F.greatest("last", "until").alias("last")
        )
    blocks = materialise(fold_blocks(nodes, block_levels), "blocks")
    here = f"{folder}/v{version + 1}"
    full = F.size("members") == FANOUT**block_levels
    blocks.where(full).write.mode("overwrite").parquet(f"{here}/closed")
    blocks.where(~full).write.mode("overwrite").parquet(f"{here}/open")
    sources.write.mode("overwrite").parquet(f"{here}/sources")
    return version + 1


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    version = _versions(spark, folder)
    closed = spark.read.parquet(*[f"{folder}/v{k}/closed" for k in range(1, version + 1)])
    return closed.unionByName(spark.read.parquet(f"{folder}/v{version}/open"))


def _sources(blocks: DataFrame, block_levels: int) -> DataFrame:
    """key, subroot, ``last_steps`` (from the source's root to the root) and root."""
    tops = blocks.where("block = 0").select("key", "top")
    node = F.struct(F.col("top").alias("digest"), F.col("key").alias("source"))
    tops = materialise(tops.select(F.lit(0).alias("key"), F.col("key").alias("source"), node.alias("node")), "subroots")
    ordered = numbered(tops, "key", [F.col("source").asc_nulls_first()], "ordered-subroots")
    stored = materialise(fold_blocks(ordered.select("key", "pos", "node"), block_levels), "root")
    grown = expand(crown(stored, "root", block_levels), block_levels)
    return grown.select(
        F.col("node.source").alias("_key"), F.col("node.digest").alias("subroot"), F.col("path").alias("last_steps"), F.col("top").alias("whole")
    )


def subroots(spark: SparkSession, folder: str, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """source, subroot, its witness ``path``, and the root of the manifest in ``folder``."""
    found = _sources(crown(_blocks(prepare(spark), folder), block_levels=block_levels), block_levels)
    return found.select(F.col("_key").alias("source"), "subroot", F.col("last_steps").alias("path"), F.col("whole").alias("root"))


def witnesses(spark: SparkSession, folder: str, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """A row per document of the manifest: id, leaf, what was carried, ``path`` (the steps of
    the witness, left and right siblings as joined digests), subroot and root."""
    blocks = crown(_blocks(prepare(spark), folder), block_levels=block_levels)
    sources = _sources(blocks, block_levels)
    whole = blocks.join(sources, F.col("key").eqNullSafe(F.col("_key")))
    whole = whole.withColumn("above", F.concat("above", "last_steps")).drop("last_steps", "_key", "top")
    rows = expand(whole, block_levels)
    carried = [F.col(f"node.{f.name}") for f in rows.schema["node"].dataType if f.name not in ("digest", "id")]
    return rows.select(
        F.col("node.id").alias("id"), F.col("node.digest").alias("leaf"), *carried, "path", "subroot", F.col("whole").alias("root")
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a witness give."""
    return F.aggregate(path, leaf, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


#: A-Z and a-z
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audit(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` and each document's witness held against it, where every fifth
    document (by checksum of its id) has been tampered with after the manifest was made."""
    spark = prepare(docs.sparkSession)
    folder = scratch_path(spark, "manifest")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = leaf_digest(*[F.col(c) for c in FIELDS[:-1]], F.translate("text", UPPER, LOWER))
    append(docs, folder, {"tampered": F.when(changed, tampered)})
    rows = witnesses(spark, folder)
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
