"""Token files: flat unsigned integers with 64-bit document offsets, memory-mapped.

A folder of token files holds, for each shard of the documents in ascending id order:

* ``tokens-*.bin``: the ids of all its documents one after another, little-endian unsigned
  16-bit integers if the vocabulary allows, else 32-bit; each document ends with the end id
* ``offsets-*.bin``: little-endian unsigned 64-bit integers, one more than documents: where
  each starts, counted in ids from the start of the *whole* collection
* ``ids-*.arrow``: the document ids, an Arrow file of one column
* ``shards``: a Parquet table that lists the files with their first document and first id

Documents are dealt to shards by ranges of their id and sorted; each shard is encoded and
written by one task as its documents come. Shard totals become bases by prefix sums, and a
last narrow pass turns the offsets inside a shard into offsets of the collection.

A file is named after the attempt that wrote it and counts only if ``shards`` lists it, so
that a task which is lost, repeated or run twice at the same time leaves at most a file that
nobody reads. Any file system that Arrow can open will do; local ones are memory-mapped.

Where the rules of the tokenizer file never look across white space (``APART``), the library is
asked for each distinct word between ASCII white space, and its answers are remembered within
bounds. Where a word is plain letters and then ASCII punctuation, the two are asked for apart,
as the rules cut there too, and the letters in lower case, which is how the rules take them.
With any other rules each text is encoded whole.

Cases: a null or empty text has the end id alone. Rows without an id come first, rows of
equal id in the order of their ids' bytes; repeated rows stay. An empty table makes a folder
without shards. Other columns don't matter.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from rowloom.llm.common import Remembered, prepare, raw
from rowloom.session import materialise, scratch_path

#: bytes of text that make a shard, and documents a reader handles at once
SHARD_BYTES, READ_DOCUMENTS = 32 << 20, 1_000
#: words, and parts of words, that a worker remembers with their ids before it starts anew
MEMORY = 500_000
#: letters that stay alone in composition and lower case, then something that begins with punctuation
PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~].*)?", re.DOTALL)
#: the id that ends a document, unless told otherwise
END_ID = 1

SHARDS = "shard int, documents long, n_tokens long, tokens_file string, offsets_file string, ids_file string, width int"


def _place(folder: str):
    """File system of a folder, and the folder's path in it."""
    if ":" not in folder.split("/")[0]:
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))


def _save(folder: str, name: str, parts: Iterator[bytes]) -> None:
    files, path = _place(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as out:
        for part in parts:
            out.write(part)


def _map(folder: str, name: str) -> pa.Buffer:
    """A file's bytes: mapped where the file system is local, else read."""
    files, path = _place(folder)
    if isinstance(files, pafs.LocalFileSystem):
        if not os.path.getsize(f"{path}/{name}"):
            return pa.py_buffer(b"")
        return pa.memory_map(f"{path}/{name}").read_buffer()
    with files.open_input_file(f"{path}/{name}") as source:
        return source.read_buffer()




def _written() -> dict[int, str]:
    """How byte-level rules write the letters of ``PARTS``: each byte of their UTF-8 as a visible
    character, which is the byte's own if that is visible, else the next one from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    byte = {b: chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


WRITTEN = _written()
#: fixed values: rules of a tokenizer file by which words can be encoded one by one
APART = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class Words:
    """``bytes`` of a text's ids, little-endian of the given width, by one tokenizer file."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.type = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        self.apart = all(rules[name] == value for name, value in APART.items()) and rules["model"]["type"] == "BPE"
        self.words, self.letters = Remembered(self._word, MEMORY), Remembered(self._letters, MEMORY)
        self.rest = Remembered(self._ids, MEMORY)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _letters(self, letters: str) -> bytes:
        """Letters in lower case stay as they are but for the writing of their bytes."""
        return np.array([x.id for x in self.model.tokenize(letters.translate(WRITTEN))], self.type).tobytes()

    def _word(self, word: bytes) -> bytes:
        word = word.decode()
        cut = PARTS.fullmatch(word)
        if not cut:
            return self._ids(word)
        return self.letters[cut[1].lower()] + (self.rest[cut[2]] if cut[2] else b"")

    def encode(self, text: bytes) -> bytes:
        if not self.apart:
            return self._ids(text.decode())
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def words_of(path: str, width: int) -> Words:
    """Kept from task to task of a worker."""
    return Words(path, width)


def width_of(path: str, end: int) -> int:
    """Bytes an id takes: the smallest that hold all ids of the tokenizer and the end id."""
    from tokenizers import Tokenizer

    most = max([end, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()])
    return 2 if most < 1 << 16 else 4


def _writer(folder: str, path: str, width: int, end: int):
    """Encode the sorted documents of one partition as one shard; yields its line of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = (batch for batch in batches if batch.num_rows)
        first = next(filled, None)
        if first is None:
            return
        words, last = words_of(path, width), np.array([end], f"<u{width}").tobytes()
        name, lengths, ids = uuid.uuid4().hex, [], []

        def parts() -> Iterator[bytes]:
            for batch in chain([first], filled):
                ids.append(batch.column("id"))
                for text in batch.column("text").to_pylist():
                    made = words.encode(text) + last
                    lengths.append(len(made) // width)
                    yield made

        _save(folder, f"tokens-{name}.bin", parts())
        starts = np.cumsum(np.array([0, *lengths], "<u8"))
        _save(folder, f"starts-{name}.bin", iter([starts.astype("<u8").tobytes()]))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, pa.schema([("id", ids[0].type)])) as out:
            for part in ids:
                out.write_batch(pa.record_batch([part], names=["id"]))
        _save(folder, f"ids-{name}.arrow", iter([sink.getvalue()]))
        line = {
            "shard": pa.array([first.column("shard")[0].as_py()], pa.int32()),
            "documents": pa.array([len(lengths)], pa.int64()),
            "n_tokens": pa.array([int(starts[-1])], pa.int64()),
            "tokens_file": [f"tokens-{name}.bin"],
            "offsets_file": [f"starts-{name}.bin"],
            "ids_file": [f"ids-{name}.arrow"],
            "width": pa.array([width], pa.int32()),
        }
        yield pa.RecordBatch.from_pydict(line)

    return run


def _rebase(folder: str):
    """Rewrite offsets inside a shard as offsets of the collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for base, old in zip(batch.column("first_token").to_pylist(), batch.column("offsets_file").to_pylist(), strict=True):
                names.append(f"offsets-{uuid.uuid4().hex}.bin")
                here = np.frombuffer(_map(folder, old), "<u8")
                _save(folder, names[-1], iter([(here + np.uint64(base)).astype("<u8").tobytes()]))
            yield batch.set_column(batch.schema.get_field_index("offsets_file"), "offsets_file", pa.array(names, pa.string()))

    return run


def write(
    docs: DataFrame, folder: str, path: str, end: int = END_ID, id_column="doc_id", text="text", shard_bytes: int = SHARD_BYTES
) -> None:
    """Write the token files of ``docs`` into ``folder``, a new one that all executors reach."""
    spark = prepare(docs.sparkSession)
    width = width_of(path, end)
    rows = docs.select(F.col(id_column).alias("id"), raw(text).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # equal ids are dealt by their content too, so that one id with many texts isn't one shard
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    ranged = rows.repartitionByRange(max(1, ceil(size / shard_bytes)), *order[:2]).sortWithinPartitions(*order)
    shards = ranged.withColumn("shard", F.spark_partition_id()).select("shard", "id", "text")
    shards = materialise(shards.mapInArrow(_writer(folder, path, width, end), SHARDS), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.withColumns(
        {
            "first_document": F.coalesce(F.sum("documents").over(before), F.lit(0)),
            "first_token": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)),
        }
    )
    spread(based).mapInArrow(_rebase(folder), based.schema).write.parquet(f"{folder}/shards")


def spread(shards: DataFrame) -> DataFrame:
    """A task for each shard."""
    return shards.repartition(max(1, shards.count()))


def shards_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/shards")


def documents(folder: str, line: dict) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """The documents of one shard, some at a time: their ids, their global offsets (one more),
    and the mapped tokens from the first of these offsets on."""
    offsets = np.frombuffer(_map(folder, line["offsets_file"]), "<u8")
    tokens = np.frombuffer(_map(folder, line["tokens_file"]), f"<u{line['width']}")
    with pa.ipc.open_file(_map(folder, line["ids_file"])) as names:
        at = 0
        for k in range(names.num_record_batches):
            ids = names.get_batch(k).column(0).to_pylist()
            for begin in range(0, len(ids), READ_DOCUMENTS):
                some = ids[begin : begin + READ_DOCUMENTS]
                here = offsets[at : at + len(some) + 1]
                yield some, here, tokens[int(here[0] - offsets[0]) : int(here[-1] - offsets[0])]
                at += len(some)


def read(spark: SparkSession, folder: str, id_column: str = "doc_id") -> DataFrame:
    """id, ``start`` (global), ``ids`` of each document, read from the files."""
    return _each(spark, folder, id_column, T.ArrayType(T.LongType()), "ids", lambda x: x.astype(np.int64))


def summary(spark: SparkSession, folder: str, id_column: str = "doc_id") -> DataFrame:
    """id, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, read from the files.

    The checksum is that of the ids as little-endian unsigned 32-bit integers, whatever
    width the files have.
    """
    crc = lambda x: zlib.crc32(x.astype("<u4").tobytes())
    return _each(spark, folder, id_column, T.LongType(), "ids_crc32", crc)


def _each(spark: SparkSession, folder: str, id_column: str, kind: T.DataType, name: str, make: Callable) -> DataFrame:
    shards = shards_of(prepare(spark), folder)
    first = shards.select("ids_file").first()
    id_type = T.LongType() if first is None else _id_type(folder, first["ids_file"])
    schema = T.StructType(
        [T.StructField(id_column, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())]
        + [T.StructField(name, kind)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            for line in batch.to_pylist():
                for ids, offsets, tokens in documents(folder, line):
                    cuts = (offsets - offsets[0]).astype(np.int64)
                    made = [make(tokens[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    starts = pa.array(offsets[:-1].astype(np.int64))
                    columns = [pa.array(ids, types[0].type), starts, pa.array(np.diff(cuts)), pa.array(made, types[3].type)]
                    yield pa.RecordBatch.from_arrays(columns, names=types.names)

    return spread(shards).mapInArrow(run, schema)


def _id_type(folder: str, name: str) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    with pa.ipc.open_file(_map(folder, name)) as ids:
        return from_arrow_type(ids.schema.field("id").type)


def round_trip(docs: DataFrame, path: str, end: int = END_ID, id_column="doc_id", text="text") -> DataFrame:
    """Write the token files of ``docs`` into the shared folder and sum them up from there."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write(docs, folder, path, end, id_column, text)
    return summary(docs.sparkSession, folder, id_column)
