"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowloom.session import configure

#: the white space of every word split: space, and tab to carriage return
SPACE = r"[\x20\x09-\x0D]+"
#: rows and bytes of an Arrow batch; long texts make batches of fewer rows
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
#: distinct words a task remembers before it starts its memory anew
WORD_MEMORY = 400_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the package, and Arrow batches small enough for whole texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def raw(text: str | Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty. Bytes split and lower-case by ASCII alone."""
    return whole(text).cast("binary")


class Remembered(dict):
    """``make(word)`` for each word, remembered within bounds."""

    def __init__(self, make: Callable, most: int = WORD_MEMORY):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        value = self.make(word)
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def word_hashes() -> Remembered:
    return Remembered(xxhash.xxh64_intdigest)


def hashed(words: list, memory: Remembered) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of a public mixing function)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` ids; a shorter sequence is one window."""
    if not len(ids):
        return ids
    width = min(width, len(ids))
    n = len(ids) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return out


def per_batch(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], fields: list[T.StructField], keep: list[str]
) -> DataFrame:
    """Keep columns ``keep`` of ``df`` and add ``fields``, computed batch by batch.

    ``make()`` runs once a task and returns the function from batch to columns, so that a
    task's memory of words lasts from batch to batch.
    """
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            made = compute(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(made[n]) for n in names],
                names=keep + names,
            )

    return df.mapInArrow(run, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that the operator is about to add; other columns pass through."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
