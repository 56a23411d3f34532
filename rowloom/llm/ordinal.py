"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds cut the
score: P(grade <= k) = sigmoid(threshold[k] - score). That gives an expected grade and a
tail probability P(grade >= select_from), by which documents are selected.

Features: the distinct words of a text, lower-cased (A-Z) and stripped of non-letters at
both ends, the first letters of each, and a few shares of the whole text (symbols,
capitals, repeated words). The model is fitted on at most ``max_rated`` rated documents,
those with the smallest hash of their id.

Cases: a null text counts as empty and gets the score of a text without words. Several
ratings of one document: the lowest counts. Null ratings and ratings of unknown documents
are left out. Without any rating every document is kept. Repeated rows are scored one by
one. Columns named as the results are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from rowloom.llm.common import Remembered, per_batch, prepare, raw, unused, without

DIMENSIONS = 1 << 18
SYMBOLS = b"#*$%&|<>!{}[]=\\~^_"
CAPITALS = bytes(range(65, 91))
LETTER_EDGES = bytes(set(range(128)) - set(range(97, 123)))
SHARES = 5
#: shares are cut into this many steps, so that a weight per step can follow any curve
STEPS = 12
#: bytes of a word's beginning
STEM = 4

RESULT = [
    T.StructField("expected_grade", T.DoubleType()),
    T.StructField("p_select", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray  # DIMENSIONS + SHARES * STEPS
    thresholds: np.ndarray  # grades - 1, ascending
    select_from: int
    least: float


def _shares(data: bytes, words: list, distinct: int) -> list[int]:
    """The step of each share of a text."""
    n, size = len(words), max(1, len(data))
    parts = (
        (size - len(data.translate(None, SYMBOLS))) / size * 4,
        (size - len(data.translate(None, CAPITALS))) / size * 2,
        1 - distinct / n if n else 0.0,
        min(1.0, n / 60),
        (data.count(b"\n") + 1) / max(1, n) * 4,
    )
    return [k * STEPS + min(STEPS - 1, max(0, int(p * STEPS))) for k, p in enumerate(parts)]


def _buckets(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its first letters, which inflected forms share; -1: none."""
    core = word.strip(LETTER_EDGES)
    if not core:
        return -1, -1
    stem = xxhash.xxh32_intdigest(core[:STEM], seed=1) % DIMENSIONS if len(core) > STEM else -1
    return xxhash.xxh32_intdigest(core) % DIMENSIONS, stem


def features(data: bytes, memory: Remembered) -> np.ndarray:
    words = data.lower().split()
    distinct = set(words)
    cores = np.fromiter(chain.from_iterable(map(memory.__getitem__, distinct)), np.int32, 2 * len(distinct))
    shares = np.array(_shares(data, words, len(distinct)), np.int32) + DIMENSIONS
    return np.concatenate([np.unique(cores[cores >= 0]), shares])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, min_docs=3, least_gain=16.0, penalty=3e-4, rounds=300):
    """Maximum likelihood with a ridge penalty, by full-batch adaptive gradient steps.

    A word only gets a weight where its grades differ from those of all documents by more
    than chance: ``least_gain`` bounds the likelihood-ratio statistic from below. Without
    that, many tiny weights of common words would add up in long texts.
    """
    size = DIMENSIONS + SHARES * STEPS
    found = np.array([np.bincount(np.concatenate([r for r, y in zip(rows, grades) if y == c] or [rows[0][:0]]), minlength=size) for c in range(n_grades)])
    counts, prior = found.sum(axis=0), np.bincount(grades, minlength=n_grades)[:, None] / len(grades)
    expected = np.maximum(counts[None, :] * prior, 1e-9)
    gain = 2 * np.sum(np.where(found > 0, found * np.log(np.maximum(found, 1) / expected), 0.0), axis=0)
    active = np.flatnonzero((counts >= min_docs) & ((gain >= least_gain) | (np.arange(size) >= DIMENSIONS)))
    slot = np.full(size, -1, np.int64)
    slot[active] = np.arange(len(active))
    cols = [slot[r][slot[r] >= 0] for r in rows]
    of = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
    cols = np.concatenate(cols)
    share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades)
    share = np.clip(share, 0.5 / len(grades), 1 - 0.5 / len(grades))
    cuts = np.log(share / (1 - share))
    # thresholds stay ordered: the first is free, each later one adds exp(gap)
    x = np.concatenate([np.zeros(len(active)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    m, v, k = np.zeros_like(x), np.zeros_like(x), len(active)
    lower, upper = grades - 1, grades
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        gaps = np.exp(x[k + 1 :])
        cuts = x[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        edges = np.concatenate([[-40.0], cuts, [40.0]])
        score = np.bincount(of, weights=x[cols], minlength=len(rows))
        lo, hi = sigmoid(edges[lower + 1] - score), sigmoid(edges[upper + 1] - score)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_score = (d_hi - d_lo) / len(rows)
        g_cut = np.array([(d_lo[lower == c].sum() - d_hi[upper == c].sum()) / len(rows) for c in range(n_grades - 1)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, weights=g_score[of], minlength=k) + penalty * x[:k], tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[active] = x[:k]
    return weights, x[k] + np.concatenate([[0.0], np.cumsum(np.exp(x[k + 1 :]))])


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, select_from: int, least=0.5, max_rated=12_000) -> Ordinal:
    """Fit on ``ratings`` (doc_id, grade 0..n_grades-1) of ``docs`` (doc_id, text).

    At most ``max_rated`` rated documents are used. One task gets their features, a few
    kilobytes each, and fits the model; the driver gets the weights that are not zero.
    """
    prepare(docs.sparkSession)
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.join(docs.select("doc_id"), "doc_id", "left_semi")  # so that each one counts
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    texts = docs.select("doc_id", raw("text").alias("data")).join(rated, "doc_id")

    def make():
        memory = Remembered(_buckets)
        return lambda batch: {"f": [features(x, memory).tobytes() for x in batch.column("data").to_pylist()]}

    featured = per_batch(texts, make, [T.StructField("f", T.BinaryType())], ["grade"])
    got = featured.repartition(1).mapInArrow(_fit_task(n_grades), "at binary, weight binary, cuts binary").first()
    weights = np.zeros(DIMENSIONS + SHARES * STEPS, np.float32)
    if got is None:
        return Ordinal(weights, np.full(n_grades - 1, -40.0), select_from, least)
    weights[np.frombuffer(got["at"], np.int32)] = np.frombuffer(got["weight"], np.float32)
    return Ordinal(weights, np.frombuffer(got["cuts"], np.float64), select_from, least)


def _fit_task(n_grades: int):
    """All rated documents (grade, f) of one task to one row, the model; none to no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades = [], []
        for batch in batches:
            rows += [np.frombuffer(x, np.int32) for x in batch.column("f").to_pylist()]
            grades += batch.column("grade").to_pylist()
        if not rows:
            return
        grades = np.array(grades, np.int64)
        order = np.lexsort((np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in rows], np.uint64), grades))
        weights, cuts = fit([rows[i] for i in order], grades[order], n_grades)
        at = np.flatnonzero(weights).astype(np.int32)
        made = (at.tobytes(), weights[at].astype(np.float32).tobytes(), cuts.astype(np.float64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], names=["at", "weight", "cuts"])

    return run


def score(docs: DataFrame, model: Ordinal, prefix: str = "") -> DataFrame:
    """All columns of ``docs``, with expected_grade, p_select and kept, named with ``prefix``."""
    result = [T.StructField(prefix + f.name, f.dataType) for f in RESULT]
    docs = without(docs, *[f.name for f in result])
    columns, own = docs.columns, unused(docs, "data")

    def make():
        weights = model.weights
        memory = Remembered(lambda w: tuple(b if b >= 0 and weights[b] else -1 for b in _buckets(w)))

        def compute(batch: pa.RecordBatch) -> dict:
            data = batch.column(own).to_pylist()
            eta = np.array([weights[features(x, memory)].sum(dtype=np.float64) for x in data])
            above = 1 / (1 + np.exp(np.clip(model.thresholds[None, :] - eta[:, None], -40, 40)))
            p = above[:, model.select_from - 1]
            return dict(zip([f.name for f in result], (above.sum(axis=1), p, p >= model.least)))

        return compute

    return per_batch(docs.withColumn(own, raw("text")), make, result, columns)


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 toxic, 1 low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5, prefix: str = "") -> DataFrame:
    """Train on the labelled documents and score every document."""
    return score(docs, train(docs, grades(labels), n_grades=3, select_from=2, least=least), prefix)
