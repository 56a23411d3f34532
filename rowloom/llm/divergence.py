"""Quality rules: how far a document's letters and common words are from its language.

References are counted over all documents of a language: a histogram of character classes,
and one of the language's ``COMMON`` most frequent words with one place for all others. A
document's histograms are compared with them by Jensen-Shannon distance (base 2, its square
root, so between 0 and 1). Base rules come first: too few words, or too many words in
repeated windows.

Minimum-length guards: characters are compared from ``LEAST_CHARS`` characters on, words from
``LEAST_WORDS`` words on, because short texts are far from any reference by chance. For the
same reason the allowed distances shrink towards their limits with the square root of the
length.

Cases: a null or empty text has no words and fails the base rules. A null language is a
language of its own. A language with few documents is compared with itself all the same.
Repeated rows are judged one by one; columns of ``docs`` pass through, and those named as
the results are replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rowloom.llm.common import hashed, per_batch, prepare, raw, rolling, unused, without, word_hashes
from rowloom.session import materialise

COMMON = 50
LEAST_CHARS, LEAST_WORDS = 200, 60
#: limits for long texts, and what one over the square root of the length adds for short ones
FAR_CHARS, SLACK_CHARS, FAR_WORDS, SLACK_WORDS = 0.19, 2.0, 0.33, 1.2
SYMBOLS = b"#*$%&|<>"
#: byte classes: letters, capitals, digits, blanks, line ends, stops, quotes and brackets,
#: symbols, other ASCII, first bytes of other characters, their other bytes
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n\v\f", b".,;:!?", b"'\"()[]{}-", SYMBOLS]
N_CLASSES = len(CLASSES) + 3
BLANKS = b" \t\n\r\v\f"

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("js_chars", T.DoubleType()),
    T.StructField("js_words", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def _class_of_byte() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.uint8)
    out[128:192], out[192:] = len(CLASSES) + 2, len(CLASSES) + 1
    for k, members in enumerate(CLASSES):
        out[list(members)] = k
    return out


def class_counts(data: bytes) -> np.ndarray:
    """Characters of each class; a character counts once, by its first byte."""
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    counts = np.bincount(_class_of_byte(), weights=by_byte, minlength=N_CLASSES)
    return counts[: N_CLASSES - 1]


def repeated_words(words: list[bytes], memory) -> int:
    """Words that lie in a window of eight words found twice or more."""
    if len(words) < 9:
        return 0
    windows = rolling(hashed(words, memory), 8)
    _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[back] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 8, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0]))
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Per language: class counts, its common words and their counts with all others last.

    Counted over all of ``docs`` (lang, data); each task sends the counts of its words. What
    comes to the driver is ``COMMON`` words and a dozen numbers for each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES - 1))

        def rows():
            out = [(lang, w, None, n) for lang, c in words.items() for w, n in c.items()]
            out += [(lang, None, k, int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
            columns = zip(*out) if out else ([], [], [], [])
            types = (pa.string(), pa.binary(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "word", "class", "n"])

        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data").to_pylist()):
                words[lang].update(data.lower().split())
                classes[lang] += class_counts(data)
            if sum(map(len, words.values())) > 1_000_000:
                yield rows()
                words.clear()
                classes.clear()
        yield rows()

    counted = docs.mapInArrow(count, "lang string, word binary, class int, n long")
    sums = materialise(counted.groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "language-counts")
    words = sums.where("word IS NOT NULL")
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # two rounds, so that no task ranks all words of a large language
    first = Window.partitionBy("lang", "slice").orderBy(F.desc("n"), "word")
    few = words.withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(64))).withColumn("r", F.row_number().over(first)).where(F.col("r") <= COMMON)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    few = few.withColumn("r", F.row_number().over(best)).where(F.col("r") <= COMMON).orderBy("lang", "r").collect()
    out = {}
    for lang, total in totals.items():
        mine = [(bytes(r.word), r.n) for r in few if r.lang == lang]
        out[lang] = (np.zeros(N_CLASSES - 1), [w for w, _ in mine], np.array([n for _, n in mine] + [total - sum(n for _, n in mine)], float))
    for r in sums.where("class IS NOT NULL").collect():
        if r.lang in out:
            out[r.lang][0][r["class"]] = r.n
    return out


def judge(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the base counts, both distances and ``kept``."""
    prepare(docs.sparkSession)
    docs = without(docs, *[f.name for f in FIELDS])
    data_, lang_ = unused(docs, "data"), unused(docs, "language")
    rows = docs.withColumn(data_, raw(text)).withColumn(lang_, F.coalesce(F.col(lang), F.lit("")))
    known = references(rows.select(F.col(lang_).alias("lang"), F.col(data_).alias("data")))

    def make():
        memory = word_hashes()
        places = {k: {w: i for i, w in enumerate(v[1])} for k, v in known.items()}

        def compute(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {f.name: [] for f in FIELDS}
            for data, language in zip(batch.column(data_).to_pylist(), batch.column(lang_).to_pylist()):
                words, reference = data.split(), known.get(language)
                n, repeated = len(words), repeated_words(words, memory)
                failed = n < 20 or 100 * repeated > 30 * n
                chars = text_chars(data)
                js_chars = js_words = 0.0
                if reference and chars >= LEAST_CHARS:
                    js_chars = distance(class_counts(data), reference[0])
                if reference and n >= LEAST_WORDS:
                    place = places[language]
                    found = Counter(data.lower().split())
                    common = np.array([found.get(w, 0) for w in place] + [0.0])
                    common[-1] = n - common.sum()
                    js_words = distance(common, reference[2])
                far = js_chars > FAR_CHARS + SLACK_CHARS / np.sqrt(max(1, chars))
                far = far or js_words > FAR_WORDS + SLACK_WORDS / np.sqrt(max(1, n))
                values = (
                    n,
                    text_chars(data.translate(None, BLANKS)),
                    len(data) - len(data.translate(None, SYMBOLS)),
                    duplicate_lines(data),
                    repeated,
                    failed,
                    js_chars,
                    js_words,
                    not failed and not far,
                )
                for f, v in zip(FIELDS, values):
                    out[f.name].append(v)
            return {f.name: pa.array(out[f.name], _ARROW[type(f.dataType)]) for f in FIELDS}

        return compute

    return per_batch(rows, make, FIELDS, docs.columns)


_ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}
_LATER = bytes(range(128, 192))


def text_chars(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) if data.isascii() else len(data.translate(None, _LATER))
