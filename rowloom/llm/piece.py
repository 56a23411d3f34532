"""SentencePiece encoding and decoding of merge-type models.

Exact encoding by backtracking. The merge process of such a model takes the best scored
pair of neighbours again and again. A sequence of pieces is its outcome if and only if
each two neighbours in it are stable: merging their joint text anew gives the same two
pieces. So an encoder can go from left to right: take the longest piece that starts here
(Aho-Corasick automaton), check it against the piece before by re-merging the two, try the
next shorter one where the check fails, and step back where none is left. A position from
which no way leads on is noted in a bitfield and never entered again, so the work grows
with the text.

Texts are cut where no piece can reach across (before white space that follows something
else), and what has been encoded once is remembered within bounds.

Cases: a null or empty text has no ids. Characters without a piece become byte pieces.
Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from rowloom.llm.common import Remembered, per_batch, prepare, unused, whole, without

MARK = "▁"  # stands for a space inside pieces
#: segments a task remembers with their ids before it starts anew
SEGMENT_MEMORY = 600_000


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.text = {i: p for p, i in self.ids.items()}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {bytes([int(model.id_to_piece(i)[1:-1], 16)]): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        self.stable = lru_cache(maxsize=1 << 18)(self._stable)
        self._hold = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and self.merge(piece) == [piece]:  # others never are an outcome
                self._hold.add_word(piece, piece)
        self._hold.make_automaton()
        inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(pair[1] == MARK and pair[0] != MARK for pair in inner):
            raise ValueError("pieces reach across spaces; this model can't be cut into words")
        held = {c for pair in inner for c in pair}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in held)
        self.cut = re.compile(rf" *[^ {alone}]+| +|[{alone}]" if alone else r" *[^ ]+| +").findall
        self.remember = Remembered(self._known, SEGMENT_MEMORY)

    def merge(self, text: str) -> list[str]:
        """The model's own merge process: best score first, then leftmost."""
        parts, n = list(text), len(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score = self.score

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := score.get(parts[i] + parts[j])) is not None:
                heappush(heap, (-s, i, j, parts[i], parts[j]))

        heap: list = []
        for i in range(n - 1):
            offer(i, i + 1)
        heapify(heap)
        while heap:
            _, i, j, a, b = heappop(heap)
            if parts[i] != a or parts[j] != b or not a or not b or right[i] != j:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def _stable(self, a: str, b: str) -> bool:
        return self.merge(a + b) == [a, b]

    def _starts(self, text: str) -> list[list[str]]:
        """For each position the pieces that start there; ends ascend, so the longest is last."""
        found: list[list[str]] = [[c] for c in text]
        for end, piece in self._hold.iter(text):
            found[end - len(piece) + 1].append(piece)
        return found

    def pieces(self, text: str) -> list[str]:
        """Exact pieces of one segment, by backtracking."""
        n = len(text)
        if n == 1:
            return [text]
        starts = self._starts(text)
        failed = bytearray(n // 8 + 1)
        path: list[str] = []
        stable, last = self.stable, ""
        at, left = 0, [len(starts[0])]  # left: candidates not yet tried at each open position
        while at < n:
            options, k = starts[at], left[-1]
            chosen = None
            while k:
                k -= 1
                piece = options[k]
                to = at + len(piece)
                if to < n and failed[to >> 3] >> (to & 7) & 1:
                    continue
                if not last or stable(last, piece):
                    chosen = last = piece
                    break
            left[-1] = k
            if chosen is not None:
                path.append(chosen)
                at += len(chosen)
                if at < n:
                    left.append(len(starts[at]))
                continue
            left.pop()
            failed[at >> 3] |= 1 << (at & 7)
            at -= len(path.pop())
            last = path[-1] if path else ""
        return path

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[bytes([b])] for b in piece.encode()]

    def _known(self, segment: str) -> str | tuple[str, str]:
        """Ids of one segment as text; with the text they decode to where that differs."""
        pieces = self.pieces(segment.replace(" ", MARK))
        try:
            return ",".join([str(self.ids[p]) for p in pieces])  # plain pieces spell the segment
        except KeyError:
            ids = [i for p in pieces for i in self.ids_of(p)]
        surface, written = self.surface(ids), ",".join(map(str, ids))
        return written if surface == segment else (written, surface)

    def surface(self, ids: list[int]) -> str:
        """Text of ids, spaces in place; runs of byte pieces are read as UTF-8."""
        out, run = [], b""
        for i in ids:
            if i in self.byte_of:
                run += self.byte_of[i]
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = b""
            out.append(self.text.get(i, ""))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def _segments(self, text: str) -> tuple[list[str], list]:
        """The segments of a text and what is known of each. The model puts a space in front."""
        cut = self.cut(" " + text.replace(MARK, " ")) if text else []
        return cut, list(map(self.remember.__getitem__, cut))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin and end."""
        written, _, _ = self.summary(text)
        return list(map(int, written.split(","))) if written else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding put in front goes."""
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") else text

    def summary(self, text: str) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the text they decode to."""
        cut, known = self._segments(text)
        try:
            ids, decoded = ",".join(known), "".join(cut)
        except TypeError:
            ids = ",".join(k if isinstance(k, str) else k[0] for k in known)
            decoded = "".join(c if isinstance(k, str) else k[1] for c, k in zip(cut, known))
        return ids, ids.count(",") + 1 if ids else 0, decoded[1:] if decoded.startswith(" ") else decoded


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """The encoder of a model file, made once in each worker."""
    return Pieces(path)


ENCODED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
DIGESTS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ids (array) and decoded (their text)."""
    prepare(docs.sparkSession)
    docs = without(docs, "ids", "decoded")
    own = unused(docs, "whole")

    def make():
        pieces = load(path)

        def compute(batch: pa.RecordBatch) -> dict:
            ids = [pieces.encode(x) for x in batch.column(own).to_pylist()]
            return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": [pieces.decode(x) for x in ids]}

        return compute

    return per_batch(docs.withColumn(own, whole(text)), make, ENCODED, docs.columns)


def encode_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the number of ids and digests of ids and decoded text."""
    prepare(docs.sparkSession)
    docs = without(docs, *[f.name for f in DIGESTS])
    own = unused(docs, "whole")

    def make():
        pieces = load(path)

        def compute(batch: pa.RecordBatch) -> dict:
            rows = [pieces.summary(x) for x in batch.column(own).to_pylist()]
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            return {
                "n_tokens": pa.array([r[1] for r in rows], pa.int64()),
                "ids_sha256": pa.array([sha(r[0]) for r in rows], pa.string()),
                "decoded_sha256": pa.array([sha(r[2]) for r in rows], pa.string()),
            }

        return compute

    return per_batch(docs.withColumn(own, whole(text)), make, DIGESTS, docs.columns)
