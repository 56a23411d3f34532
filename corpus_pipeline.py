"""From raw documents to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read
again as the documents of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import exact, jaccard, mixing, ordinal, piece
from rowloom.llm.catalog import piece_model
from rowloom.llm.common import prepare, table
from rowloom.session import materialise

#: share of the tokens that the mix keeps, and language shares it aims at
MIX_SHARE = 0.8
LANGUAGES = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects. A null or empty text is scored like any other;
    without ratings all stay. Rows that share an id are judged one by one."""
    prepare(spark)
    scored = ordinal.select(docs, table(spark, sf_dir, "labels"), prefix="_quality_")
    return scored.where("_quality_kept").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the smallest id, null ids last; null counts as empty."""
    return exact.first_copies(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id. Texts without words and
    rows without an id stay; of rows that share an id one stays."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares, as far as their
    tokens reach (``mixing.shares``). Languages that are not named keep their share; null is a value
    of its own; documents of cells without words go."""
    return mixing.sample(docs, share=MIX_SHARE, languages=LANGUAGES)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, whole, and digests of ids and decoded text; a null text has none."""
    return piece.encode_digests(docs.select("doc_id", "text", "lang", "source"), piece_model()).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", apart),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: the classifier is fitted, so no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
