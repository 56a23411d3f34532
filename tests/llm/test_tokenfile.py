import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rowloom.llm import tokenfile
from rowloom.llm.catalog import word_model
from rowloom.session import scratch_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(word_model())
    return lambda text: model.encode(text or "", add_special_tokens=False).ids + [tokenfile.END_ID]


@pytest.fixture(scope="module")
def words():
    return tokenfile.Words(word_model(), 4)


ODD = [
    "", " ", "Ａ b́ ́x", "a b c", "x\x1cy\x1f z\x85w", "<|startoftext|> a<|endoftext|>b", "don't it's 'S I'LL",
    "ΣΑΣ ΑΣ. ΌΣΟΣ", "İstanbul ǅ ﬁ", "🙂🙂 👩‍👩‍👧", "a\n\r\t\x0b\x0cb", "é ́e", "中文 字", "\x00 a\x00b", "한국어 각",
]


@pytest.mark.parametrize("text", ODD)
def test_words_are_the_whole_text(text, words, library):
    assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() + [1] == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    model = getattr(test_any_text, "model", None) or (Tokenizer.from_file(word_model()), tokenfile.Words(word_model(), 4))
    test_any_text.model = model
    want = model[0].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(model[1].encode(text.encode()), "<u4").tolist() == want


@pytest.mark.parametrize("shard_bytes", [64 << 20, 500])
def test_files_hold_the_ids(spark, prose, library, shard_bytes):
    rows = prose + [(1_000, None), (1_001, ""), (-5, "first of all")]
    random.Random(2).shuffle(rows)
    folder = scratch_path(spark, "files")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokenfile.write(docs, folder, word_model(), shard_bytes=shard_bytes)
    shards = tokenfile.shards_of(spark, folder).orderBy("shard").collect()
    assert (len(shards) == 1) == (shard_bytes > 500)
    flat, starts = [], []
    for line in shards:  # the files alone, as another reader would read them
        path = folder.removeprefix("file://")
        flat += np.fromfile(f"{path}/{line.tokens_file}", "<u2").tolist()
        starts += np.fromfile(f"{path}/{line.offsets_file}", "<u8").tolist()[:-1]
    want = [(i, library(t)) for i, t in sorted(rows)]
    assert flat == [x for _, ids in want for x in ids]
    assert starts == np.cumsum([0] + [len(ids) for _, ids in want])[:-1].tolist()
    got = {r.doc_id: r.ids for r in tokenfile.read(spark, folder).collect()}
    assert got == dict(want)


def expected(rows, library):
    out, at = [], 0
    for doc_id, ids in sorted(((i, library(t)) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_edges(spark, edges, nothing, library):
    got = tokenfile.round_trip(edges, word_model())
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    key = lambda r: (r[1], r[0] or 0)
    want = expected([(r.doc_id, r.text) for r in edges.collect()], library)
    same = [tuple(r) for r in got.collect()]
    # documents of equal id are ordered by a hash of their ids
    assert {(r[0], r[2], r[3]) for r in same} == {(r[0], r[2], r[3]) for r in want} and len(same) == len(want)
    same.sort(key=key)
    assert [r[1] for r in same] == np.cumsum([0] + [r[2] for r in same])[:-1].tolist()
    assert [r[0] for r in same] == [r[0] for r in want]
    assert tokenfile.round_trip(nothing, word_model()).count() == 0


def test_text_ids_and_one_id_for_all(spark, library):
    docs = spark.range(400).select(F.lit("same").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    folder = scratch_path(spark, "files")
    tokenfile.write(docs, folder, word_model(), shard_bytes=300)
    shards = tokenfile.shards_of(spark, folder).collect()
    assert len(shards) > 4 and max(r.documents for r in shards) < 200  # the one id is dealt to many shards
    got = tokenfile.summary(spark, folder).collect()
    assert len(got) == 400 and {r.doc_id for r in got} == {"same"}


def test_letters_of_all_kinds(words, library):
    letters = "".join(chr(c) for c in range(0x41, 0x100) if chr(c).isalpha())
    draw = random.Random(5)
    texts = [letters, *letters] + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 12))) for _ in range(3_000)]
    for text in texts:
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() + [1] == library(text), text


def test_other_rules_encode_whole_texts(words):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, model = tokenfile.Words(path, 2), Tokenizer.from_file(path)
    assert words.apart and not other.apart
    for text in ODD:
        want = model.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(other.encode(text.encode()), "<u2").tolist() == want


def test_wide_ids():
    assert tokenfile.width_of(word_model(), 1) == 2 and tokenfile.width_of(word_model(), 70_000) == 4
