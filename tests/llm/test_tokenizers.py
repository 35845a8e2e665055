import hashlib
import os
import random

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

from tarn.llm import bpe, tokencount  # noqa: E402
from tarn.llm.queries import queries  # noqa: E402
from tests.conftest import SF  # noqa: E402

BITS = ["a", "bc", "the", "The", "'s", "'", "'LL", "'ll", " ", "  ", "\n", "\t", "é", "É", "é", "ß", "中文", "　", "123", "4", "!", "?!", "<|endoftext|>", "<|startoftext|>", "😀", "́", "\x1c", "x" * 30, "ing", "ation", "Σ", "Σας", "İ", "_", "\x85", "\xa0", "½", "²", "'l", "'r", "e"]


def texts(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        own = r.sample(BITS, r.randint(1, len(BITS)))
        yield "".join(r.choice(own) for _ in range(r.randint(0, 100)))


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(bpe.vocabulary_path(tokencount.VOCABULARY))


def test_tree_equals_library(byte_level):
    c = bpe.codec(bpe.vocabulary_path())
    for i, t in enumerate(texts(800, 3)):
        want = byte_level.encode(t, add_special_tokens=False).ids
        got = c.encode(t, leaf=(1, 2, 3, 7, 20, 8192)[i % 6])
        assert got.tolist() == want, t
        assert c.decode(got).decode() == byte_level.decode(want, skip_special_tokens=False) == t


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 30_000 + "x", "ab" * 20_000, "中" * 20_000, "'" * 20_000, "1" * 20_000, "ab'll" * 5_000])
def test_unsplit_texts(byte_level, word_level, text):
    assert bpe.codec(bpe.vocabulary_path()).encode(text).tolist() == byte_level.encode(text, add_special_tokens=False).ids
    assert tokencount.counter(bpe.vocabulary_path(tokencount.VOCABULARY)).count(text) == len(word_level.encode(text, add_special_tokens=False).ids)


def test_counts_equal_library(word_level):
    c = tokencount.counter(bpe.vocabulary_path(tokencount.VOCABULARY))
    for t in texts(800, 4):
        assert c.count(t) == len(word_level.encode(t, add_special_tokens=False).ids), t


def test_count_table_is_bounded(monkeypatch, word_level):
    monkeypatch.setattr(tokencount, "TABLE", 3)
    c = tokencount.TokenCounter(bpe.vocabulary_path(tokencount.VOCABULARY))
    t = "one two three four five six one two three"
    assert c.count(t) == len(word_level.encode(t, add_special_tokens=False).ids) and len(c.table) <= 3


def test_queries(spark, byte_level, word_level):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op1_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = byte_level.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(byte_level.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in queries()["op2_token_counts"](spark, SF).collect():
        n = len(word_level.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 2048)


def test_long_texts_are_dealt(spark, byte_level):
    long = "<|endoftext|>" + "wort'll " * 9_000 + "x" * 9_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "short"), (None, long + "y"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(bpe.encode_column(df, long=10_000).collect(), key=lambda r: (r.doc_id or 0))
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4]
    want = byte_level.encode(long, add_special_tokens=False).ids
    assert got[1].ids == want and got[2].ids == want and got[4].ids == [] and got[5].ids == []
    assert got[0].ids == byte_level.encode(long + "y", add_special_tokens=False).ids
