import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from thalweg.llm.token_counts import SPACE, Counter, Vocabulary, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def one(count):
    return lambda text: int(count(pa.array([text], pa.string()))[0])


def library(v, byte_fallback):
    t = Tokenizer(Unigram(v.pieces, v.unknown, byte_fallback))
    t.pre_tokenizer = Metaspace(replacement=SPACE, prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def whole():
    v = Vocabulary.from_sentencepiece(PATH)
    return one(Counter(v, 1000)), library(v, True)


def test_real_texts(spark, whole):
    count, want = whole
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert count(r.text) == want(r.text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab cé\n▁日🙂<0x1>\t", max_size=40))
def test_odd_texts(whole, text):
    count, want = whole
    assert count(text) == want(text)


def test_small_vocabularies():
    rng = random.Random(5)
    for seed in range(60):
        pieces = {"<unk>": 0.0} | {"".join(rng.choices("ab▁c\n", k=rng.randint(1, 4))): float(rng.choice([-1, -2, -3, -1.5, 0])) for _ in range(12)}
        if seed % 2:
            pieces |= {f"<0x{b:02X}>": -9.0 for b in range(256)}
        v = Vocabulary(list(pieces.items()))
        count, want = one(Counter(v, 8)), library(v, bool(seed % 2))
        for _ in range(80):
            text = "".join(rng.choices("ab c\nxé", k=rng.randint(0, 14)))
            assert count(text) == want(text), (v.pieces, text)
        texts = ["".join(rng.choices("ab c\nxé ", k=rng.randint(0, 80))) for _ in range(40)]
        assert Counter(v, 8)(pa.array(texts)).tolist() == list(map(want, texts))


def test_frames(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5), (4, "x" * 100_000, 5)], "doc_id long, text string, n_tokens int")
    got = [r.n_tokens for r in token_counts(rows, PATH).orderBy("doc_id").collect()]
    assert got[:2] == [0, 0] and got[2] == got[3] == 2 and got[4] > 100
    assert token_counts(rows.limit(0), PATH).count() == 0


def test_a_very_long_text(whole):
    count, want = whole
    rng = random.Random(11)
    text = " ".join("".join(rng.choices("abcdefghij,.\n", k=rng.randint(1, 9))) for _ in range(250_000))
    assert len(text) > 1 << 20 and count(text) == want(text)
