"""The codec against the tokenizers library, id by id."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedloom.llm import bpe_codec

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe_codec.ByteBpe(PATH)
TEXTS = [
    "", None, "it's I'll 've we'rex 'S 's's' don''t !'s '2 x'll", "  two\n\n  x ", "a  b \t c  \r\n's",
    "<|endoftext|>x <|endoftext|> <|endoftext|>  ", "日本語テキスト🎉🎉 １２３", " x　y\u0085z", "a" * 5000, "ab" * 3000 + " " * 500,
]


def same_as_library(texts):
    ids, counts = CODEC.encode(pa.array(texts, pa.string()))
    ends = np.concatenate(([0], np.cumsum(counts)))
    back = CODEC.decode(ids, counts)
    for k, text in enumerate(texts):
        wanted = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert ids[ends[k] : ends[k + 1]].tolist() == wanted, text
        assert back[k] == LIBRARY.decode(wanted, skip_special_tokens=False) == (text or "")


def test_awkward_texts():
    same_as_library(TEXTS)
    same_as_library([])


def test_random_texts():
    rng = random.Random(3)
    signs = "abcdefst'  \n\t é1234!.,<|>日𝟙́ﬁ "
    same_as_library(["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(2000)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text(texts):
    same_as_library(texts)


def test_proposals_are_verified():
    """Words whose longest matches are not what merging gives are found by their pairs, and only they are merged."""
    rng = random.Random(4)
    words = [bytes(rng.choice(b"aeionrstlhd") for _ in range(rng.randrange(2, 14))) for _ in range(3000)]
    ids, counts = CODEC.propose(words)
    first = np.cumsum(counts) - counts
    wrong = 0
    for w, a, n in zip(words, first, counts):
        run = ids[a : a + n]
        fine = bool(CODEC.compatible(run[:-1], run[1:]).all()) if n > 1 else True
        true = CODEC.merged(w)
        assert b"".join(CODEC._flat[CODEC._place[t] : CODEC._place[t] + CODEC._width[t]].tobytes() for t in run) == w
        if fine:
            assert run.tolist() == true
        wrong += run.tolist() != true
    assert wrong
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in CODEC.merged_all(words)] == [CODEC.merged(w) for w in words]


def test_decode_any_ids():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50257, 4000)
    assert CODEC.decode(ids, np.array([4000]))[0] == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)
    assert CODEC.decode(np.array([-1, 64, 10**6, 65]), np.array([1, 2, 0, 1])) == ["", "a", "", "b"]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe_codec.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_tables(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "same"), (3, TEXTS[3]), (3, "another text of 3")]
    docs = spark.createDataFrame([(*r[:2], "x", 1) for r in rows], "doc_id bigint, text string, ids string, n_tokens int")
    got = sorted(map(tuple, bpe_codec.digests(docs, PATH).collect()), key=str)
    wanted = []
    for k, text, *_ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        wanted.append((k, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(wanted, key=str)
    back = bpe_codec.decoded(bpe_codec.encoded(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((k, t or "") for k, t, *_ in rows), key=str)
    assert bpe_codec.digests(docs.limit(0), PATH).collect() == []
    assert bpe_codec.decoded(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), PATH).collect()[0]["text"] == ""
