import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import repair_files as R
from feedloom.llm.registry import tokenizer_path

TEXTS = [
    "It's a\x1ctest\x0bof 'things' don't, WE'LL see <|endoftext|> é İstanbul ΣΑΣ 123x",
    "",
    None,
    " \t ",
    "Ünïcode space   em; é combining ́alone 日本語 テスト",
    "the cat and the dog and the cat " * 900,
    "word",
    "Élan Über straße, naïve. don't. it's, Kelvin\u212a \u212bngström ﬁn. e\u0301, x.. y., .z ,, 5. ªº µm Ÿ Ž ǅ. <|EndOfText|> <|endoftext|>.",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_words_apart_equal_whole_texts(library):
    ids, counts = R.WordEncoder(tokenizer_path()).encode(pa.array(TEXTS))
    at = np.cumsum(counts) - counts
    for k, text in enumerate(TEXTS):
        assert ids[at[k] : at[k] + counts[k]].tolist() == library.encode(text or "", add_special_tokens=False).ids + [R.END]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=40), min_size=1, max_size=6))
def test_round_trip(docs):
    counts = np.array([len(d) + 1 for d in docs])
    ids = np.array([x for d in docs for x in [*d, R.END]], dtype=np.uint16)
    rules, lengths, symbols, firsts = R.compress(ids, counts, least=2, first=5)
    base = int(ids.max()) + 1
    assert R.expand(symbols, rules, base).tolist() == ids.tolist()
    assert len(symbols) <= len(ids) and len(firsts) == len(docs)
    shard = {"firsts": firsts.astype(np.uint32).tobytes(), "symbols": symbols.tobytes(), "rules": rules.tobytes(), "lengths": np.concatenate(([base], lengths)).astype(np.uint32).tobytes()}
    for k, d in enumerate(docs):
        assert R.decode_document(shard, k).tolist() == [*d, R.END]


def test_files(spark, library, tmp_path, monkeypatch):
    rows = [(k * 7 % 23, TEXTS[k % len(TEXTS)], "p", 1) for k in range(23)] + [(5, "repeated", "p", 1), (5, "repeated", "p", 1), (None, "no id", "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part string, tokens int")
    path = str(tmp_path / "files")
    R.write_files(docs, path, tokenizer_path(), partitions=3)
    got = [tuple(r) for r in R.read_files(spark, path).orderBy("start").collect()]
    start = 0
    marks = {r[0]: r[1] for r in docs.selectExpr("coalesce(text, '')", "xxhash64(coalesce(text, ''))").collect()}
    for (doc_id, text, *_), g in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1] or ""])), got, strict=True):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [R.END], dtype="<u4")
        assert g == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sum(1 for r in spark.read.parquet(path).collect()) >= 3
    assert R.encode_and_read(docs.limit(0), tokenizer_path()).count() == 0


def test_encoding_holds_little(library):
    """Eight megabytes of ever new words: a worker remembers a bounded number and takes a few of the texts at once."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(3000)) for _ in range(270)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    encoder = R.WordEncoder(tokenizer_path())
    pa.default_memory_pool().release_unused()
    tracemalloc.start()
    got = [encoder.encode(piece.column("text")) for piece in R.T.pieces(batch, most=R.PIECE_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) > 3 and len(encoder.known) + len(encoder.older) <= R.CACHE_WORDS <= 500_000
    assert peak < 200 << 20
    ids, counts = np.concatenate([ids for ids, _ in got]), np.concatenate([counts for _, counts in got])
    at = np.cumsum(counts) - counts
    for k in (0, 100, 269):
        assert ids[at[k] : at[k] + counts[k]].tolist() == library.encode(texts[k], add_special_tokens=False).ids + [R.END]


def test_remembered_words_take_little(library):
    """A hundred and fifty thousand words stay in some 50 bytes each, as no Python objects."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(3000)) for _ in range(50)]
    encoder = R.WordEncoder(tokenizer_path())
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for k in range(0, 50, 10):
        encoder.encode(pa.array(texts[k : k + 10]))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(encoder.known) + len(encoder.older) > 149_000 and held < 12 << 20


@pytest.mark.parametrize("words, size", [(1, 1 << 20), (40, 1 << 20), (1000, 1)])
def test_words_forgotten_are_encoded_again(library, monkeypatch, words, size):
    monkeypatch.setattr(R, "CACHE_WORDS", words)
    monkeypatch.setattr(R, "CACHE_BYTES", size, raising=False)
    encoder = R.WordEncoder(tokenizer_path())
    texts = [t or "" for t in TEXTS] + [f"word{k} straße{k % 3} WORD" + "é" * (k % 4) for k in range(60)]
    for k in [*range(len(texts)), *range(len(texts))]:
        ids, counts = encoder.encode(pa.array([texts[k], texts[(k * 7) % len(texts)]]))
        both = [library.encode(texts[j], add_special_tokens=False).ids + [R.END] for j in (k, (k * 7) % len(texts))]
        assert ids.tolist() == sum(both, []) and counts.tolist() == [len(x) for x in both]
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0]
