import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x1c", max_size=30)), max_size=8)


def by_hand(text):
    return bytes((text or "").encode()).translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256))).split()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    data, at = T.raw(pa.array(texts, pa.string()))
    words = T.split_words(data, at, fold=True)
    runs, per = T.shingles(words)
    names, grams = {}, {}
    k = 0
    for d, text in enumerate(texts):
        want = by_hand(text)
        got = words.hashes[words.first[d] : words.first[d + 1]].tolist()
        assert len(got) == len(want)
        for h, w in zip(got, want):
            assert names.setdefault(h, w) == w
        tuples = [tuple(want)] if 0 < len(want) < 3 else list(zip(want, want[1:], want[2:]))
        assert per[d] == len(tuples)
        for h, g in zip(runs[k : k + len(tuples)].tolist(), tuples):
            assert grams.setdefault(h, g) == g
        k += len(tuples)
    assert len(set(names.values())) == len(names) and len(set(grams.values())) == len(grams)


def test_pieces_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c"])], names=["text"])
    assert [p.num_rows for p in T.pieces(batch, most=20)] == [2, 1, 2]
    assert [p.num_rows for p in T.pieces(batch, rows=2)] == [2, 2, 1]
