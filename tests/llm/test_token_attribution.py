import base64

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from feedloom.llm import token_attribution as A

PATH, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
TEXTS = ["One line.\nAnother  with two blanks\n\n\n and more\n", "", None, "é日本 テスト\n  x", "plain words only here", "tab\t x\n \n  y " * 40]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_hand(library, text, spans):
    """Counts per section (-1 first) from the tokens' bytes, one token after another."""
    text = text or ""
    edge = [len(text[:k].encode()) for k in range(len(text) + 1)]
    spans = [(edge[min(a, len(text))], edge[min(b, len(text))]) for a, b in spans]
    count, crossing, at = [0] * (len(spans) + 1), [0] * (len(spans) + 1), 0
    for token in library.encode_ordinary(text):
        to = at + len(library.decode_single_token_bytes(token))
        shares = [min(to, b) - max(at, a) for a, b in spans]
        best = max(range(len(spans)), key=lambda k: (shares[k], -k), default=-1)
        if best < 0 or shares[best] <= 0:
            best = -1
        count[best + 1] += 1
        crossing[best + 1] += best < 0 or at < spans[best][0] or to > spans[best][1]
        at = to
    return list(zip(count, crossing))


def lines(text):
    out, at = [], 0
    for line in (text or "").split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def test_lines(spark, library):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1), (None, "x\ny", 1)], "doc_id bigint, text string, section int")
    rows = A.count_by_section(docs, PATH, PATTERN).collect()
    for k, t in enumerate(TEXTS):
        got = sorted((r["section"], r["start"], r["stop"], r["n_tokens"], r["n_crossing"]) for r in rows if r["doc_id"] == k and k) if k else None
        if k:
            want = by_hand(library, t, lines(t))
            assert [(g[3], g[4]) for g in got] == want and [(g[1], g[2]) for g in got[1:]] == lines(t)
    assert sum(r["doc_id"] == 0 for r in rows) == 2 * (len(lines(TEXTS[0])) + 1)
    assert A.count_by_section(docs.limit(0), PATH, PATTERN).count() == 0


def test_sections_that_cut_tokens(spark, library):
    spans = [(0, 3), (3, 7), (9, 9), (9, 16), (18, 400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string")
    docs = docs.withColumn("parts", F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in spans]))
    rows = A.count_by_section(docs, PATH, PATTERN, "parts").collect()
    for k, t in enumerate(TEXTS):
        got = [(r["n_tokens"], r["n_crossing"]) for r in sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["section"])]
        assert got == by_hand(library, t, spans)
