"""Token counts by section: whole documents are encoded once, and token spans are interval-joined to sections.

A byte-level vocabulary keeps every byte of a text in exactly one token, so token spans are running sums of token lengths.
Sections are spans of characters of the document; a document's tokens and sections are joined by binary search on their
ends. The rule for a token that crosses a boundary: it belongs to the section that holds most of its bytes, of equal ones
to the first; a token without a byte in any section belongs to none.

Encoding uses tiktoken. Its pattern cuts before every single blank, so distinct pieces are encoded once per worker; a text
in which a blank follows white space is encoded whole.
"""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import text as T
from feedloom.llm.common import text_of
from feedloom.llm.repair_files import spread

CACHE_PIECES = 400_000
SECTION = "array<struct<start:int,stop:int>>"


class TokenLengths:
    """Byte lengths of the tokens of texts."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.uint8)
        for token, rank in ranks.items():
            self.size[rank] = min(255, len(token))
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, np.ndarray] = {}

    def of(self, piece: str) -> np.ndarray:
        return self.size[np.asarray(self.library.encode_ordinary(piece), dtype=np.int64)]

    def lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of all tokens, and the number of tokens of each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = pc.match_substring_regex(texts, r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] ")
        parts = pc.split_pattern(pc.if_else(whole, pa.scalar("", pa.large_string()), texts), " ")
        if isinstance(parts, pa.ChunkedArray):
            parts = parts.combine_chunks()
        per = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        blank = np.full(int(per.sum()), " ", dtype=object)
        blank[np.cumsum(per) - per] = ""
        pieces = pc.binary_join_element_wise(pa.array(blank, pa.large_string()), parts.flatten(), pa.scalar("", pa.large_string())).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.known) + len(distinct) > CACHE_PIECES:
            self.known = {}
        for p in distinct:
            if p not in self.known:
                self.known[p] = self.of(p)
        tables = [self.known[p] for p in distinct]
        index = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        at = np.cumsum(per) - per
        for k in alone:
            index[at[k]] = len(tables)
            tables.append(self.of(texts[int(k)].as_py()))
        count = np.array([len(x) for x in tables], dtype=np.int64)
        flat = np.concatenate(tables) if tables else np.zeros(0, dtype=np.uint8)
        sizes = flat[spread((np.cumsum(count) - count)[index], count[index])].astype(np.int64)
        return sizes, np.add.reduceat(count[index], at) if len(at) else per


def worker_lengths(path: str, pattern: str) -> TokenLengths:
    """This worker's tables; they live as long as the worker."""
    home = sys.modules.setdefault("_feedloom_lengths", types.ModuleType("_feedloom_lengths"))
    if path not in home.__dict__:
        home.__dict__[path] = TokenLengths(path, pattern)
    return home.__dict__[path]


def attribute(start: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, sections each token touches); spans are sorted, sections do not overlap."""
    first = np.searchsorted(high, start, side="right")
    touched = np.maximum(0, np.searchsorted(low, stop, side="left") - first)
    token = np.repeat(np.arange(len(start)), touched)
    section = spread(first, touched)
    shared = np.minimum(stop[token], high[section]) - np.maximum(start[token], low[section])
    real = shared > 0
    token, section, shared = token[real], section[real], shared[real]
    order = np.lexsort((section, -shared, token))
    token, section = token[order], section[order]
    out = np.full(len(start), -1, dtype=np.int64)
    begins = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, dtype=bool)
    out[token[begins]] = section[begins]
    return out, np.bincount(token, minlength=len(start))


def count_by_section(docs: DataFrame, path: str, pattern: str, sections: str | None = None) -> DataFrame:
    """(doc_id, section, start, stop, n_tokens, n_crossing) for every section of every row of ``docs``.

    ``sections`` names a column of (start, stop) in characters, sorted and apart; without it the lines are the sections.
    n_tokens: tokens that belong to the section; n_crossing: those of them with bytes outside it. Tokens of no section are
    on a row with section -1, null bounds and all tokens counted as crossing; each document has that row, so a null or empty
    text gives it with no tokens (and, with lines, one empty line). Repeated rows are counted each.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(sections).cast(SECTION).alias("sections")) if sections else text_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker_lengths(path, pattern)
        for batch in batches:
            for piece in T.pieces(batch, rows=1024):
                data, at = T.raw(piece.column("text"))
                sizes, per = tables.lengths(piece.column("text"))
                lists = piece.column("sections").to_pylist() if sections else None
                ends = np.cumsum(sizes)
                to = np.cumsum(per)
                out: list[list] = [[], [], [], [], [], []]
                ids = piece.column("doc_id").to_pylist()
                for k, doc_id in enumerate(ids):
                    text = data[at[k] : at[k + 1]]
                    place = np.flatnonzero((text & 0xC0) != 0x80)  # first byte of each character
                    if lists is None:
                        breaks = np.flatnonzero(text == 10)
                        low, high = np.concatenate(([0], breaks + 1)), np.append(breaks, len(text))
                        chars = np.searchsorted(place, low), np.searchsorted(place, high)
                    else:
                        spans = np.array([(s["start"], s["stop"]) for s in lists[k] or []], dtype=np.int64).reshape(-1, 2)
                        chars = spans[:, 0], spans[:, 1]
                        edge = np.append(place, len(text))
                        low, high = (edge[np.clip(c, 0, len(edge) - 1)] for c in chars)
                    stop = ends[to[k] - per[k] : to[k]] - at[k]
                    start = stop - sizes[to[k] - per[k] : to[k]]
                    own, _ = attribute(start, stop, low, high)
                    inside = own >= 0
                    n = np.bincount(own + 1, minlength=len(low) + 1)
                    over = np.zeros(len(own), dtype=bool)
                    over[inside] = (start[inside] < low[own[inside]]) | (stop[inside] > high[own[inside]])
                    crossing = np.bincount(own[over] + 1, minlength=len(low) + 1)
                    crossing[0] = n[0]
                    count = len(low) + 1
                    for column, values in zip(out, ([doc_id] * count, range(-1, count - 1), [None, *chars[0].tolist()], [None, *chars[1].tolist()], n.tolist(), crossing.tolist())):
                        column.extend(values)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return rows.mapInArrow(run, "doc_id bigint, section int, start int, stop int, n_tokens bigint, n_crossing bigint")
