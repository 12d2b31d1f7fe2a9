"""Byte-level BPE by speculation: longest matches are proposed, adjacent pairs are verified, failing words are merged exactly.

A text is cut at the vocabulary's added tokens and then into words by the byte-level pattern (contractions, runs of
letters, digits or other signs with one blank before them, white space), all at once as numpy arrays over the bytes of a
batch. A distinct word is encoded once per worker:

* proposal: the longest vocabulary token from the left, again and again, found for every byte by one walk down a trie;
* verification: merging by rank works like time, a token lives from its own merge to the merge that uses it up. Tokens
  a, b in a row stand in the true result unless some merge over their border fires first: between a node on the right
  edge of a's merge tree and one on the left edge of b's that live at the same time. All pairs walk down these two edges
  together. If no border of a word has such a merge, the proposal is what merging gives;
* exact merging only for words with a failing pair: many short ones a merge each at a time, long ones with a heap of ranks.

Files whose chain is another one than bytes, that pattern and ordered merges are refused, never encoded wrongly.
"""

from __future__ import annotations

import heapq
import json
import re
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

#: Words a worker remembers (two generations of half of them), and bytes of text it takes at once.
CACHE_WORDS, PIECE_BYTES = 400_000, 2 << 20
#: Bytes of a word up to which failing words are merged together.
SHORT = 64
LETTER, DIGIT, BLANK, OTHER, UNKNOWN = range(5)
NEVER = 1 << 40


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: visible Latin-1 signs for themselves, the others code points from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(seen))
    return {**{b: chr(b) for b in seen}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each character's first byte, and its code point."""
    place = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[place].astype(np.int32)
    if len(place) == len(data):
        return place, first
    padded = np.concatenate((data, np.zeros(3, dtype=np.uint8)))
    out = first.copy()
    for least, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        wide = np.flatnonzero(first >= least)
        value = first[wide] & keep
        for k in range(1, more + 1):
            value = (value << 6) | (padded[place[wide] + k] & 0x3F)
        out[wide] = value
    return place, out


class ByteBpe:
    """A vocabulary file's encoder and decoder."""

    def __init__(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        if (
            model.get("type") != "BPE"
            or any((model.get(k) or v) != v for k, v in plain.items())
            or cut.get("type") != "ByteLevel"
            or not cut.get("use_regex", True)
            or cut.get("add_prefix_space", True)
            or file.get("normalizer")
            or (file.get("decoder") or {}).get("type") != "ByteLevel"
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
        ):
            raise ValueError(f"no plain byte-level BPE file: {path}")
        self._splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._class = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        letters = {c: b for b, c in byte_letters().items()}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        by_length = sorted(filter(None, self.added), key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self._contents = by_length
        vocabulary: dict[str, int] = model["vocab"]
        self.size = 1 + max([*vocabulary.values(), *self.added.values()])
        raw: list[bytes] = [b""] * self.size
        for token, i in [*vocabulary.items(), *self.added.items()]:
            raw[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        self._learn(vocabulary, model["merges"], letters)
        self._trie([(raw[i], i) for i in np.flatnonzero(self.sound).tolist()])
        self._width = np.fromiter(map(len, raw), dtype=np.int64, count=self.size)
        self._place = np.cumsum(self._width) - self._width
        self._flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    # ------------------------------------------------------------------------------- merge rules

    def _learn(self, vocabulary: dict[str, int], merges: list, letters: dict[str, int]) -> None:
        """Merges by key, each token's parts and time of birth, and which tokens merging gives back for their own bytes."""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        a, b, made = (np.array([vocabulary[t] for t in side], dtype=np.int64) for side in ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
        time = np.arange(1, len(pairs) + 1)
        order = np.argsort(a * self.size + b, kind="stable")
        self._keys, self._times, self._made = (a * self.size + b)[order], time[order], made[order]
        if len(order) and (np.diff(self._keys) == 0).any():
            raise ValueError("a pair is merged twice")
        self.merges = {(x, y): (t, z) for x, y, t, z in zip(a.tolist(), b.tolist(), time.tolist(), made.tolist())}
        self.bytes = np.full(256, -1, dtype=np.int64)
        for c, byte in letters.items():
            if c in vocabulary:
                self.bytes[byte] = vocabulary[c]
        if (self.bytes < 0).any():
            raise ValueError("a byte has no token")
        self.birth = np.full(self.size, NEVER, dtype=np.int64)
        self.birth[made[::-1]] = time[::-1]
        self.birth[self.bytes] = 0
        if len(time) and not ((self.birth[a] < time) & (self.birth[b] < time)).all():
            raise ValueError("a merge is listed before its parts")
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.left[made], self.right[made] = a, b
        # A token of two merges has no single tree, so it is never proposed.
        ways = np.bincount(made, minlength=self.size)
        alone = (self.birth < NEVER) & (ways <= 1)
        once = np.flatnonzero(alone & (self.birth > 0))
        alone[once] = self.compatible(self.left[once], self.right[once], own=True)
        self.sound = alone.copy()
        for t in once[np.argsort(self.birth[once])].tolist():
            self.sound[t] &= self.sound[self.left[t]] & self.sound[self.right[t]]

    def compatible(self, a: np.ndarray, b: np.ndarray, own: bool = False) -> np.ndarray:
        """For each pair of tokens, whether no merge over their border fires; ``own`` leaves out the merge of the pair itself."""
        fine = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        r, l = a.copy(), b.copy()
        end_r, end_l = np.full(len(a), NEVER), np.full(len(a), NEVER)
        first = own
        while len(at):
            when, _ = self._times_of(r, l)
            # Of equal ranks the left one merges first: a's own before the border's, the border's before b's own.
            fires = (when < end_r) & (when <= end_l) & (when < NEVER)
            if first:
                fires[:] = False
                first = False
            fine[at[fires]] = False
            left = ~fires & ((self.birth[r] > 0) | (self.birth[l] > 0))
            at, r, l, end_r, end_l = at[left], r[left], l[left], end_r[left], end_l[left]
            down = self.birth[r] > self.birth[l]
            end_r = np.where(down, self.birth[r], end_r)
            end_l = np.where(down, end_l, self.birth[l])
            r, l = np.where(down, self.right[r], r), np.where(down, l, self.left[l])
        return fine

    def merged(self, word: bytes) -> list[int]:
        """The word's ids by merging the lowest rank, of equal ones the leftmost, until no pair is left."""
        ids = self.bytes[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = self.merges[x, y][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _times_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """When each pair of tokens merges (NEVER: not at all), and where the merge stands."""
        key = a * self.size + b
        k = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[k] == key, self._times[k], NEVER), k

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """As ``merged`` for many short words, one merge of each in a round; ids as little-endian 32-bit numbers."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        out: list[bytes] = [b""] * len(words)
        when, where = self._times_of(ids, np.append(ids[1:], 0))
        when[np.cumsum(size) - 1] = NEVER
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(when, first)
            over = least == NEVER
            if over.any():
                raw = ids.astype("<u4").tobytes()
                for w, a, n in zip(word[first[over]].tolist(), first[over].tolist(), count[over].tolist()):
                    out[w] = raw[4 * a : 4 * (a + n)]
            at = np.flatnonzero((when == np.repeat(least, count)) & (when < NEVER))
            at = at[np.concatenate(([True], word[at][1:] != word[at][:-1]))] if len(at) else at
            ids[at] = self._made[where[at]]
            left = np.repeat(~over, count)
            left[at + 1] = False
            spot = (np.cumsum(left) - 1)[at]
            ids, word, when, where = ids[left], word[left], when[left], where[left]
            again = np.unique(np.concatenate((spot[spot > 0] - 1, spot)))
            nearby = np.minimum(again + 1, len(ids) - 1)
            when[again], where[again] = self._times_of(ids[again], ids[nearby])
            when[again[(nearby == again) | (word[again] != word[nearby])]] = NEVER
        return out

    # ------------------------------------------------------------------------------------ proposal

    def _trie(self, tokens: list[tuple[bytes, int]]) -> None:
        """Edges (node * 256 + byte) in order with their lower nodes, and each node's token (-1: none)."""
        edges: dict[int, int] = {}
        ends = {}
        for token, i in tokens:
            node = 0
            for byte in token:
                node = edges.setdefault(node << 8 | byte, len(edges) + 1)
            ends[node] = i
        keys = np.fromiter(edges, dtype=np.int64, count=len(edges))
        nodes = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self._edges, self._below = keys[order], nodes[order]
        self._token = np.full(len(edges) + 1, -1, dtype=np.int64)
        self._token[list(ends)] = list(ends.values())

    def _longest(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every byte, the longest token from there that stays inside its word, and that token's length."""
        token, length = self.bytes[data], np.ones(len(data), dtype=np.int64)
        at, node = np.arange(len(data)), np.zeros(len(data), dtype=np.int64)
        depth = 0
        while len(at):
            key = node << 8 | data[at + depth]
            k = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            real = self._edges[k] == key
            at, node = at[real], self._below[k[real]]
            depth += 1
            found = self._token[node]
            hit = found >= 0
            token[at[hit]], length[at[hit]] = found[hit], depth
            inside = at + depth < end[at]
            at, node = at[inside], node[inside]
        return token, length

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words (none empty) by longest matches from the left, and each word's number of them."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stop = np.cumsum(size)
        token, length = self._longest(data, np.repeat(stop, size))
        taken = np.zeros(len(data), dtype=bool)
        at, last = stop - size, stop
        while len(at) > 64:
            taken[at] = True
            at = at + length[at]
            left = at < last
            at, last = at[left], last[left]
        for start, end in zip(at.tolist(), last.tolist()):  # the few longest words
            run = length[start:end].tolist()
            k, marks = 0, []
            while k < len(run):
                marks.append(k)
                k += run[k]
            taken[start + np.array(marks)] = True
        where = np.flatnonzero(taken)
        return token[where], np.diff(np.searchsorted(where, np.concatenate(([0], stop))))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        if not words:
            return []
        ids, counts = self.propose(words)
        first = np.cumsum(counts) - counts
        inner = np.ones(len(ids), dtype=bool)
        inner[first + counts - 1] = False
        here = np.flatnonzero(inner)
        kinds, index = np.unique(ids[here] * self.size + ids[here + 1], return_inverse=True)
        bad = here[~self.compatible(kinds // self.size, kinds % self.size)[index]] if len(here) else here
        failing = np.unique(np.searchsorted(first, bad, side="right") - 1)
        raw = ids.astype("<u4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + counts).tolist())]
        short = [w for w in failing.tolist() if len(words[w]) <= SHORT]
        for w, found in zip(short, self.merged_all([words[w] for w in short])):
            out[w] = found
        for w in failing.tolist():
            if len(words[w]) > SHORT:
                out[w] = np.array(self.merged(words[w]), dtype="<u4").tobytes()
        return out

    # --------------------------------------------------------------------------------------- words

    def _classes(self, points: np.ndarray) -> np.ndarray:
        """Each character's class as the pattern sees it; new characters are asked from the library's own splitter."""
        kinds = self._class[points]
        if (kinds == UNKNOWN).any():
            for point in np.unique(points[kinds == UNKNOWN]).tolist():
                joins = (len(self._splitter.pre_tokenize_str(head + chr(point))) == 1 for head in "a1!")
                self._class[point] = next((k for k, joined in zip((LETTER, DIGIT, OTHER), joins) if joined), BLANK)
            kinds = self._class[points]
        return kinds

    def word_starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First byte of each word of the texts, whose bytes follow one another and start at ``at``."""
        place, points = code_points(data)
        n = len(points)
        kind = self._classes(points)
        fresh = np.zeros(n + 1, dtype=bool)  # first character of a text
        fresh[np.searchsorted(place, at)] = True
        fresh[n] = True
        start = fresh.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        runs = start.copy()
        # The last blank before something is apart from those before it, and a space belongs to what follows.
        last = np.flatnonzero((kind == BLANK) & runs[1:] & ~fresh[1:])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # 's 't 'm 'd 're 've 'll
        mark = np.flatnonzero((points == 39) & start[:-1] & runs[:-1] & runs[1:] & ~fresh[1:])
        after = np.concatenate((points, [0, 0, 0]))
        one, two = after[mark + 1], after[mark + 2]
        more = runs[np.minimum(mark + 2, n)]  # the letters end after one
        short = np.isin(one, [115, 116, 109, 100])
        long = ~more & np.isin(one * 128 + np.minimum(two, 127), [114 * 128 + 101, 118 * 128 + 101, 108 * 128 + 108])
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
        return place[start[:n]]

    def _segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
        """Texts cut at added tokens: the segments, each one's text, and the added id after it (-1: none). None where nothing is cut."""
        holds = [pc.match_substring(texts, c) for c in self._contents]
        if not any(pc.any(h).as_py() for h in holds):
            return None
        some = np.logical_or.reduce([h.to_numpy(zero_copy_only=False) for h in holds])
        parts, owner, added = [], [], []
        for k, (text, cut) in enumerate(zip(texts.to_pylist(), some)):
            bits = self._cut.split(text) if cut else [text]
            parts += bits[::2]
            owner += [k] * len(bits[::2])
            added += [*map(self.added.__getitem__, bits[1::2]), -1]
        return pa.array(parts, pa.large_string()), np.array(owner), np.array(added)

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        if 2 * (len(self.known) + len(words)) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        fresh = []
        for w in words:
            if w not in self.known:
                if w in self.older:
                    self.known[w] = self.older[w]
                else:
                    fresh.append(w)
        self.known.update(zip(fresh, self.encode_words(fresh)))
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's number of ids; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        cut = self._segments(texts) if self._contents else None
        parts = texts if cut is None else cut[0]
        data, at = T.raw(parts)
        start = self.word_starts(data, at[:-1][np.diff(at) > 0]) if len(data) else np.zeros(0, dtype=np.int64)
        ends = np.append(start, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        tables = self._look_up(words.dictionary.to_pylist())
        size = np.fromiter(map(len, tables), dtype=np.int64, count=len(tables)) // 4
        flat = np.frombuffer(b"".join(tables), dtype="<u4")
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = flat[spread((np.cumsum(size) - size)[index], size[index])] if len(index) else flat[:0]
        total = np.concatenate(([0], np.cumsum(size[index])))[np.searchsorted(start, at)]
        counts = np.diff(total)
        if cut is None:
            return ids, counts
        _, owner, added = cut
        some = added >= 0
        ids = np.insert(ids, total[1:][some], added[some].astype("<u4"))
        return ids, np.bincount(owner, weights=counts + some, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids, special ones included; ids without a token are left out, broken characters become U+FFFD."""
        ids = ids.astype(np.int64)
        real = (ids >= 0) & (ids < self.size)
        if not real.all():
            counts = np.diff(np.concatenate(([0], np.cumsum(real)))[np.concatenate(([0], np.cumsum(counts)))])
            ids = ids[real]
        width = self._width[ids]
        data = self._flat[spread(self._place[ids], width)].tobytes() if len(ids) else b""
        ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def codec(path: str) -> ByteBpe:
    """This worker's codec; it lives as long as the worker, over many tasks."""
    home = sys.modules.setdefault("_feedloom_codecs", types.ModuleType("_feedloom_codecs"))
    if path not in home.__dict__:
        home.__dict__[path] = ByteBpe(path)
    return home.__dict__[path]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``, repeated rows included; a null or empty text has no ids.

    ``path`` is a vocabulary file that every executor can read. One pass without a shuffle; further columns are left out,
    an empty table gives no rows, a very long text is encoded whole, by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for piece in T.pieces(batch, most=PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _lists(*bpe.encode(piece.column("text")))], names=["doc_id", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bpe.decode(ids, counts), pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit numbers, and the text decoded from them, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for piece in T.pieces(batch, most=PIECE_BYTES):
                ids, counts = bpe.encode(piece.column("text"))
                ends = (4 * np.concatenate(([0], np.cumsum(counts)))).tolist()
                raw = ids.astype("<u4").tobytes()
                columns = [piece.column("doc_id"), pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary()), pa.array(bpe.decode(ids, counts), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return text_of(docs).mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``, by ``round_trip``.

    Null, empty, repeated and very long texts as in ``encoded``; a null doc_id keeps its row.
    """
    size = F.octet_length("ids")
    return round_trip(docs, path).select(
        "doc_id",
        (size / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
