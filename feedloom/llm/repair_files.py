"""Token ids in compressed files: Re-Pair grammars per shard, with expansion lengths for random access.

Documents are range-partitioned by doc_id and encoded; a shard is a run of consecutive documents of about SHARD_TOKENS
ids. Within a shard, frequent pairs of neighbouring ids are replaced by new symbols, round after round, until no pair has
LEAST_USES or the symbols are used up. A file is Parquet; each row is a shard: its grammar (two symbols per rule), the length
each rule expands to, the compressed symbols, and per document its id, its ids' count and the place of its first symbol,
so that one document is decoded without the others. Pairs never reach over a document's end.

Encoding uses the tokenizers library. Its BPE works on words apart, so a worker has each distinct blank-separated word encoded
once and keeps the words met last, with their ids, in Arrow arrays; tests hold the ids equal to those of whole texts.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm import text as T
from feedloom.llm.common import scratch_path, text_of

#: Ids of one shard, apart from a single longer document; least uses of a replaced pair, and of pairs in the first round.
SHARD_TOKENS, LEAST_USES, FIRST_USES = 1 << 19, 32, 64
#: Symbols are written as 16 bits; ids stay below this and rules take the rest.
SYMBOLS = 1 << 16
#: Words a worker remembers (about 40 bytes each) and their bytes, and bytes of text it takes at once (about 30 bytes of memory each).
CACHE_WORDS, CACHE_BYTES, PIECE_BYTES = 200_000, 32 << 20, 2 << 20
END = 1

FILE_SCHEMA = "part int, shard int, tokens bigint, doc_ids array<bigint>, counts binary, firsts binary, rules binary, lengths binary, symbols binary"


#: Words that the vocabulary's own splitting leaves whole: letters that lower-casing and composing leave as they are.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: ASCII marks between such a letter and a blank or the end; the apostrophe can begin a piece with letters, <, | and > a special token.
_MARKED = "([A-Za-z\u00df-\u00f6\u00f8-\u00ff])([!-&(-/:;=?@\\[-`{}~]+)(\\s|$)"
# How the vocabulary's file prepares and cuts texts.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHAIN = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _byte_letters() -> dict[int, str]:
    """The byte-level letters: visible Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {**{b: chr(b) for b in seen}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class WordEncoder:
    """Ids of blank-separated words as little-endian 16-bit bytes, each word encoded by the library once until it is forgotten.

    Plain words go to the library's BPE model many at a time, told apart by its word-end symbols; others go through its whole
    chain. Marks between a letter and a blank are a piece of their own, so they are split off first. All this holds for a
    vocabulary of lower-cased words with word ends whose file cuts texts by PIECES; another one is refused, never encoded wrongly.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        chain = [file["normalizer"], *file["pre_tokenizer"].get("pretokenizers", [file["pre_tokenizer"]])] if file.get("normalizer") and file.get("pre_tokenizer") else []
        if chain != CHAIN or file["model"].get("end_of_word_suffix") != "</w>" or len(file["model"]["vocab"]) >= SYMBOLS:
            raise ValueError(f"no vocabulary of lower-cased words with word ends: {path}")
        self.library = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for symbol, i in vocabulary.items() if symbol.endswith("</w>")]] = True
        self.letters = _byte_letters() | {32: " "}  # blanks stay between words
        #: Words remembered (a blank stands for the end of a text), those before and after the last time some were forgotten; their ids; the piece that had them last.
        self.older, self.known = pa.array([" "], pa.large_string()), pa.array([], pa.large_string())
        self.ids = _binaries(np.array([END], dtype="<u2"), np.array([1]))
        self.met = np.zeros(1, dtype=np.int32)
        self.number = 0

    def _plain_words(self, lines: list[str], count: int) -> pa.Array:
        """The ids of ``count`` words that the model takes as they are, given in lines."""
        ids = [np.array(self.plain.encode_batch_fast([x], add_special_tokens=False)[0].ids, dtype="<u2") for x in lines]
        ids = np.concatenate(ids) if ids else np.zeros(0, dtype="<u2")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != count:
            raise ValueError(f"{count} words have {len(ends)} ends")
        return _binaries(ids, ends)

    def of(self, fresh: pa.Array) -> pa.Array:
        """The ids of distinct words, each encoded by the library."""
        ascii_ = pc.match_substring_regex(fresh, "^[A-Za-z]+$").to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~ascii_)
        others = fresh.take(pa.array(other)).to_pylist()
        low = [w.lower() for w in others]
        plain = np.fromiter(map(bool, map(_PLAIN.fullmatch, low)), dtype=bool, count=len(low))
        latin = [w for w, p in zip(low, plain) if p]
        lines = [" ".join(latin[at : at + 1000]).encode().decode("latin-1").translate(self.letters) for at in range(0, len(latin), 1000)]
        rest = self.library.encode_batch_fast([w for w, p in zip(others, plain) if not p], add_special_tokens=False)
        found = [
            self._plain_words(_lines(pc.ascii_lower(fresh.filter(pa.array(ascii_)))), len(fresh) - len(other)),
            self._plain_words(lines, len(latin)),
            pa.array([np.array(x.ids, dtype="<u2").tobytes() for x in rest], pa.large_binary()),
        ]
        place = np.empty(len(fresh), dtype=np.int64)
        place[np.concatenate((np.flatnonzero(ascii_), other[plain], other[~plain]))] = np.arange(len(fresh))
        return pa.concat_arrays(found).take(pa.array(place))

    def _remember(self, words: pa.Array, ids: pa.Array, met: np.ndarray) -> None:
        """Keeps ``words``; beyond CACHE_WORDS the half met last, beyond CACHE_BYTES the mark of the end alone."""
        old = len(self.older)
        if words.nbytes + ids.nbytes > CACHE_BYTES:
            words, ids, met, old = words.take(pa.array([0])), ids.take(pa.array([0])), met[:1], 1
        elif len(words) > CACHE_WORDS:
            met[0] = self.number + 1
            kept = pa.array(np.sort(np.argsort(-met, kind="stable")[: max(1, CACHE_WORDS // 2)]))
            words, ids, met, old = words.take(kept), ids.take(kept), met[kept.to_numpy()], len(kept)
        self.older, self.known, self.ids, self.met = words.slice(0, old), words.slice(old), ids, met

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an END after each text, and each text's count with the END."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        apart = pc.replace_substring_regex(texts, _MARKED, r"\1 \2\3")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told by their case
            apart = pc.ascii_lower(apart)  # of a new array: pyarrow lowers slices wrongly
        split = pc.ascii_split_whitespace(apart)
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        per = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(per):
            return np.zeros(0, dtype="<u2"), per
        # The words remembered come first, so that they keep their numbers; number 0 is the mark of the end.
        before = len(self.older) + len(self.known)
        words = split.flatten().dictionary_encode()
        numbered = pa.concat_arrays([self.older, self.known, words.dictionary]).dictionary_encode()
        known, number = numbered.dictionary, numbered.indices.to_numpy()[before:]
        found = pa.concat_arrays([self.ids, self.of(known.slice(before))])
        self.number += 1
        met = np.concatenate((self.met, np.zeros(len(known) - before, dtype=np.int32)))
        met[number] = self.number
        ends = np.cumsum(per)
        index = np.insert(number[words.indices.to_numpy()], ends, 0)
        size = (np.diff(np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1)) // 2).astype(np.int32)[index]
        flat = found.take(pa.array(index))
        self._remember(known, found, met)
        ids = np.frombuffer(flat.buffers()[2], dtype="<u2", count=int(size.sum(dtype=np.int64)))
        return ids, np.add.reduceat(size, np.concatenate(([0], (ends + np.arange(1, len(per) + 1))[:-1])), dtype=np.int64)


def _lines(words: pa.Array) -> list[str]:
    """The words in lines of a thousand, with blanks between."""
    at = np.append(np.arange(0, len(words), 1000), len(words)) if len(words) else np.zeros(1, dtype=np.int64)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words), pa.scalar(" ", words.type)).to_pylist()


def _binaries(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids up to each end as bytes."""
    at = np.concatenate(([0], 2 * ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(ids)])


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; it lives as long as the worker, over many tasks."""
    home = sys.modules.setdefault("_feedloom_encoders", types.ModuleType("_feedloom_encoders"))
    if path not in home.__dict__:
        home.__dict__[path] = WordEncoder(path)
    return home.__dict__[path]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[k], start[k] + 1, ... of ``size[k]`` each, one run after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def compress(ids: np.ndarray, counts: np.ndarray, least: int = LEAST_USES, first: int = FIRST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols, firsts): Re-Pair in rounds; each replaces all pairs used often enough, most used first.

    What is often enough starts at ``first`` uses and is halved, down to ``least``, whenever a round finds no such pair; the rounds end when
    no pair has ``least`` uses or all symbols of 16 bits are taken. Where two occurrences overlap, the more used pair goes first. Ids are below ``base``, the greatest id plus one; symbol
    base + r stands for rule r. Files keep ``base`` before the lengths.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    seq = ids.astype(np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(counts) - 1] = True
    rules: list[np.ndarray] = []
    made = 0
    need = max(first, least)
    while need >= least:
        room = SYMBOLS - base - made
        if room <= 0 or len(seq) < 2:
            break
        # Pairs that are rare by a hash alone are left out; the others are counted as they are.
        hashed = ((seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(15)).astype(np.intp)
        often = np.bincount(hashed, minlength=1 << 17) >= need
        maybe = np.flatnonzero(often[hashed] & ~last[:-1])
        width = np.uint64(base + made)
        kinds, index, uses = np.unique(seq[maybe] * width + seq[maybe + 1], return_inverse=True, return_counts=True)
        order = np.argsort(-uses, kind="stable")[: min(room, int((uses >= need).sum()))]
        if not len(order):
            need = need // 2 if need == least or need // 2 >= least else least
            continue
        rank = np.full(len(kinds), -1, dtype=np.int64)
        rank[order] = np.arange(len(order))
        rank = rank[index]
        at, rank = maybe[rank >= 0], rank[rank >= 0]
        taken = _no_overlaps(at, rank)
        at, rank = at[taken], rank[taken]
        rules.append(np.stack([kinds[order] // width, kinds[order] % width], axis=1).astype(np.uint16))
        seq[at] = base + made + rank
        gone = np.ones(len(seq), dtype=bool)
        gone[at + 1] = False
        last[at] = last[at + 1]
        seq, last = seq[gone], last[gone]
        made += len(order)
    grammar = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint16)
    lengths = rule_lengths(grammar, base)
    firsts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(counts) else np.zeros(0, dtype=np.int64)
    return grammar, lengths, seq.astype(np.uint16), firsts


def _no_overlaps(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A mask of occurrences (positions ``at``, sorted) of which no two are neighbours: in each run of neighbours, local best ranks first, then every other one left."""
    left = np.concatenate(([False], at[1:] == at[:-1] + 1))
    right = np.concatenate((left[1:], [False]))
    big = np.int64(1 << 40)
    best = (rank < np.where(left, np.concatenate(([big], rank[:-1])), big)) & (rank <= np.where(right, np.concatenate((rank[1:], [big])), big))
    free = ~best & ~(left & np.concatenate(([False], best[:-1]))) & ~(right & np.concatenate((best[1:], [False])))
    # The free ones stand in runs apart from the best; every other one of a run is taken.
    begins = free & ~(left & np.concatenate(([False], free[:-1])))
    number = np.arange(len(at))
    start = np.maximum.accumulate(np.where(begins, number, 0))
    return best | (free & ((number - start) % 2 == 0))


def _by_need(grammar: np.ndarray, base: int) -> Iterator[np.ndarray]:
    """The rules in groups, each made of ids and rules of earlier groups."""
    known = np.zeros(base + len(grammar), dtype=bool)
    known[:base] = True
    left = np.arange(len(grammar))
    while len(left):
        ready = known[grammar[left]].all(axis=1)
        yield left[ready]
        known[base + left[ready]] = True
        left = left[~ready]


def rule_lengths(grammar: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for."""
    size = np.ones(base + len(grammar), dtype=np.uint32)
    for rules in _by_need(grammar, base):
        size[base + rules] = size[grammar[rules]].sum(axis=1)
    return size[base:]


def expansions(grammar: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all symbols in one array, with each symbol's place and length."""
    size = np.concatenate((np.ones(base, dtype=np.int64), rule_lengths(grammar, base).astype(np.int64)))
    place = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), dtype=np.uint16)
    flat[:base] = np.arange(base)
    for rules in _by_need(grammar, base):
        a, b = grammar[rules].astype(np.int64).T
        at = place[base + rules]
        flat[spread(at, size[a])] = flat[spread(place[a], size[a])]
        flat[spread(at + size[a], size[b])] = flat[spread(place[b], size[b])]
    return flat, place, size


def expand(symbols: np.ndarray, grammar: np.ndarray, base: int) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    flat, place, size = expansions(grammar, base)
    return flat[spread(place[symbols], size[symbols])]


def base_of(lengths: np.ndarray) -> int:
    return int(lengths[0])


def decode_document(shard: dict, k: int) -> np.ndarray:
    """The ids of document ``k`` of a shard row, from its own symbols alone."""
    firsts = np.frombuffer(shard["firsts"], dtype=np.uint32)
    symbols = np.frombuffer(shard["symbols"], dtype=np.uint16)
    lengths = np.frombuffer(shard["lengths"], dtype=np.uint32)
    part = symbols[firsts[k] : firsts[k + 1] if k + 1 < len(firsts) else len(symbols)]
    return expand(part, np.frombuffer(shard["rules"], dtype=np.uint16).reshape(-1, 2), base_of(lengths))


def shard_row(part: int, number: int, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    grammar, lengths, symbols, firsts = compress(ids, counts)
    base = int(ids.max()) + 1 if len(ids) else 0
    parts = (counts.astype(np.uint32), firsts.astype(np.uint32), grammar, np.concatenate(([base], lengths)).astype(np.uint32), symbols)
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in parts)],
        names=["part", "shard", "tokens", "doc_ids", "counts", "firsts", "rules", "lengths", "symbols"],
    )


def write_files(docs: DataFrame, path: str, tokenizer: str, partitions: int | None = None) -> None:
    """Encodes ``docs`` and writes the shards to ``path``, in ascending doc_id order (null first, then by a hash of the text).

    Null and empty texts have the END id alone. Part numbers follow the order of doc_ids, shard numbers that within a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for piece in T.pieces(batch, most=PIECE_BYTES):
                ids, counts = library.encode(piece.column("text"))
                names, to = piece.column("doc_id").to_pylist(), np.cumsum(counts)
                at = 0
                while at < len(counts):
                    # Documents up to the one that fills the shard.
                    done = int(to[at - 1]) if at else 0
                    end = min(len(counts), int(np.searchsorted(to, done + SHARD_TOKENS - size)) + 1)
                    held.append((ids[done : to[end - 1]], counts[at:end]))
                    doc_ids += names[at:end]
                    size += int(to[end - 1]) - done
                    at = end
                    if size >= SHARD_TOKENS:
                        yield shard_row(part, number, doc_ids, *(np.concatenate(x) for x in zip(*held)))
                        held, doc_ids, number, size = [], [], number + 1, 0
        if held:
            yield shard_row(part, number, doc_ids, *(np.concatenate(x) for x in zip(*held)))

    rows, by = text_of(docs), ("doc_id", F.xxhash64("text"))  # the sample for the ranges then holds no texts
    ordered = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    ordered.sortWithinPartitions(*by).mapInArrow(T.tidy(run), FILE_SCHEMA).write.parquet(path)


def read_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files at ``path``; start: the ids of all documents before.

    Starts are sums over shards per part, and over parts; documents are never ordered in one task.
    """
    shards = spark.read.schema(FILE_SCHEMA).parquet(path)
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "shard", "tokens").withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("outer", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = sizes.join(parts, "part").select("part", "shard", (F.col("outer") + F.col("inner")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                counts = np.frombuffer(row["counts"].as_buffer(), dtype=np.uint32).astype(np.int64)
                lengths = np.frombuffer(row["lengths"].as_buffer(), dtype=np.uint32)
                grammar = np.frombuffer(row["rules"].as_buffer(), dtype=np.uint16).reshape(-1, 2)
                ids = expand(np.frombuffer(row["symbols"].as_buffer(), dtype=np.uint16), grammar, base_of(lengths)).astype("<u4")
                ends = np.cumsum(counts)
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - counts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"].as_py()] * len(counts), pa.int32()), pa.array([row["shard"].as_py()] * len(counts), pa.int32()), row["doc_ids"].values, pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = shards.mapInArrow(T.tidy(run), "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` (to a new folder in the shared one, unless ``path`` is given) and reads them back, as ``read_files``.

    An empty table gives no rows; repeated rows are encoded each; extra columns are left out.
    """
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_files(docs, path, tokenizer)
    return read_files(docs.sparkSession, path)
