"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms are trigrams of character classes (word shapes, punctuation, symbols, line ends) and marks of repetition, so they
hold for every language. Weights are square roots of relative frequencies times idf, with document frequencies over all
documents. A truncated singular value decomposition of a bounded sample of labelled training rows gives the space; the
sample's vectors are broadcast, and every document is compared with all of them by exact blocked cosine products. A labelled
row stands for as many rows as its label was thinned by, in the space and in the votes, so scores mean the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm import text as T
from feedloom.llm.common import held_out, share_of, text_of, training_labels

#: Labelled rows of each label that are learned, on average: the bound of the broadcast vectors.
SAMPLE_PER_LABEL = 2000
DIMENSIONS, NEIGHBOURS = 48, 25

#: Character classes by byte; bytes not named are of class 11.
CLASS_COUNT = 12
_CLASS = np.full(256, 11, dtype=np.int64)
for _k, _bytes in enumerate(
    (
        b"abcdefghijklmnopqrstuvwxyz",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"0123456789",
        b" \t",
        b"\n\r",
        bytes(range(128, 256)),
        b".",
        b",;:",
        b"!?",
        b"'\"-()",
        b"#*$%&|<>",
    )
):
    _CLASS[list(_bytes)] = _k
SHAPES = CLASS_COUNT**3
MARKS = 3
#: Texts scored at once; about 200 KB of memory go with each.
_ROWS = 128
#: Bytes of text whose words and shapes a worker holds at once, apart from a single longer text; about 100 bytes of memory go with each.
PIECE_BYTES = 256 << 10


def shape_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of class trigrams that lie inside one text."""
    n, shapes = len(at) - 1, _CLASS[data]
    if len(data) < 3:
        return np.zeros((n, SHAPES), dtype=np.int64)
    doc = np.repeat(np.arange(n), np.diff(at))
    codes = (shapes[:-2] * CLASS_COUNT + shapes[1:-1]) * CLASS_COUNT + shapes[2:]
    return np.bincount((doc[:-2] * SHAPES + codes)[doc[:-2] == doc[2:]], minlength=n * SHAPES).reshape(n, SHAPES)


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of shape trigrams, and shares of repetition (word = word before, repeated 3-word runs, repeated words), per text."""
    counts, marks = np.zeros((len(texts), SHAPES), dtype=np.int64), np.zeros((len(texts), MARKS))
    done = 0
    for piece in T.pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), most=PIECE_BYTES):
        to = done + piece.num_rows
        counts[done:to], marks[done:to] = _term_counts(piece.column("text"))
        done = to
    return counts, marks


def _term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = T.raw(texts)
    n = len(at) - 1
    counts = shape_counts(data, at)
    words = T.split_words(data, at, fold=True)
    marks = np.zeros((n, MARKS))
    size = np.maximum(1, np.diff(words.first))
    if len(words.hashes) > 1:
        owner = words.doc
        same = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
        marks[:, 0] = np.bincount(owner[1:][same], minlength=n) / size
        runs, per = T.shingles(words)
        marks[:, 1] = [1 - len(d) / max(1, k) for d, k in zip(T.distinct_in(runs, per), per)]
        marks[:, 2] = [1 - len(d) / k for d, k in zip(T.distinct_in(words.hashes, np.diff(words.first)), size)]
        marks[np.diff(words.first) == 0] = 0
    return counts, marks


def weighted(counts: np.ndarray, marks: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of shapes, followed by the marks."""
    x = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))) * idf
    x /= np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    return np.hstack([x, np.sqrt(marks)]).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per term and task: the documents that hold it; term -1: all documents."""
    total = np.zeros(SHAPES + 1, dtype=np.int64)
    for batch in batches:
        for piece in T.pieces(batch, most=PIECE_BYTES, rows=_ROWS):
            total[:SHAPES] += (shape_counts(*T.raw(piece.column("text"))) > 0).sum(axis=0)
            total[SHAPES] += piece.num_rows
    terms = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(terms == SHAPES, -1, terms), pa.int64()), pa.array(total[terms])], names=["term", "docs"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The idf of every shape over all documents."""
    rows = text_of(docs).select("text").mapInArrow(T.tidy(_frequencies), "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    held = np.zeros(SHAPES)
    every = 0
    for r in rows:
        if r["term"] < 0:
            every = r["docs"]
        else:
            held[r["term"]] = r["docs"]
    return np.log((1 + every) / (1 + held)) + 0.2


@dataclass
class Neighbours:
    """What is broadcast: idf, the projection, and the labelled vectors."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    #: Training rows that each vector stands for: one over its label's share.
    stands: np.ndarray
    neighbours: int

    def project(self, counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
        x = weighted(counts, marks, self.idf) @ self.axes
        return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Votes for label 1, weighted by similarity and the rows stood for; the training rows' share of label 1 where nothing is similar."""
        prior = float(np.average(self.labels, weights=self.stands)) if len(self.labels) else 0.5
        counts, marks = term_counts(texts)
        if not len(self.labels):
            return np.full(len(counts), prior)
        like = np.maximum(0, self.project(counts, marks) @ self.vectors.T)
        k = min(self.neighbours, like.shape[1])
        near = np.argpartition(-like, k - 1, axis=1)[:, :k]
        weight = np.take_along_axis(like, near, axis=1).astype(np.float64) * self.stands[near]
        weight[counts.sum(axis=1) == 0] = 0
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(weight.sum(axis=1) > 0, votes / np.maximum(1e-12, weight.sum(axis=1)), prior).clip(0, 1)


def _sample_rows(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, rows=_ROWS):
                x = weighted(*term_counts(piece.column("text")), idf)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"]
                )

    return run


def fit(docs: DataFrame, labels: DataFrame, name: str = "quality", per_label: int = SAMPLE_PER_LABEL, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Neighbours:
    """The space and the labelled vectors: about ``per_label`` training rows of each label, chosen by a hash of doc_id."""
    idf = inverse_frequencies(docs)
    known = training_labels(labels, name)
    share = {r["label"]: min(1.0, per_label / r["count"]) for r in known.groupBy("label").count().collect()}
    wanted = F.lit(False)
    for label, part in share.items():
        wanted = wanted | ((F.col("label") == label) & (share_of("knn", "doc_id") < part))
    chosen = F.broadcast(known.where(wanted))
    rows = (
        text_of(docs).join(chosen, "doc_id").select("doc_id", "label", "text").mapInArrow(T.tidy(_sample_rows(idf)), "doc_id bigint, label int, x binary").collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    width = SHAPES + MARKS
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32).reshape(len(rows), width)
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    stands = np.array([1 / share[r["label"]] for r in rows])
    axes = _axes(x * np.sqrt(stands).astype(np.float32)[:, None], dimensions)
    model = Neighbours(idf, axes, np.zeros((0, axes.shape[1]), np.float32), y, stands, neighbours)
    z = x @ axes
    model.vectors = (z / np.maximum(1e-12, np.linalg.norm(z, axis=1, keepdims=True))).astype(np.float32)
    return model


def _axes(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors, by a randomised range finder with four power steps."""
    k = max(1, min(dimensions, *x.shape)) if len(x) else 1
    if not len(x):
        return np.zeros((x.shape[1], k), dtype=np.float32)
    y = x.T @ (x @ np.random.default_rng(7).standard_normal((x.shape[1], min(k + 12, *x.shape))).astype(np.float32))
    for _ in range(4):
        q, _ = np.linalg.qr(y)
        y = x.T @ (x @ q)
    q, _ = np.linalg.qr(y)
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v[:k].T).astype(np.float32))


def with_scores(docs: DataFrame, model: Neighbours) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Neighbours(**shared.value)
        for batch in batches:
            for piece in T.pieces(batch, rows=_ROWS):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(model.scores(piece.column("text")))], names=["doc_id", "score"])

    return text_of(docs).mapInArrow(T.tidy(run), "doc_id bigint, score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, repeated rows included.

    Only labels outside the held-out fold are learned; lang, source, doc_id and labels are no inputs of a score. Empty and
    null texts get the training rows' share of label 1; without any training label every score is 0.5. A null doc_id counts as
    held out. An empty table gives no rows.
    """
    scored = with_scores(docs, fit(docs, labels))
    predicted: Column = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns kept and texts scored where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(fit(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Neighbours(**shared.value)
        for batch in batches:
            for piece in T.pieces(batch, rows=_ROWS):
                yield piece.filter(pa.array(model.scores(piece.column("text")) >= threshold))

    return docs.mapInArrow(T.tidy(run), docs.schema)
