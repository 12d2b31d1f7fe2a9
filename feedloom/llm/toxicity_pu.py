"""Toxicity: linear classifiers learned from confirmed toxic examples and unlabelled text with a non-negative risk estimate.

Features are hashed byte 4-grams and 6-grams of the text with A-Z lower-cased and blanks made alike, so that stems of any
language count. Texts are grouped by their byte pairs, which sets languages and scripts apart without being told them, and the
grams most enriched in confirmed examples beyond what the class prior explains in unlabelled text are chosen in every group and
over all: a language with few examples is compared with its own texts. Unlabelled frequencies are of all rows outside the held-out
fold. On the grams' presence in a bounded sample, linear models are trained with the logistic loss and the estimator
``prior * risk+(P) + max(0, risk-(U) - prior * risk-(P))``: where the second part falls below zero, its own gradient is
stepped up again instead, so the model cannot overfit the unlabelled toxic rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm import text as T
from feedloom.llm.common import held_out, share_of, stored, text_of, training_labels

#: Confirmed toxic and unlabelled rows that are learned from, on average, and the grams kept.
POSITIVES, UNLABELLED, GRAMS = 4000, 16000, 1024
#: Groups of texts, rows they are found from, and cells of a text's profile of byte pairs.
GROUPS, PROFILES, CELLS = 8, 2000, 512
#: Grams counted over all rows for each one chosen, and rows in which they are looked for.
CANDIDATES, LIKELY = 4, 16000
#: Standard errors by which a gram must be more frequent in confirmed examples.
LEAST_Z = 1.5
BITS, SIZES = 20, (4, 6)
MEMBERS, EPOCHS, BATCHES, DECAY = 5, 20, 8, 1e-4
#: Bytes of text whose grams a worker holds at once, apart from a single longer text; about 100 bytes of memory go with each.
PIECE_BYTES = 256 << 10

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of every gram inside a text, for each size; the sizes have buckets of their own."""
    folded = _FOLD[data]
    total, down = T.running(folded)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for number, size in enumerate(SIZES):
        count = len(data) - size + 1
        if count < 1:
            continue
        h = (total[size:] - total[:count]) * down[:count]
        bucket = ((h * T.U(0x9E3779B97F4A7C15)) >> T.U(64 - BITS)).astype(np.int64) + (number << BITS)
        inside = doc[:count] == doc[size - 1 :]
        yield bucket[inside], doc[:count][inside]


def profiles(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row per text: square roots of hashed byte-pair frequencies, of length one."""
    n = len(at) - 1
    folded = _FOLD[data].astype(np.int64)
    cell = ((folded[:-1] * 256 + folded[1:]) * 0x9E3779B1 >> 15) % CELLS
    doc = np.repeat(np.arange(n), np.diff(at))
    inside = doc[:-1] == doc[1:]
    counts = np.bincount(doc[:-1][inside] * CELLS + cell[inside], minlength=n * CELLS).reshape(n, CELLS)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)


def find_groups(rows: np.ndarray, most: int = GROUPS) -> np.ndarray:
    """Centres of up to ``most`` groups of profiles by spherical k-means from centres far apart; the rows' order decides nothing but ties."""
    rows = rows[np.lexsort(rows.T[:8])]
    if not len(rows):
        return np.zeros((1, CELLS), dtype=np.float32)
    centres = [rows.mean(axis=0)]
    near = rows @ centres[0]
    while len(centres) < most:
        # Of the tenth of rows that lie farthest, the middle one: single odd texts make no group.
        far = np.argsort(near, kind="stable")[: max(1, len(rows) // 10)]
        centres.append(rows[far[len(far) // 2]])
        near = np.maximum(near, rows @ centres[-1])
    centres = np.array(centres)
    for _ in range(20):
        own = (rows @ centres.T).argmax(axis=1)
        centres = np.array([rows[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
        centres /= np.maximum(1e-9, np.linalg.norm(centres, axis=1, keepdims=True))
    return centres.astype(np.float32)


WIDTH = len(SIZES) << BITS


def _frequencies(centres: np.ndarray, wanted: np.ndarray | None = None):
    """One row per key and task: the rows that hold it. A key is group * WIDTH + bucket, the group after the last one is of all texts;
    key -1 - group counts the group's rows. ``wanted``: the keys that are counted, a bit each, packed; only these then have a counter."""
    groups = len(centres)
    most = (groups + 1) * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            counted = np.unpackbits(wanted, count=most).view(bool)
            names = np.flatnonzero(counted).astype(np.int32)
        held = np.zeros(most if wanted is None else len(names), dtype=np.int32)
        rows = np.zeros(groups + 1, dtype=np.int64)
        for batch in batches:
            for piece in T.pieces(batch, most=PIECE_BYTES, rows=512):
                data, at = T.raw(piece.column("text"))
                own = (profiles(data, at) @ centres.T).argmax(axis=1)
                rows += np.append(np.bincount(own, minlength=groups), len(own))
                for bucket, doc in grams(data, at):
                    for key in (own[doc] * WIDTH + bucket, groups * WIDTH + bucket):
                        d = doc
                        if wanted is not None:
                            hit = counted[key]
                            key, d = key[hit], doc[hit]
                        keys, count = np.unique(np.unique(d * most + key) % most, return_counts=True)
                        held[keys if wanted is None else np.searchsorted(names, keys.astype(np.int32))] += count.astype(np.int32)
        at = np.flatnonzero(held)
        some, held = at if wanted is None else names[at].astype(np.int64), held[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1 - np.arange(groups + 1))), pa.array(np.append(held, rows))], names=["key", "rows"])

    return run


def _held(texts: DataFrame, name: str, centres: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, ``name``): the rows of ``texts`` that hold each key, summed over tasks."""
    return texts.select("text").mapInArrow(_frequencies(centres, wanted), "key bigint, rows bigint").groupBy("key").agg(F.sum("rows").alias(name))


def _enriched(counts: DataFrame, groups: int, prior: float, most: int) -> list[tuple[int, int]]:
    """(key, rank) of each group's ``most`` most enriched grams, by counts (key, p, u); ranks of a group start at 0."""
    rows = counts.where("key < 0").collect()
    total = {-1 - r["key"]: (r["p"] or 0, r["u"] or 0) for r in rows}
    group = F.floor(F.col("key") / WIDTH)
    of = F.create_map(*[F.lit(x) for g in range(groups + 1) for x in (g, max(1, total.get(g, (0, 0))[0]))])
    ou = F.create_map(*[F.lit(x) for g in range(groups + 1) for x in (g, max(1, total.get(g, (0, 0))[1]))])
    n_p, n_u = of[group.cast("int")], ou[group.cast("int")]
    in_p, in_u = F.col("p") / n_p, F.col("u") / n_u
    rest = F.greatest(F.lit(0.0), (in_u - prior * in_p) / (1 - prior)) if prior < 1 else F.lit(0.0)
    excess = (in_p - rest) / F.sqrt(rest * (1 - rest) / n_u + in_p * (1 - in_p) / n_p + 1.0 / (n_p * n_p))
    ranked = counts.where("key >= 0").select("key", group.alias("g"), excess.alias("z")).where(f"z > {LEAST_Z}")
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("z"), "key"))
    top = ranked.withColumn("rank", rank - 1).where(F.col("rank") < most)
    return sorted((r["key"], r["rank"]) for r in top.select("key", "rank").collect())


@dataclass
class Toxicity:
    """The chosen grams by bucket (-1: none), and the weights and biases of all members."""

    feature: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    prior: float

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature) pairs, each once."""
        pairs = []
        for bucket, doc in grams(*T.raw(texts)):
            f = self.feature[bucket]
            hit = f >= 0
            pairs.append(doc[hit] * (1 << 32) + f[hit])
        every = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
        return every >> 32, every & ((1 << 32) - 1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The members' mean probability; the prior where nothing was learned."""
        if not self.weights.shape[1]:
            return np.full(len(texts), self.prior)
        doc, f = self.present(texts)
        each = [1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=w[f], minlength=len(texts)) + b, -60, 60))) for w, b in zip(self.weights, self.bias)]
        return np.mean(each, axis=0)


def train(doc: np.ndarray, f: np.ndarray, confirmed: np.ndarray, unlabelled: np.ndarray, width: int, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier: Adam over shuffled parts of both samples, with the non-negative correction."""
    rng = np.random.default_rng(seed)
    first = np.searchsorted(doc, np.arange(len(confirmed) + 1))
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    w[width] = -1.0
    step = 0
    rows_p, rows_u = np.flatnonzero(confirmed), np.flatnonzero(unlabelled)
    for _ in range(EPOCHS):
        for part_p, part_u in zip(np.array_split(rng.permutation(rows_p), BATCHES), np.array_split(rng.permutation(rows_u), BATCHES)):
            if not len(part_p) or not len(part_u):
                continue
            rows = np.concatenate([part_p, part_u])
            n = first[rows + 1] - first[rows]
            local = np.repeat(np.arange(len(rows)), n)
            items = f[np.arange(n.sum()) + np.repeat(first[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n)]
            g = np.bincount(local, weights=w[items], minlength=len(rows)) + w[width]
            s = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
            k = len(part_p)
            negative = np.logaddexp(0, g)  # the loss of being called negative
            left = negative[k:].mean() - prior * negative[:k].mean()
            weight = np.empty(len(rows))
            if left >= 0:
                weight[:k] = -prior / k  # of both losses of a confirmed row together, whatever its score: none is ever given up
                weight[k:] = s[k:] / len(part_u)
            else:
                weight[:k] = prior * s[:k] / k
                weight[k:] = -s[k:] / len(part_u)
            grad = np.append(np.bincount(items, weights=weight[local], minlength=width), weight.sum()) + DECAY * w
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:width], float(w[width])


def _profiles_of(texts: DataFrame) -> np.ndarray:
    """The profiles of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, most=PIECE_BYTES, rows=512):
                rows = profiles(*T.raw(piece.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["profile"])

    found = texts.select("text").mapInArrow(run, "profile binary").collect()
    return np.array([np.frombuffer(r["profile"], dtype=np.float32) for r in found]).reshape(-1, CELLS)


def fit(docs: DataFrame, labels: DataFrame, name: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, chosen: int = GRAMS) -> Toxicity:
    """Classifiers from about ``positives`` confirmed rows and ``unlabelled`` rows outside the held-out fold, by a hash of doc_id.

    The grams' frequencies in unlabelled text come from all rows outside that fold. Labels of 0 are used for the class prior only, the share of label 1 among all training labels.
    """
    known = training_labels(labels, name)
    r = known.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    confirmed, prior = r["k"] or 0, (r["k"] or 0) / max(1, r["n"])
    none = Toxicity(np.full(WIDTH, -1, dtype=np.int32), np.zeros((0, 0)), np.zeros(0), prior)
    if not confirmed:
        return none
    every = docs.where(~held_out(F.col("doc_id"))).count()
    sure = known.where((F.col("label") == 1) & (share_of("pu-p", "doc_id") < min(1.0, positives / confirmed))).select("doc_id", F.lit(True).alias("confirmed"))
    free = ~held_out(F.col("doc_id")) & (share_of("pu-u", "doc_id") < min(1.0, unlabelled / max(1, every)))
    likely = ~held_out(F.col("doc_id")) & (share_of("pu-u", "doc_id") < min(1.0, LIKELY / max(1, every)))
    sample = stored(
        text_of(docs)
        .join(F.broadcast(sure), "doc_id", "left")
        .select("doc_id", "text", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), free.alias("unlabelled"), likely.alias("likely"))
        .where("confirmed OR unlabelled OR likely"),
        "pu-sample",
    )
    free_rows = sample.where("likely")
    few = free_rows.where(share_of("pu-groups", "doc_id") < min(1.0, PROFILES / max(1, free_rows.count())))
    centres = find_groups(_profiles_of(few))
    groups = len(centres)

    def mask(keys: np.ndarray) -> np.ndarray:
        out = np.zeros((groups + 1) * WIDTH, dtype=bool)
        out[keys] = True
        return np.packbits(out)

    def with_free(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
        counts = in_sure.join(_held(texts, "u", centres, wanted), "key", "left")
        return stored(counts.select("key", "p", F.coalesce("u", F.lit(0)).alias("u")), "pu-grams")

    # Grams of three confirmed rows of a group are counted in the sample; the best of them over all rows outside the held-out fold.
    in_sure = stored(_held(sample.where("confirmed"), "p", centres).where("key < 0 OR p >= 3"), "pu-confirmed")
    tried = mask(in_sure.where("key >= 0").select("key").toArrow().column("key").to_numpy())
    best = _enriched(with_free(free_rows, tried), groups, prior, CANDIDATES * chosen // (groups + 1))
    keys = np.array([k for k, _ in best], dtype=np.int64)
    counts = with_free(text_of(docs).where(~held_out(F.col("doc_id"))), mask(keys))
    wanted = docs.sparkSession.createDataFrame([(int(k),) for k in [*keys, *(-1 - np.arange(groups + 1))]], "key bigint")
    ranked = _enriched(counts.join(wanted, "key", "left_semi"), groups, prior, chosen)
    # Round-robin over the groups, each gram once.
    buckets = list(dict.fromkeys(k % WIDTH for k, _ in sorted(ranked, key=lambda x: (x[1], x[0]))))[:chosen]
    model = Toxicity(none.feature.copy(), np.zeros((0, 0)), np.zeros(0), prior)
    model.feature[buckets] = np.arange(len(buckets))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model).copy())

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxicity(**shared.value)
        for batch in batches:
            for piece in T.pieces(batch, most=PIECE_BYTES, rows=512):
                doc, f = model.present(piece.column("text"))
                at = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                items = pa.array([f[a:b].astype(np.int32).tobytes() for a, b in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("confirmed"), piece.column("unlabelled"), items], names=["doc_id", "confirmed", "unlabelled", "items"])

    rows = sample.where("confirmed OR unlabelled").mapInArrow(present, "doc_id bigint, confirmed boolean, unlabelled boolean, items binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["items"]))
    lists = [np.frombuffer(r["items"], dtype=np.int32) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    f = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, dtype=np.int64)
    kinds = [np.array([r[c] for r in rows], dtype=bool) for c in ("confirmed", "unlabelled")]
    members = [train(doc, f, *kinds, len(buckets), prior, seed) for seed in range(MEMBERS)]
    model.weights, model.bias = np.array([w for w, _ in members]), np.array([b for _, b in members])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, repeated rows included.

    Whole texts are scored; lang, source, doc_id and labels are no inputs of a score. Null and empty texts get the score of
    a text without any chosen gram. Without confirmed examples every score is the prior, 0. A null doc_id counts as held
    out. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(fit(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxicity(**shared.value)
        for batch in batches:
            for piece in T.pieces(batch, most=PIECE_BYTES, rows=512):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(model.scores(piece.column("text")))], names=["doc_id", "score"])

    scored = text_of(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
