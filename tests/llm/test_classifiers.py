import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import quality_knn, toxicity_pu
from feedloom.llm import text as T

EDGE = [(10_001, None), (10_002, ""), (10_003, " \n"), (None, "no id here"), (10_004, "long words " * 20_000), (7, "again"), (7, "again")]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    syllables = "ba do ke li mo nu ra se ti vo".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))

    docs, labels = [], []
    for k in range(1200):
        words = [word() for _ in range(rng.randrange(20, 90))]
        bad, toxic = k % 4 == 0, k % 5 == 1
        if toxic:
            words[rng.randrange(len(words))] = "grumph" + word()
            words[rng.randrange(len(words))] = rng.choice(["ZOTZ", "zotz,"])
        text = " ".join(words).capitalize() + "."
        if bad:
            text = text.upper().replace(" ", "!! ") if k % 8 else text.replace(" ", "### ")
        docs.append((k, text, "src", 0.5))
        if k % 3 != 2:
            labels.append((k, int(not bad), int(toxic)))
    schema = "doc_id bigint, text string, label string, score double"
    docs = spark.createDataFrame(docs + [(i, t, "x", 0.1) for i, t in EDGE], schema)
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int"), schema


@pytest.mark.parametrize("run, name", [(quality_knn.score_quality, "quality"), (toxicity_pu.score_toxicity, "toxic")])
def test_held_out_accuracy(spark, labelled, run, name):
    docs, labels, _ = labelled
    out = run(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r[name] for r in labels.where("doc_id IS NOT NULL").collect() if r[name] is not None}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97
    # Held-out labels are never learned: turned round, they change nothing.
    turned = labels.withColumn(name, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(name)).otherwise(F.col(name)))
    assert sorted(map(repr, run(docs, turned).collect())) == sorted(map(repr, rows))


@pytest.mark.parametrize("run, score", [(quality_knn.score_quality, 0.5), (toxicity_pu.score_toxicity, 0.0)])
def test_without_labels_or_rows(spark, labelled, run, score):
    docs, labels, _ = labelled
    some = docs.where("doc_id < 5 OR doc_id > 10000 OR doc_id IS NULL")
    assert {r["score"] for r in run(some, labels.limit(0)).collect()} == {score}
    assert run(docs.limit(0), labels).count() == 0


def test_kept_rows_keep_their_columns(spark, labelled):
    docs, labels, _ = labelled
    kept = quality_knn.keep_good(docs, labels)
    assert kept.schema == docs.schema
    good = {r["doc_id"] for r in quality_knn.score_quality(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good


def test_thinning_one_label_keeps_scores(spark):
    rng = random.Random(3)
    words = "ba do ke li mo nu ra se".split()
    # Texts of one kind whose label is chance: five in six are good, whatever the sample holds of each label.
    docs = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(1500)] + [(9000, "")]
    labels = [(k, int(rng.random() < 5 / 6)) for k in range(1500)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    known = quality_knn.training_labels(labels, "quality")
    means, empty = [], []
    for per_label in (2000, 200):
        model = quality_knn.fit(docs, labels, per_label=per_label)
        scores = {r["doc_id"]: r["score"] for r in quality_knn.with_scores(docs, model).collect()}
        empty.append(scores.pop(9000))
        means.append(sum(scores.values()) / len(scores))
    truth = known.agg(F.avg("label")).first()[0]
    assert all(abs(x - truth) < 0.04 for x in means + empty)


def test_grams_are_chosen_from_all_rows(spark, labelled):
    docs, labels, _ = labelled
    few, all_ = (toxicity_pu.fit(docs, labels, unlabelled=n).feature for n in (40, 16_000))
    assert (few >= 0).sum() > 10 and (few == all_).all()


def test_toxicity_in_two_languages(spark):
    """A language with few examples is found like one with many, though neither is told apart by a column."""
    rng = random.Random(11)
    alphabets = {"many": ["ba", "do", "ke", "li", "mo", "nu"], "few": ["schä", "tza", "pfu", "grö", "wie", "xü"]}
    bad = {"many": ["idiox", "trasko"], "few": ["zzorn", "quälex"]}

    def word(language):
        return "".join(rng.choice(alphabets[language]) for _ in range(rng.randrange(1, 4)))

    rows, labels = [], []
    for k in range(3000):
        language = "few" if k % 6 == 0 else "many"
        words = [word(language) for _ in range(60)]
        toxic = rng.random() < 0.2
        for _ in range(12 * toxic):
            words[rng.randrange(60)] = rng.choice(bad[language])
        rows.append((k, " ".join(words), language))
        if k % 2 == 0 or language == "few":
            labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scored = {r["doc_id"]: r for r in toxicity_pu.score_toxicity(docs, marks).collect()}
    for language in ("many", "few"):
        held = [(t, scored[k]["predicted"]) for k, t in labels if scored[k]["held_out"] and rows[k][2] == language]
        found = [p for t, p in held if t]
        assert len(found) > 2 and sum(found) / len(found) >= 0.8, (language, sum(found), len(found))
        assert sum(p for t, p in held if not t) <= 0.05 * len(held)


def test_risk_is_the_corrected_one():
    """A step goes down the gradient of prior * (loss of P as positive - loss of P as negative) + loss of U as negative, by brute force."""
    rng = np.random.default_rng(1)
    present = rng.random((40, 6)) < 0.4
    doc, f = np.nonzero(present)
    confirmed, unlabelled = np.arange(40) < 12, np.arange(40) >= 12
    prior = 0.2

    def risk(w, b):
        g = present @ w + b
        plus, minus = np.logaddexp(0, -g), np.logaddexp(0, g)
        rest = minus[unlabelled].mean() - prior * minus[confirmed].mean()
        return prior * plus[confirmed].mean() + max(0.0, rest)

    w, b = toxicity_pu.train(doc, f, confirmed, unlabelled, 6, prior, 0)
    start = risk(np.zeros(6), -1.0)
    assert risk(w, b) < start
    best = min(risk(w + d, b) for d in rng.normal(0, 0.05, (200, 6)))
    assert risk(w, b) <= best + 0.05


def test_groups_follow_the_script():
    texts = [("alpha beta gamma delta " * 5 if k % 5 else "альфа бета гамма дельта " * 5) + str(k) for k in range(100)]
    rows = toxicity_pu.profiles(*T.raw(pa.array(texts)))
    own = (rows @ toxicity_pu.find_groups(rows, 2).T).argmax(axis=1)
    assert len({own[k] for k in range(100) if k % 5}) == 1 and len({own[k] for k in range(0, 100, 5)}) == 1 and own[0] != own[1]
    assert toxicity_pu.find_groups(np.zeros((0, toxicity_pu.CELLS), dtype=np.float32)).shape == (1, toxicity_pu.CELLS)


@pytest.mark.parametrize("chosen", [False, True])
def test_counting_grams_holds_little(chosen):
    """Two megabytes of text in one batch: keys and rows are right, beside the counters a worker holds a few pieces' grams only."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 4000, dtype=np.uint8)).decode() for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    centres = rng.random((8, toxicity_pu.CELLS)).astype(np.float32)
    data, at = T.raw(batch.column(0).slice(0, 1))
    some = np.concatenate([8 * toxicity_pu.WIDTH + bucket for bucket, _ in toxicity_pu.grams(data, at)])
    wanted = np.zeros(9 * toxicity_pu.WIDTH, dtype=bool)
    wanted[some] = True
    tracemalloc.start()
    out, = toxicity_pu._frequencies(centres, np.packbits(wanted) if chosen else None)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < (60 << 20 if chosen else 150 << 20)
    rows = dict(zip(*(c.to_pylist() for c in out.columns)))
    held = np.zeros(9 * toxicity_pu.WIDTH, dtype=int)
    for k in range(500):
        held[np.unique(np.concatenate([8 * toxicity_pu.WIDTH + b for b, _ in toxicity_pu.grams(*T.raw(batch.column(0).slice(k, 1)))]))] += 1
    every = {k: n for k, n in rows.items() if k >= 8 * toxicity_pu.WIDTH}
    assert every == {int(k): int(held[k]) for k in (np.unique(some) if chosen else np.flatnonzero(held))}
    assert rows[-9] == 500 and sum(rows[-1 - g] for g in range(8)) == 500


def test_scoring_quality_holds_little():
    """A thousand texts of 3 KB against 4,000 vectors: a worker holds the counts and likenesses of some of the texts at once."""
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefgh ABC 0123.,\n", dtype=np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([bytes(rng.choice(letters, 3000)).decode() for _ in range(1000)])], names=["text"])
    vectors = rng.standard_normal((4000, 48)).astype(np.float32)
    axes = rng.standard_normal((quality_knn.SHAPES + quality_knn.MARKS, 48)).astype(np.float32)
    model = quality_knn.Neighbours(np.ones(quality_knn.SHAPES), axes, vectors, np.arange(4000) % 2.0, np.ones(4000), 25)
    tracemalloc.start()
    got = [model.scores(piece.column("text")) for piece in T.pieces(batch, rows=quality_knn._ROWS)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.concatenate(got)) == 1000 and peak < 36 << 20


def test_tidy_gives_the_same_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array([k, k + 1])], names=["x"]) for k in range(3)]
    assert [b.to_pydict() for b in T.tidy(iter)(iter(batches))] == [b.to_pydict() for b in batches]
