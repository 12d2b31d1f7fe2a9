import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from feedloom.llm import decontaminate, mix_sources, quality_knn
from feedloom.llm.common import stored
from feedloom.llm.registry import table, tokenizer_path
from tests.llm.test_jaccard_join import classes


def test_each_stage_on_what_the_last_one_kept(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept, inputs = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept[name] = stored(stage(spark, inputs, sf_dir), name)
        assert kept[name].columns == docs.columns
        inputs = kept[name]
    ids = {name: Counter(r[0] for r in df.select("doc_id").collect()) for name, df in kept.items()}

    scores = quality_knn.score_quality(docs, table(spark, sf_dir, "labels"))
    assert set(ids["quality"]) == {r[0] for r in scores.where("predicted = 1").select("doc_id").collect()}

    texts = [(r[0], r[1]) for r in kept["quality"].select("doc_id", "text").collect()]
    assert set(ids["near_duplicates"]) == {c for _, c in classes(texts).values()}

    bad = decontaminate.contamination(kept["near_duplicates"], table(spark, sf_dir, "benchmark")).where("contaminated")
    assert set(ids["benchmark_free"]) == set(ids["near_duplicates"]) - {r["doc_id"] for r in bad.collect()}
    assert 0 < bad.count() < 0.2 * len(ids["near_duplicates"])

    times = mix_sources.mix(kept["benchmark_free"]).where("times > 0")
    assert ids["mixture"] == Counter({r["doc_id"]: r["times"] for r in times.collect()})

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    got = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, kept["mixture"], sf_dir).collect()), key=lambda r: r[1])
    start = 0
    for r, g in zip(kept["mixture"].orderBy("doc_id").collect(), got, strict=True):
        tokens = np.array(library.encode(r["text"], add_special_tokens=False).ids + [1], dtype="<u4")
        assert g == (r["doc_id"], start, len(tokens), zlib.crc32(tokens.tobytes()))
        start += len(tokens)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op")}) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_free", "mixture", "token_files"]


def test_stages_on_an_empty_table(spark, sf_dir):
    none = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stored(stage(spark, none, sf_dir), name).count() == 0
