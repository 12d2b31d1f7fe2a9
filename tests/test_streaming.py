"""Streams give what the batch operators give, whatever way the rows are split over files and batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.catalog import queries
from feedloom.operators.limits import first_sightings, scroll_stop
from feedloom.sources.scrolls import read_scroll_stream
from feedloom.streaming.scrolls import RECORD, SCROLL_SCHEMA, distinct_updates, run_distinct, run_stopped


def scroll_rows(seed):
    rng = random.Random(seed)
    rows = []
    for t in range(25):
        for s in range(rng.randint(1, 6)):
            at = datetime(2024, 1, 1, 12, s, t)
            cards = [(rng.choice("abcdefg"), rng.choice(["u", None]), None) for _ in range(rng.choice([0, 2, 5]))]
            rows += [(f"t{t}", s, p, *c, len(cards), at) for p, c in enumerate(cards, 1)]
            if not cards:
                rows.append((f"t{t}", s, None, None, None, None, 0, at))
    return rows


@pytest.fixture(params=["in order", "shuffled"])
def landed(request, spark, tmp_path):
    rows = scroll_rows(31)
    if request.param == "shuffled":
        random.Random(1).shuffle(rows)
    else:
        rows.sort(key=lambda r: r[1])
    folder = str(tmp_path / "in")
    for i in range(3):
        part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        spark.createDataFrame(part, SCROLL_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return rows, folder


def as_set(df, *columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_distinct(spark, landed):
    rows, folder = landed
    batch = spark.createDataFrame(rows, SCROLL_SCHEMA).where(F.col("pos").isNotNull())
    columns = ["target", *RECORD, "scroll", "pos"]
    got = run_distinct(read_scroll_stream(spark, folder, SCROLL_SCHEMA), spark)
    assert as_set(got, *columns) == as_set(first_sightings(batch, ["target"], RECORD), *columns)


@pytest.mark.parametrize("least, most, last", [(4, 9, 5), (0, 3, 10), (100, 100, 3), (2, 0, 5)])
def test_stop_rule(spark, landed, least, most, last):
    rows, folder = landed
    batch = spark.createDataFrame(rows, SCROLL_SCHEMA).where(F.col("pos").isNotNull())
    columns = ["target", *RECORD, "scroll", "pos", "numero"]
    want = scroll_stop(batch, ["target"], RECORD, least, most, last)
    got = run_stopped(read_scroll_stream(spark, folder, SCROLL_SCHEMA), spark, least, most, last)
    assert as_set(got, *columns) == as_set(want, *columns)


def test_nothing_has_arrived(spark, tmp_path):
    folder = tmp_path / "none"
    folder.mkdir()
    stream = read_scroll_stream(spark, str(folder), SCROLL_SCHEMA)
    assert run_distinct(stream, spark).count() == 0
    assert run_stopped(stream, spark, 1, 2, 3).count() == 0


HOLES = "target string, scroll int, pos long, texto string, usuario string, timestamp string, n_cards long, arrived timestamp, a int, b int, c int"


def rows_with_holes():
    """Scrolls that never come, scrolls that lack a card, and limits of each target's own."""
    rng = random.Random(7)
    rows = []
    for t in range(30):
        limits = (rng.choice([0, 2, 6]), rng.choice([0, 3, 9, 50]), rng.choice([1, 4, 8]))
        for s in range(8):
            if rng.random() < 0.3:
                continue
            cards = [(rng.choice("abcdefghij"), None, None) for _ in range(rng.choice([1, 3]))]
            at = datetime(2024, 1, 1, 12) + timedelta(minutes=s, seconds=t)
            missing = rng.random() < 0.2
            rows += [(f"t{t}", s, p, *card, len(cards) + missing, at, *limits) for p, card in enumerate(cards, 1)]
    return rows


@pytest.mark.parametrize("order", [1, 2])
def test_holes_and_limits_of_each_target(spark, tmp_path, order):
    rows = rows_with_holes()
    random.Random(order).shuffle(rows)
    folder = str(tmp_path / "in")
    for part in (rows[0::3], rows[1::3], rows[2::3]):
        spark.createDataFrame(part, HOLES).coalesce(1).write.mode("append").parquet(folder)
    batch = scroll_stop(spark.createDataFrame(rows, HOLES), ["target"], RECORD, "a", "b", "c")
    stream = read_scroll_stream(spark, folder, batch_schema(spark, folder))
    got = run_stopped(stream, spark, "a", "b", "c")
    columns = ["target", *RECORD, "scroll", "pos", "numero"]
    assert as_set(got, *columns) == as_set(batch, *columns)
    waiting = run_stopped(stream, spark, "a", "b", "c", closing=False)
    assert as_set(waiting, *columns) < as_set(batch, *columns)


def batch_schema(spark, folder):
    return spark.read.parquet(folder).schema


def test_a_timer_passes_a_hole_while_the_stream_runs(spark, tmp_path):
    """Scroll 1 is missing; once the clock is ten minutes on, scroll 2 is told although nothing closes the stream."""
    folder, noon = str(tmp_path / "in"), datetime(2024, 1, 1, 12)
    for part in (
        [("t", 0, 1, "a", None, None, 1, noon), ("t", 2, 1, "b", None, None, 1, noon + timedelta(minutes=2))],
        [("u", 0, 1, "x", None, None, 1, noon + timedelta(minutes=20))],
        [("u", 1, 1, "y", None, None, 1, noon + timedelta(minutes=21))],
    ):
        spark.createDataFrame(part, SCROLL_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = read_scroll_stream(spark, folder, SCROLL_SCHEMA)
    got = run_stopped(stream, spark, 5, 9, 9, delay="1 minute", patience="10 minutes", closing=False)
    assert as_set(got, "target", "scroll", "texto", "numero") == {("t", 0, "a", 1), ("t", 2, "b", 2), ("u", 0, "x", 1), ("u", 1, "y", 2)}


def test_state_of_distinct_records_expires(spark, tmp_path):
    """Twenty batches of new records, an hour apart: the state never holds more than a few hours' records."""
    folder, noon = str(tmp_path / "in"), datetime(2024, 1, 1)
    rows = [(f"t{k % 3}", k // 3, 1, f"post {k if k % 5 else 0}", None, None, 1, noon + timedelta(minutes=6 * k)) for k in range(200)]
    for k in range(0, 200, 10):
        spark.createDataFrame(rows[k : k + 10], SCROLL_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = read_scroll_stream(spark, folder, SCROLL_SCHEMA)
    held = []
    query = (
        distinct_updates(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).foreachBatch(lambda batch, i: batch.write.format("noop").mode("overwrite").save()).start()
    )
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(held) >= 20 and max(held) <= 40
    batch = first_sightings(spark.createDataFrame(rows, SCROLL_SCHEMA), ["target"], RECORD)
    columns = ["target", *RECORD, "scroll", "pos"]
    assert as_set(run_distinct(stream, spark), *columns) == as_set(batch, *columns)


@pytest.mark.parametrize("n_files, batches", [(6, 3), (40, 8)])
def test_registered_streams_take_few_batches(spark, tmp_path, n_files, batches):
    """However many files have come, the state is gone through a bounded number of times."""
    folder, rows = str(tmp_path / "in"), scroll_rows(5)
    spark.createDataFrame(rows, SCROLL_SCHEMA).repartition(n_files).write.parquet(folder)
    stream = queries._scroll_stream(spark, folder, SCROLL_SCHEMA)
    seen = []
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda batch, i: seen.append(batch.count())).start()
    query.awaitTermination()
    assert len(seen) == batches and sum(seen) == len(rows)
