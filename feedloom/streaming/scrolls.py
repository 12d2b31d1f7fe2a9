"""Scroll captures processed while they arrive, with Structured Streaming.

A stream row is one card of one scroll: (target, scroll, pos, texto, usuario, timestamp, n_cards, arrived). ``n_cards`` is
the number of cards the scroll shows, so a scroll is known to be complete however its rows are split over files; a scroll without
cards is one row with ``pos`` NULL and ``n_cards`` 0. ``arrived`` is the time of the capture; it drives the watermark, by which state
is dropped and missing scrolls are given up. Rows later than the watermark are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feedloom.operators.limits import first_sightings, seen_at, value_of
from feedloom.session import run_dir

RECORD = ["texto", "usuario", "timestamp"]

SCROLL_SCHEMA = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("scroll", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("texto", T.StringType()),
        T.StructField("usuario", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("n_cards", T.LongType()),
        T.StructField("arrived", T.TimestampType()),
    ]
)

STOPPED_SCHEMA = T.StructType(
    [f for f in SCROLL_SCHEMA.fields if f.name not in ("n_cards", "arrived")] + [T.StructField("numero", T.LongType())]
)

_SIGHTING_SCHEMA = "target string, texto string, usuario string, timestamp string, scroll int, pos long"

#: How long after its own time a row may still come, the width of a distinct state's time span, and how long a missing scroll is waited for.
DELAY, SPAN, PATIENCE = "1 hour", "1 hour", "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def distinct_updates(scrolls: DataFrame, delay: str = DELAY, span: str = SPAN) -> DataFrame:
    """Streaming form of ``first_sightings``; run it in update mode.

    The state is keyed by (target, record) and the time span of the arrival, so a hot target is spread over all state
    partitions, repeats inside a batch are combined before the shuffle, and a span's state goes once the watermark has passed it: state
    is bounded by what arrives in ``delay`` and ``span``. A record that comes again in a later span is told again; the earliest sighting
    of all updates is the answer.
    """
    timed = scrolls.withWatermark("arrived", delay).where(F.col("pos").isNotNull())
    spans = timed.groupBy("target", *RECORD, F.window("arrived", span).alias("_span"))
    lowest = spans.agg(F.min(seen_at(F.col("scroll"), F.col("pos"))).alias("_at"))
    return lowest.select("target", *RECORD, F.shiftright("_at", 32).cast("int").alias("scroll"), (F.col("_at") % F.lit(1 << 32)).alias("pos"))


def run_distinct(scrolls: DataFrame, spark: SparkSession, delay: str = DELAY, span: str = SPAN) -> DataFrame:
    """Run the stream over what has arrived and return the distinct records.

    A batch emits the records it touched, in a folder named by the batch, so a repeated batch replaces its
    own output. The earliest sighting over all batches is the result.
    """
    base = run_dir(spark, "scroll-distinct")
    out = os.path.join(base, "out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    (
        distinct_updates(scrolls, delay, span)
        .writeStream.outputMode("update")
        .option("checkpointLocation", os.path.join(base, "state"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
        .awaitTermination()
    )
    spark.createDataFrame([], _SIGHTING_SCHEMA).write.parquet(os.path.join(out, "no-batch"))
    updates = spark.read.schema(_SIGHTING_SCHEMA).option("recursiveFileLookup", True).parquet(out)
    return first_sightings(updates, ["target"], RECORD)


TOLD = Row(*STOPPED_SCHEMA.names)
_LIMITS = ["at_least", "at_most", "last_scroll"]
_CARD = ["scroll", "pos", *RECORD, "n_cards", "arrived_ms"]


class StopRule(StatefulProcessor):
    """The rule of ``scroll_stop`` for one target, scroll by scroll.

    Scrolls are taken in number order, each once all its cards are there; others wait in a map by their number. Records already
    told are a list. If a scroll is missing although a later one has come, a timer runs from the later one's arrival; when the
    watermark has passed it, the missing scroll counts with the cards that are there, or as an empty one. After the stop only the
    mark of it stays.
    """

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "awaited int, found long, waits int, timer long, done boolean, least int, most int, last int")
        self.seen = handle.getListState("seen", "texto string, usuario string, timestamp string")
        cards = "array<struct<pos: long, texto: string, usuario: string, timestamp: string>>"
        self.waiting = handle.getMapState("waiting", "scroll int", f"n_cards long, arrived_ms long, cards {cards}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # a tick of the clock
            return
        state = self.progress.get()
        come: dict[int, tuple] = {}
        for _, scroll, pos, texto, usuario, timestamp, n_cards, at, *limits, _ in rows:
            state = state or (0, 0, 0, -1, False, *limits)
            if not state[4] and scroll >= state[0]:
                shown, first, cards = come.get(scroll, (n_cards, at, {}))
                if pos is not None:
                    cards[pos] = (texto, usuario, timestamp)
                come[scroll] = (shown, min(first, at), cards)
        if come:
            yield from self._go_on(key, state, come, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.progress.get()
        if state is not None and not state[4]:
            yield from self._go_on(key, state, {}, timerValues.getCurrentWatermarkInMs())

    def _go_on(self, key, state, come: dict[int, tuple], now: int | None) -> Iterator[Row]:
        """Takes every scroll that can be taken, of those that have ``come`` and those that wait; ``now``: the watermark of a timer."""
        awaited, found, waits, timer, _, least, most, last = state
        before = found
        held: dict[int, tuple] = {}
        if waits:
            held = {k[0]: (n, at, {c[0]: tuple(c)[1:] for c in cards}) for k, (n, at, cards) in self.waiting.iterator()}
        stored = set(held)
        for scroll, (n, at, cards) in come.items():
            shown, first, there = held.get(scroll, (n, at, {}))
            held[scroll] = (shown, min(first, at), {**cards, **there})
        told, known, done = [], None, False
        while held and not done:
            here = held.get(awaited)
            if (here is None or len(here[2]) < here[0]) and (now is None or self._deadline(held) > now):
                break
            if here is not None:
                if known is None:
                    known = {tuple(r) for r in self.seen.get()} if found else set()
                for pos in sorted(here[2]):
                    record = here[2][pos]
                    if record not in known:
                        known.add(record)
                        told.append(record)
                        found += 1
                        yield TOLD(key[0], awaited, pos, *record, found)
                del held[awaited]
            done = (awaited > 0 and found >= least) or found >= most or awaited + 1 >= last
            awaited += 1
        if done:
            held = {}
        for scroll in stored - set(held):
            self.waiting.removeKey((scroll,))
        for scroll in set(come) & set(held):
            n, at, cards = held[scroll]
            self.waiting.updateValue((scroll,), (n, at, [(pos, *record) for pos, record in sorted(cards.items())]))
        if told and not done:
            self.seen.appendList(told)
        elif done and before:
            self.seen.clear()
        due = self._deadline(held) if held else -1
        if due != timer:
            if timer >= 0 and now is None:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        self.progress.update((awaited, found, len(held), due, done, least, most, last))

    def _deadline(self, held: dict[int, tuple]) -> int:
        return min(at for _, at, _ in held.values()) + self.patience_ms


def stopped(scrolls: DataFrame, least: int | str, most: int | str, max_scrolls: int | str, delay: str = DELAY, patience: str = PATIENCE) -> DataFrame:
    """Streaming form of ``scroll_stop``; append mode, RocksDB state.

    Limits are numbers or names of columns that are constant for a target. Scrolls that cannot matter are dropped before the shuffle,
    so one target sends its task at most ``max_scrolls`` pages of cards. A row without a target only moves the watermark.
    """
    timed = scrolls.withWatermark("arrived", delay)
    limits = dict(zip(_LIMITS, (value_of(x).cast("int") for x in (least, most, max_scrolls))))
    live = timed.withColumns({**limits, "arrived_ms": F.unix_millis("arrived")}).where("scroll >= 0 AND scroll < last_scroll AND at_most > 0")
    cards = live.select("target", *_CARD, *_LIMITS, "arrived")
    return cards.groupBy("target").transformWithState(
        StopRule(int(pd.Timedelta(patience).total_seconds() * 1000)), STOPPED_SCHEMA, "append", "eventTime"
    )


@contextmanager
def _rocks(spark: SparkSession):
    """Keeps state in RocksDB, which state with lists, maps and timers needs, and sets the session's own choice back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_stopped(
    scrolls: DataFrame,
    spark: SparkSession,
    least: int | str,
    most: int | str,
    max_scrolls: int | str,
    delay: str = DELAY,
    patience: str = PATIENCE,
    closing: bool = True,
) -> DataFrame:
    """Run the stop rule over what has arrived and return the numbered records.

    With ``closing`` nothing more is expected: a row without a target moves the clock on, and scrolls that are still
    missing are given up. Without it they are waited for in a later run.
    """
    base = run_dir(spark, "scroll-stop")
    out, clock = os.path.join(base, "out"), os.path.join(base, "clock")
    spark.createDataFrame([], scrolls.schema).write.parquet(clock)
    ticking = scrolls.unionByName(spark.readStream.schema(scrolls.schema).parquet(clock))

    def run() -> int | None:
        """Timers that still run afterwards; None where that is not known any more."""
        query = (
            stopped(ticking, least, most, max_scrolls, delay, patience)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", os.path.join(base, "state"))
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
        counts = [p.stateOperators[0].customMetrics for p in query.recentProgress if p.stateOperators]
        told = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
        running = sum(c["numRegisteredTimers"] - c["numDeletedTimers"] - c["numExpiredTimers"] for c in counts)
        return running if len(query.recentProgress) < told else None

    with _rocks(spark):
        if run() != 0 and closing:
            # Filters are pushed below the watermark, so the row has a scroll and limits that pass them.
            end = {"arrived": F.lit("2200-01-01"), "scroll": F.lit(0), **{x: F.lit(1) for x in (least, most, max_scrolls) if isinstance(x, str)}}
            tick = spark.range(1).select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in scrolls.schema])
            tick.write.mode("append").parquet(clock)
            run()
    return spark.read.schema(STOPPED_SCHEMA).parquet(out)
