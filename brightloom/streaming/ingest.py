"""Streaming ingest: raw append and incrementally maintained aggregates, with exactly-once batches.

The reference acknowledges first and drops what fails; here a micro-batch is committed as a whole or run again. Counts
are merged additively into ``PartitionStore`` buckets (one per day), so late events correct their day whenever they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.analytics import shape
from ..session import cut
from .store import PartitionStore

COUNTS = "date string, type string, n bigint"


class DailyCounts:
    """Counts by (date, type), upserted batch by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = PartitionStore(spark, path, T.StructType.fromDDL(COUNTS), "date")

    def merge(self, raw: DataFrame, batch_id: int) -> None:
        """Add a batch's counts to the days that it touches."""
        if batch_id <= self.store.manifest()["batch"]:
            return
        delta = cut(shape(raw).groupBy("date", "type").agg(F.count(F.lit(1)).alias("n")), "delta")
        days = [r[0] for r in delta.select("date").distinct().collect()]  # days of one batch
        if days:
            both = delta.unionByName(self.store.read(days))
            self.store.replace(both.groupBy("date", "type").agg(F.sum("n").alias("n")), days, batch_id)

    def run(self, events: DataFrame, checkpoint: str) -> DataFrame:
        """Consume a stream to its end and return the counts."""
        query = events.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.store.read()


def once_per_session(events: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """First of each key on a stream; keys are remembered for the delay."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, ts: str, delay: str, length: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and type on a stream; a window is final once the watermark passed it."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def _limit(most: int, span_ms: int):
    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (-1, 0)
        kept = []
        for pdf in pdfs:
            for ident, at in sorted(zip(pdf["id"], pdf["at_ms"]), key=lambda r: (r[1], r[0])):
                if start < 0 or at >= start + span_ms:
                    start, count = at, 0  # the window is reset when it is over
                count += 1
                if count > most:
                    kept.append((key[0], ident, count))
        state.update((int(start), int(count)))
        yield pd.DataFrame(kept, columns=["sid", "id", "n"])

    return step


def rate_limited(events: DataFrame, most: int = 60, span_ms: int = 60_000) -> DataFrame:
    """Events (``sid, id, at_ms``) beyond ``most`` in the fixed window that starts with a session's first event."""
    return events.groupBy("sid").applyInPandasWithState(_limit(most, span_ms), "sid string, id bigint, n int", "start bigint, count int", "append", GroupStateTimeout.NoTimeout)


def _accumulate(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = list(state.get[0]) if state.exists else []
    known, out = set(seen), []
    for name, _, _ in sorted(((n, a, i) for pdf in pdfs for n, a, i in zip(pdf["name"], pdf["at_ms"], pdf["id"])), key=lambda r: (r[1], r[2])):
        if name not in known:
            known.add(name)
            seen.append(name)
            out.append((key[0], name, len(seen)))
    state.update((seen,))
    yield pd.DataFrame(out, columns=["sid", "name", "place"])


def session_items(events: DataFrame) -> DataFrame:
    """A session's items (``sid, name, at_ms, id``), each once, with its place in the session's sequence so far. The state
    holds a session's distinct items, as the reference's browser tab does."""
    return events.groupBy("sid").applyInPandasWithState(_accumulate, "sid string, name string, place int", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def _rage(span_ms: int, least: int):
    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        element, times = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        out = []
        for at, ident, what in sorted((a, i, e) for pdf in pdfs for a, i, e in zip(pdf["at_ms"], pdf["id"], pdf["element"])):
            if what != element:
                element, times = what, []
            times = [t for t in times if at - t < span_ms] + [at]
            if len(times) >= least:
                out.append((key[0], ident, what, len(times)))
                times = []  # fired: counting starts anew
        state.update((element, times))
        yield pd.DataFrame(out, columns=["sid", "id", "element", "clicks"])

    return step


def rage_click_alerts(clicks: DataFrame, span_ms: int = 2000, least: int = 3) -> DataFrame:
    """Alerts from a stream of clicks (``sid, id, at_ms, element``): ``least`` clicks on one element within the span. An
    alert, or a click on something else, resets the count; the state holds at most ``least`` - 1 times of a session."""
    return clicks.groupBy("sid").applyInPandasWithState(_rage(span_ms, least), "sid string, id bigint, element string, clicks int", "element string, times array<bigint>", "append", GroupStateTimeout.NoTimeout)
