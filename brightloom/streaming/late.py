"""Per-period aggregates by event time that late records correct until a cut-off.

Each batch is appended to a retained log that is partitioned by (late, day of the event). The days that the batch
touched are then recomputed entirely from the retained log, and their aggregates are replaced in one atomic commit
(``PartitionStore``). A manifest beside the log tells which batches wrote which days, so a batch lists its own folder only,
and an operator that is started again knows the log's columns. A record that arrives ``cutoff_hours`` or more after the end of its hour is kept in the log's
``late`` part, which never enters an aggregate: that part is the ledger of rejected records.

Defined cases: a null arrival can't be judged and counts as in time; a null event time has no period, so the row is
kept nowhere; a batch that is delivered twice is ignored the second time; an empty batch commits nothing. Columns of
the input other than those named are ignored, whatever they are called. Re-sent messages are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fs_of
from .store import PartitionStore, publish_json, read_json

HOUR_MS = 3_600_000


class LateEventAggregator:
    """Hourly aggregates of an event log with late correction.

    ``measures`` maps names to aggregate expressions over the retained columns ``id``, ``event_ms``, ``arrived``
    and ``keep`` (further columns to retain).
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", event_ms_col: str = "timestamp", arrived_col: str = "created_at", keep: tuple[str, ...] = (), measures: dict[str, Column] | None = None, cutoff_hours: int = 24):
        self.spark, self.path = spark, path.rstrip("/")
        self.cols = (id_col, event_ms_col, arrived_col)
        self.keep, self.cutoff_hours = tuple(keep), cutoff_hours
        self.measures = measures or {"n": F.count(F.lit(1))}

    def _shape(self, df: DataFrame) -> DataFrame:
        ident, event, arrived = self.cols
        hour = (F.floor(F.col("event_ms") / HOUR_MS) * HOUR_MS).cast("long")
        closes = F.timestamp_millis(F.col("hour_ms") + F.lit(HOUR_MS * (1 + self.cutoff_hours)))
        return (
            df.select(F.col(ident).alias("id"), F.col(event).cast("long").alias("event_ms"), F.col(arrived).cast("timestamp").alias("arrived"), *[F.col(c) for c in self.keep])
            .where(F.col("event_ms").isNotNull())
            .withColumn("hour_ms", hour)
            .withColumn("late", F.coalesce(F.col("arrived") >= closes, F.lit(False)))
            .withColumn("day", F.date_format(F.timestamp_millis("hour_ms"), "yyyy-MM-dd"))
        )

    def _log(self) -> dict:
        """``batch`` (the last one written), ``days`` (numbers of the batches by day), ``late`` (those with late records), ``schema``."""
        return read_json(self.spark, f"{self.path}/log/manifest.json") or {"batch": -1, "days": {}, "late": [], "schema": None}

    def _schema(self, log: dict) -> T.StructType:
        if log["schema"]:
            return T.StructType.fromJson(log["schema"])
        return T.StructType.fromDDL(", ".join(["id bigint", "event_ms bigint", "arrived timestamp", *[f"`{c}` string" for c in self.keep], "hour_ms bigint"]))

    def _append(self, rows: DataFrame, batch_id: int) -> tuple[dict, list[str]]:
        """Write a batch to the log; the log's manifest and the days that the batch touched."""
        folder, log = f"{self.path}/log/batch={batch_id}", self._log()
        rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("late", "day").parquet(folder)
        days: dict[bool, list[str]] = {}
        for late in (False, True):
            fs, place = fs_of(self.spark, f"{folder}/late={str(late).lower()}")
            days[late] = sorted(d.getPath().getName()[4:] for d in fs.listStatus(place)) if fs.exists(place) else []
        for day in days[False]:
            log["days"][day] = sorted({*log["days"].get(day, []), batch_id})
        if days[True]:
            log["late"] = sorted({*log["late"], batch_id})
        log |= {"batch": batch_id, "schema": rows.drop("late", "day").schema.jsonValue()}
        publish_json(self.spark, f"{self.path}/log/manifest.json", log)
        return log, days[False]

    def _store(self, log: dict) -> PartitionStore:
        sample = self.spark.createDataFrame([], self._schema(log))
        schema = self._aggregate(sample.withColumn("day", F.lit(""))).schema
        return PartitionStore(self.spark, f"{self.path}/hours", schema, "day")

    def _aggregate(self, log: DataFrame) -> DataFrame:
        return log.groupBy("day", "hour_ms").agg(*[m.alias(k) for k, m in self.measures.items()])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Append a batch, recompute the days it touched, and replace them until the cut-off."""
        rows = self._shape(batch)
        if batch_id <= PartitionStore(self.spark, f"{self.path}/hours", T.StructType([T.StructField("day", T.StringType())]), "day").manifest()["batch"]:
            return
        log, touched = self._append(rows, batch_id)
        if not touched:
            return
        paths = [f"{self.path}/log/batch={b}/late=false/day={d}" for d in touched for b in log["days"][d]]
        kept = self.spark.read.schema(self._schema(log)).parquet(*paths).withColumn("day", F.date_format(F.timestamp_millis("hour_ms"), "yyyy-MM-dd"))
        self._store(log).replace(self._aggregate(kept), touched, batch_id)

    def hours(self) -> DataFrame:
        """The aggregates as they stand: ``hour_ms`` and the measures."""
        return self._store(self._log()).read().drop("day")

    def ledger(self) -> DataFrame:
        """The records that came too late to be counted."""
        log = self._log()
        if not log["late"]:
            return self.spark.createDataFrame([], self._schema(log))
        return self.spark.read.schema(self._schema(log)).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/log/batch={b}/late=true" for b in log["late"]])

    def stream(self, events: DataFrame, checkpoint: str):
        """Run over a streaming DataFrame until its source is exhausted; returns the ended query."""
        query = events.writeStream.foreachBatch(lambda df, n: self.process(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def replay(self, events: DataFrame, slices: int = 4) -> LateEventAggregator:
        """Feed a bounded table in ``slices`` batches of equal arrival time, in order of arrival."""
        arrived = F.col(self.cols[2]).cast("timestamp")
        low, high = events.agg(F.min(arrived), F.max(arrived)).first()
        if low is None:
            self.process(events, 0)
            return self
        step = (high - low) / slices
        for k in range(slices):
            inside = (arrived >= F.lit(low + k * step)) if k else F.lit(True)
            inside = inside & ((arrived < F.lit(low + (k + 1) * step)) if k < slices - 1 else F.lit(True))
            inside = inside & arrived.isNotNull() if k < slices - 1 else inside | arrived.isNull()
            self.process(events.where(inside), k)
        return self
