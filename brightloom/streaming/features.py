"""One feature row per entity from streams of messages, with counters in checkpointed state.

One stateful query drops messages that were sent before (two 64-bit hashes of a message, spread over all partitions, so
that a hot entity is no hot key) and keeps the counters and latest times of each (entity, type) in the state store. A
batch emits the counters it changed, whole, not as differences; they are appended to a log of changes under the batch's
number, and the latest entry of a counter holds. So a batch reads and writes what it changed and never the table; every
``COMPACT`` batches the log is folded into one part. A batch that is run again after a failure finds its number
committed, or writes the same folder once more, and changes nothing.

Message columns: ``entity`` (null: the message belongs to none), ``type``, ``at_ms``, ``dwell_ms`` (null unless the
message reports one), ``is_dwell`` and ``m1``, ``m2`` (the hashes). Entities that start with ``path:`` are page paths
whose item was not named in the message; ``features`` resolves them against the names seen so far, at reading time, so
the order of arrival doesn't matter.

Defined cases: null type counts as ``unknown``; a null time adds to the count but not to the last time; a dwell that
is null, zero, negative or above ``max_dwell_ms`` adds to ``dwell_rejected`` and not to the totals; an empty stream
gives no rows. Within a batch equal messages are one message, whichever copy comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import publish_json, read_json

ROW = "entity string, type string, n bigint, last_ms bigint, dwell_n bigint, dwell_ms bigint, dwell_rejected bigint, batch bigint"
SUMS = ("n", "dwell_n", "dwell_ms", "dwell_rejected")
DAY_MS = 86_400_000
COMPACT = 24


def message_hashes(*cols: str) -> list[Column]:
    """Two independent hashes of a message; null differs from the empty string."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0001null")) for c in cols]
    return [F.xxhash64(*parts).alias("m1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("m2")]


class EntityFeatures:
    """Upserts feature rows from a stream of messages."""

    def __init__(self, spark: SparkSession, path: str, max_dwell_ms: int = DAY_MS, compact: int = COMPACT):
        self.spark, self.path, self.max_dwell_ms, self.compact = spark, path.rstrip("/"), max_dwell_ms, compact

    def counters(self, messages: DataFrame) -> DataFrame:
        """The stateful part: counters of each (entity, type) over the distinct messages so far."""
        good = F.coalesce(F.col("dwell_ms").between(1, self.max_dwell_ms), F.lit(False))
        dwell = F.col("is_dwell")
        return (
            messages.dropDuplicates(["m1", "m2"])
            .where(F.col("entity").isNotNull())
            .groupBy("entity", F.coalesce("type", F.lit("unknown")).alias("type"))
            .agg(
                F.count_if(~dwell).alias("n"),
                F.max(F.when(~dwell, F.col("at_ms"))).alias("last_ms"),
                F.count_if(dwell & good).alias("dwell_n"),
                F.coalesce(F.sum(F.when(dwell & good, F.col("dwell_ms"))), F.lit(0)).alias("dwell_ms"),
                F.count_if(dwell & ~good).alias("dwell_rejected"),
            )
        )

    def _manifest(self) -> dict:
        return read_json(self.spark, f"{self.path}/rows/manifest.json") or {"batch": -1, "parts": []}

    def commit(self, changed: DataFrame, batch_id: int) -> None:
        """Append a batch's changed counters; a batch that was committed before is ignored."""
        manifest = self._manifest()
        if batch_id <= manifest["batch"]:
            return
        folder = f"batch={batch_id}"
        changed.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/rows/{folder}")
        parts = [*manifest["parts"], folder]
        if len(parts) > self.compact:
            self._latest(parts).write.mode("overwrite").parquet(f"{self.path}/rows/folded={batch_id}")
            parts = [f"folded={batch_id}"]
        publish_json(self.spark, f"{self.path}/rows/manifest.json", {"batch": batch_id, "parts": parts})

    def _latest(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], ROW)
        log = self.spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/rows/{p}" for p in parts])
        values = ("batch", "n", "last_ms", "dwell_n", "dwell_ms", "dwell_rejected")
        return log.groupBy("entity", "type").agg(F.max(F.struct(*values)).alias("v")).select("entity", "type", *[f"v.{c}" for c in values[1:]], "v.batch")

    def stream(self, messages: DataFrame, checkpoint: str):
        """Consume a streaming DataFrame of messages until its sources are exhausted; returns the ended query. The state lies in
        RocksDB; a query takes its settings from the session when it starts, so the session's own is restored at once."""
        conf, key = self.spark.conf, "spark.sql.streaming.stateStore.providerClass"
        was = conf.get(key, None)
        conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            query = self.counters(messages).writeStream.outputMode("update").foreachBatch(self.commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        finally:
            conf.set(key, was) if was else conf.unset(key)
        query.awaitTermination()
        return query

    def features(self, slug_of) -> DataFrame:
        """Full rows by item. ``slug_of`` gives the page slug of a name column; of several names with one slug the smallest takes the page's messages."""
        rows = self._latest(self._manifest()["parts"])
        is_path = F.col("entity").startswith("path:")
        pages = rows.where(~is_path).select("entity").distinct().groupBy(slug_of(F.col("entity")).alias("slug")).agg(F.min("entity").alias("item"))
        joined = rows.withColumn("slug", F.when(is_path, F.substring("entity", 6, 1 << 30))).join(pages, "slug", "left")
        item = F.when(is_path, F.coalesce("item", F.regexp_replace("slug", "[-_]", " "))).otherwise(F.col("entity"))
        by_type = joined.groupBy(item.alias("item"), "type").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("last_ms").alias("last_ms"))
        return by_type.groupBy("item").agg(
            F.sum("n").alias("n_events"),
            F.max("last_ms").alias("last_ms"),
            *[F.sum(c).alias(c) for c in SUMS[1:]],
            F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("type", "n", "last_ms")))).alias("types"),
        )
