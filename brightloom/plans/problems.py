"""Queries p3_ and p4_: the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug_a
from ..session import work_dir
from ..streaming.features import EntityFeatures, message_hashes
from ..streaming.late import LateEventAggregator


def _stream(spark: SparkSession, sf_dir: str, name: str, files: int) -> DataFrame:
    """A table as a stream of ``files`` files a batch; a pattern may be one file, a plain path must be a folder."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[t]")


def _late(spark: SparkSession, sf_dir: str) -> LateEventAggregator:
    measures = {
        "n": F.count(F.lit(1)),
        "n_after_hour": F.count_if(F.col("arrived") >= F.timestamp_millis(F.col("hour_ms") + F.lit(3_600_000))),
    }
    operator = LateEventAggregator(spark, work_dir(spark, "late"), measures=measures)
    operator.stream(_stream(spark, sf_dir, "analytics_events", 16), f"{operator.path}/checkpoint")
    return operator


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's ledger of records that came too late."""
    return _late(spark, sf_dir).ledger().select("id").distinct()


def p4_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per UTC hour as corrected, and how many of them came after the hour had ended."""
    hours = _late(spark, sf_dir).hours()
    return hours.select(F.date_format(F.timestamp_millis("hour_ms"), "yyyy-MM-dd HH:00").alias("hour"), "n", "n_after_hour")


# ---- p3
EVENT_COLS = ("type", "session_id", "path", "timestamp", "country", "data")
DWELL_COLS = ("session_id", "name", "section", "dwell_ms", "viewable_seconds", "reading_ratio", "timestamp")


def item_key(name):
    """The reference's item identity; a blank name is none."""
    return F.nullif(F.lower(F.trim(name)), F.lit(""))


def event_messages(events: DataFrame) -> DataFrame:
    """Messages of ``analytics_events``: the item is in the payload where the type has one, else in the path."""
    kind = F.regexp_replace(F.lower(F.trim("type")), "[-\\s]+", "_")
    payload = F.when(kind == "search_click", F.get_json_object("data", "$.resultId")).otherwise(F.get_json_object("data", "$.name"))
    path = F.element_at(F.split(F.btrim(F.regexp_replace(F.lower("path"), "[?#].*$", ""), F.lit("/")), "/"), -1)
    has_item = F.size(F.split(F.btrim(F.regexp_replace("path", "[?#].*$", ""), F.lit("/")), "/")) >= 2
    page = F.when(has_item, F.concat(F.lit("path:"), slug_a(path)))
    return events.select(
        F.coalesce(item_key(payload), page).alias("entity"), kind.alias("type"), F.col("timestamp").alias("at_ms"), F.lit(None).cast("long").alias("dwell_ms"), F.lit(False).alias("is_dwell"), *message_hashes(*EVENT_COLS)
    )


def dwell_messages(dwell: DataFrame) -> DataFrame:
    """Messages of ``content_dwell``."""
    return dwell.select(item_key(F.col("name")).alias("entity"), F.lit("dwell total").alias("type"), F.col("timestamp").alias("at_ms"), "dwell_ms", F.lit(True).alias("is_dwell"), *message_hashes(*DWELL_COLS))


def item_features(spark: SparkSession, sf_dir: str, files_per_batch: int = 16) -> DataFrame:
    """Run the stream over both tables and return the feature rows."""
    streams = {t: _stream(spark, sf_dir, t, files_per_batch) for t in ("analytics_events", "content_dwell")}
    operator = EntityFeatures(spark, work_dir(spark, "features"))
    operator.stream(event_messages(streams["analytics_events"]).unionByName(dwell_messages(streams["content_dwell"])), f"{operator.path}/checkpoint")
    return operator.features(slug_a)


def p3_item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item; the types as text ``type=count@last;...`` in order of type, so that engines can be compared."""
    one = F.transform("types", lambda t: F.concat_ws("", t["type"], F.lit("="), t["n"].cast("string"), F.lit("@"), F.coalesce(t["last_ms"].cast("string"), F.lit(""))))
    return item_features(spark, sf_dir).select("item", "n_events", F.coalesce(F.col("last_ms").cast("string"), F.lit("")).alias("last_ms"), "dwell_n", "dwell_ms", "dwell_rejected", F.size("types").alias("n_types"), F.concat_ws(";", one).alias("types"))


_HOUR = "timestamp // 3600000 * 3600000"

QUERIES = {"p3_item_features": p3_item_features, "p4_found": p4_found, "p4_hourly_counts": p4_hourly_counts}

SQL = {
    "p4_found": "SELECT DISTINCT id FROM analytics_events WHERE created_at >= make_timestamp(((timestamp // 3600000 + 1) * 3600000 + 86400000) * 1000)",
    "p4_hourly_counts": f"""
        WITH e AS (SELECT {_HOUR} AS hour_ms, created_at FROM analytics_events WHERE timestamp IS NOT NULL),
        k AS (SELECT * FROM e WHERE created_at IS NULL OR created_at < make_timestamp((hour_ms + 25 * 3600000) * 1000))
        SELECT strftime(make_timestamp(hour_ms * 1000), '%Y-%m-%d %H:00') AS hour, count(*) AS n,
               count(*) FILTER (WHERE created_at >= make_timestamp((hour_ms + 3600000) * 1000)) AS n_after_hour
        FROM k GROUP BY hour_ms""",
    "p3_item_features": r"""
        WITH ev AS (SELECT DISTINCT type, session_id, path, timestamp, country, data FROM analytics_events),
        m AS (SELECT regexp_replace(lower(trim(type)), '[-\s]+', '_', 'g') AS type, timestamp AS at_ms, data,
                     rtrim(ltrim(regexp_replace(lower(path), '[?#].*$', ''), '/'), '/') AS page FROM ev),
        e AS (SELECT type, at_ms,
                     nullif(lower(trim(CASE WHEN json_valid(data) THEN CASE WHEN type = 'search_click' THEN data->>'$.resultId' ELSE data->>'$.name' END END, ' ')), '') AS item,
                     CASE WHEN contains(page, '/') THEN left(regexp_replace(regexp_replace(split_part(page, '/', -1), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 100) END AS slug FROM m),
        dw AS (SELECT nullif(lower(trim(name, ' ')), '') AS item, dwell_ms FROM (SELECT DISTINCT * FROM content_dwell)),
        names AS (SELECT DISTINCT item FROM (SELECT item FROM e UNION ALL SELECT item FROM dw) WHERE item IS NOT NULL),
        pages AS (SELECT left(regexp_replace(regexp_replace(item, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 100) AS slug, min(item) AS named FROM names GROUP BY 1),
        r AS (SELECT coalesce(e.item, p.named, replace(replace(e.slug, '-', ' '), '_', ' ')) AS item, coalesce(type, 'unknown') AS type, at_ms FROM e LEFT JOIN pages p ON e.slug = p.slug),
        t AS (SELECT item, type, count(*) AS n, max(at_ms) AS last_ms FROM r WHERE item IS NOT NULL GROUP BY 1, 2),
        a AS (SELECT item, sum(n) AS n_events, max(last_ms) AS last_ms, count(*) AS n_types,
                     string_agg(type || '=' || n || '@' || coalesce(CAST(last_ms AS VARCHAR), ''), ';' ORDER BY type) AS types FROM t GROUP BY 1),
        d AS (SELECT item, count(*) FILTER (WHERE dwell_ms BETWEEN 1 AND 86400000) AS dwell_n, coalesce(sum(dwell_ms) FILTER (WHERE dwell_ms BETWEEN 1 AND 86400000), 0) AS dwell_ms,
                     count(*) FILTER (WHERE dwell_ms IS NULL OR dwell_ms NOT BETWEEN 1 AND 86400000) AS dwell_rejected FROM dw WHERE item IS NOT NULL GROUP BY 1)
        SELECT item, CAST(coalesce(n_events, 0) AS BIGINT) AS n_events, coalesce(CAST(last_ms AS VARCHAR), '') AS last_ms, CAST(coalesce(dwell_n, 0) AS BIGINT) AS dwell_n, CAST(coalesce(dwell_ms, 0) AS BIGINT) AS dwell_ms,
               CAST(coalesce(dwell_rejected, 0) AS BIGINT) AS dwell_rejected, CAST(coalesce(n_types, 0) AS INTEGER) AS n_types, coalesce(types, '') AS types
        FROM a FULL JOIN d USING (item)""",
}
