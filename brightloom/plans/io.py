"""Queries of readers, writers and streaming ingest: each writes into the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..session import table, work_dir
from ..sources import files as S
from ..streaming import ingest as I
from .analytics import _DAILY, EV
from .catalog import _NU


def _archive(spark, sf_dir):
    return table(spark, sf_dir, "datasets_archive")


def _stream(spark, sf_dir, name, files_per_batch=8):
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[t]")


def json_catalog(spark, sf_dir):
    """Catalog files of two types, one of them missing, read as one table."""
    path = work_dir(spark, "json")
    a = _archive(spark, sf_dir).select("name", "description", F.array_join("tags", ", ").alias("tags"))
    rows = a.select(F.to_json(F.array(F.struct("name", "description", "tags"))).alias("value"))
    rows.write.text(f"{path}/datasets")
    schema = "name string, description string, tags string"
    lines = spark.read.schema(schema).json(f"{path}/datasets").withColumn("type", F.lit("dataset"))
    missing = S.read_catalog(spark, {"paper": f"{path}/papers"}, {"paper": schema})
    return lines.unionByName(missing, allowMissingColumns=True).select("name", "description", "tags", "type")


def csv_roundtrip(spark, sf_dir):
    path = work_dir(spark, "csv")
    columns = ["sheet_id", "name", "current_company", "location", "is_senior", "verified"]
    S.write_csv(table(spark, sf_dir, "collection_sheet").select(*columns), path)
    return S.read_csv(spark, path, "sheet_id string, name string, current_company string, location string, is_senior string, verified string", ("is_senior", "verified"))


def jsonl_results(spark, sf_dir):
    """Requests written as JSON lines, their results joined back by id; misses keep the old value."""
    from ..operators.catalog import apply_results

    a = _archive(spark, sf_dir).select(F.col("record_id").cast("string").alias("custom_id"), "difficulty")
    path = work_dir(spark, "jsonl")
    S.write_requests(a.where("custom_id LIKE '%3'"), path, F.col("custom_id"), F.struct(F.lit("advanced").alias("difficulty")))
    return apply_results(a, S.read_results(spark, path, "struct<difficulty:string>"), "custom_id", ["difficulty"]).select("custom_id", "difficulty")


def markdown_tables(spark, sf_dir):
    """Tables made of nations and regions in Markdown, scanned again."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    body = nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.format_string("| [%s](https://nations.example/%d) | **%s** |", "n_name", "n_nationkey", "n_name"))).alias("rows"))
    lines = body.select(F.col("r_regionkey").alias("doc"), F.posexplode(F.concat(F.array(F.concat(F.lit("## "), "r_name"), F.lit("| Name | Note |"), F.lit("|---|---|")), "rows")).alias("pos", "line"))
    return S.read_markdown_tables(lines).select("section", "name", "url", F.element_at("cells", 2).alias("note"))


def vectors_binary(spark, sf_dir):
    path = work_dir(spark, "vectors")
    S.write_float_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), path)
    back = S.read_float_vectors(spark, path)
    return back.select("id", F.size("vec").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


def envelope_ingest(spark, sf_dir):
    """The log packed into wire envelopes by session and hour, and unpacked with the limits of 50 events and 50,000 characters."""
    ev = table(spark, sf_dir, "analytics_events").where("session_id IS NOT NULL AND type IS NOT NULL")
    event = F.struct(F.col("id").alias("k"), F.col("type").alias("t"), F.col("timestamp").alias("ts"), F.col("session_id").alias("sid"), F.col("path").alias("p"), F.col("data").alias("d"))
    packed = ev.groupBy("session_id", F.floor(F.col("timestamp") / 3_600_000).alias("h")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    wires = packed.select(F.to_json(F.struct(F.lit(2).alias("v"), F.transform("events", lambda e: F.struct(e["t"].alias("t"), e["ts"].alias("ts"), e["sid"].alias("sid"), e["p"].alias("p"), e["d"].alias("d"))).alias("events"))).alias("value"))
    return S.read_events(wires).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last_ms"))


def stream_daily_counts(spark, sf_dir):
    path = work_dir(spark, "ingest")
    return I.DailyCounts(spark, f"{path}/counts").run(_stream(spark, sf_dir, "analytics_events"), f"{path}/checkpoint")


def _collect(spark, stream, what, mode="append"):
    path = work_dir(spark, what)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def stream_first_impressions(spark, sf_dir):
    """Distinct (session, name) impressions through the streaming de-duplication."""
    ev = A.shape(_stream(spark, sf_dir, "analytics_events")).where("type = 'impression' AND sid IS NOT NULL")
    once = I.once_per_session(ev.select("sid", A.field("name").alias("name"), "ts").where("name IS NOT NULL"), ["sid", "name"], "ts", "3650 days")
    return _collect(spark, once, "first").groupBy("sid").agg(F.count(F.lit(1)).alias("items"))


def stream_rate_limit(spark, sf_dir):
    ev = A.shape(_stream(spark, sf_dir, "analytics_events", 1000)).where("sid IS NOT NULL").select("sid", "id", "at_ms")
    return _collect(spark, I.rate_limited(ev, 8), "limit").groupBy("sid").agg(F.count(F.lit(1)).alias("refused"))


def stream_session_items(spark, sf_dir):
    """Sessions' sequences of distinct items, accumulated on a stream."""
    ev = A.shape(_stream(spark, sf_dir, "analytics_events")).where("sid IS NOT NULL AND type IN ('impression', 'click')").select("sid", A.field("name").alias("name"), "at_ms", "id").where("name IS NOT NULL")
    return _collect(spark, I.session_items(ev), "items").groupBy("sid").agg(F.count(F.lit(1)).alias("items"), F.max("place").alias("last_place"), F.min("name").alias("first_name"))


def stream_rage_clicks(spark, sf_dir):
    """Alerts of three events of one kind within four hours, over the star schema's users."""
    ev = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("sid"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_type").alias("element"))
    return _collect(spark, I.rage_click_alerts(ev, span_ms=4 * 3_600_000), "rage")


def stream_windows(spark, sf_dir):
    """Hourly counts of the star schema's events on a stream; a watermark longer than the data loses nothing."""
    ev = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    path = work_dir(spark, "windows")
    out = f"{path}/out"
    counts = I.windowed_counts(ev, "ts", "60 days")
    query = counts.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy(F.date_format("start", "yyyy-MM-dd HH:00").alias("hour"), "type").agg(F.max("n").alias("n"))


def export_json(spark, sf_dir):
    """Daily statistics as JSON lines, read back."""
    path = work_dir(spark, "export")
    A.daily_stats(A.shape(table(spark, sf_dir, "analytics_events"))).write.json(path)
    return spark.read.schema("date string, pageviews bigint, clicks bigint, searches bigint, sessions bigint").json(path)


def append_submissions(spark, sf_dir):
    a = _archive(spark, sf_dir).select("record_id", "name", "url")
    merged = S.append_submissions(a.where("record_id <= 700"), a.where("record_id > 700"))
    return merged.select("record_id")


QUERIES = {
    "json_catalog": json_catalog,
    "csv_roundtrip": csv_roundtrip,
    "jsonl_results": jsonl_results,
    "markdown_tables": markdown_tables,
    "vectors_binary": vectors_binary,
    "envelope_ingest": envelope_ingest,
    "export_json": export_json,
    "append_submissions": append_submissions,
    "stream_daily_counts": stream_daily_counts,
    "stream_first_impressions": stream_first_impressions,
    "stream_rate_limit": stream_rate_limit,
    "stream_windows": stream_windows,
    "stream_rage_clicks": stream_rage_clicks,
    "stream_session_items": stream_session_items,
}

SQL = {
    "json_catalog": "SELECT name, description, array_to_string(tags, ', ') AS tags, 'dataset' AS type FROM datasets_archive",
    "csv_roundtrip": "SELECT sheet_id, name, current_company, location, coalesce(is_senior, false) AS is_senior, coalesce(verified, false) AS verified FROM collection_sheet",
    "jsonl_results": "SELECT CAST(record_id AS VARCHAR) AS custom_id, CASE WHEN record_id % 10 = 3 THEN 'advanced' ELSE difficulty END AS difficulty FROM datasets_archive",
    "markdown_tables": "SELECT r_name AS section, n_name AS name, 'https://nations.example/' || n_nationkey AS url, n_name AS note FROM nation JOIN region ON n_regionkey = r_regionkey",
    "vectors_binary": "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings",
    "envelope_ingest": """WITH r AS (SELECT type, timestamp, row_number() OVER (PARTITION BY session_id, timestamp // 3600000 ORDER BY id) AS n FROM analytics_events WHERE session_id IS NOT NULL AND type IS NOT NULL)
        SELECT type, count(*) AS n, max(timestamp) AS last_ms FROM r WHERE n <= 50 GROUP BY 1""",
    "export_json": f"WITH {EV}, {_DAILY} SELECT * FROM ds",
    "append_submissions": f"""WITH k AS (SELECT record_id, {_NU} AS u FROM datasets_archive) SELECT record_id FROM k WHERE record_id <= 700
        UNION ALL SELECT record_id FROM k WHERE record_id > 700 AND u <> '' AND u NOT IN (SELECT u FROM k WHERE record_id <= 700 AND u IS NOT NULL)""",
    "stream_daily_counts": f"WITH {EV} SELECT date, type, count(*) AS n FROM ev GROUP BY 1, 2",
    "stream_first_impressions": f"WITH {EV} SELECT sid, count(DISTINCT d->>'$.name') AS items FROM ev WHERE type = 'impression' AND sid IS NOT NULL AND d->>'$.name' IS NOT NULL GROUP BY 1",
    "stream_session_items": f"WITH {EV} SELECT sid, count(DISTINCT d->>'$.name') AS items, CAST(count(DISTINCT d->>'$.name') AS INTEGER) AS last_place, min(d->>'$.name') AS first_name FROM ev WHERE type IN ('impression', 'click') AND sid IS NOT NULL AND d->>'$.name' IS NOT NULL GROUP BY 1",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2",
}
