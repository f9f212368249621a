"""Batch analytics over the event log: every operator takes a DataFrame of events and returns one.

Events have the columns of ``shape``: ``id, type, sid, page, at_ms, ts, date, hour, country, data``. All aggregates
are plain groupings, so Spark pre-aggregates before each shuffle and hot keys cost no more than one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shape(raw: DataFrame) -> DataFrame:
    """The raw log with typed times, a normalised type and the page path without query and trailing slash."""
    ts = F.timestamp_millis("timestamp")
    page = F.regexp_replace(F.regexp_replace("path", "[?#].*$", ""), "(.)/+$", "$1")
    return raw.where(F.col("timestamp").isNotNull()).select(
        "id", F.regexp_replace(F.lower(F.trim("type")), "[-\\s]+", "_").alias("type"), F.col("session_id").alias("sid"), page.alias("page"), F.col("timestamp").alias("at_ms"), ts.alias("ts"),
        F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "yyyy-MM-dd-HH").alias("hour"), F.coalesce("country", F.lit("unknown")).alias("country"), "data",
    )


def field(name: str) -> Column:
    """A field of the JSON payload; null where the payload lacks it or is broken."""
    return F.get_json_object("data", f"$.{name}")


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("type").isin(*types))


def daily_stats(events: DataFrame) -> DataFrame:
    """Pageviews, clicks, searches and exact distinct sessions by UTC day."""
    counts = [F.count_if(F.col("type") == t).alias(n) for t, n in (("pageview", "pageviews"), ("click", "clicks"), ("search", "searches"))]
    return events.groupBy("date").agg(*counts, F.count_distinct("sid").alias("sessions"))


def daily_sessions_by_batch(events: DataFrame, batch: Column) -> DataFrame:
    """The live path's session count: each batch adds the size of its set of sessions to every day in the batch."""
    per = events.withColumn("batch", batch)
    sizes = per.groupBy("batch").agg(F.count_distinct("sid").alias("n"))
    days = per.select("batch", "date").distinct()
    return days.join(sizes, "batch").groupBy("date").agg(F.sum("n").alias("sessions"))


def hourly_stats(events: DataFrame) -> DataFrame:
    """Pageviews and clicks by UTC hour."""
    return of_type(events, "pageview", "click").groupBy("hour").agg(F.count_if(F.col("type") == "pageview").alias("pageviews"), F.count_if(F.col("type") == "click").alias("clicks"))


def click_leaderboard(events: DataFrame) -> DataFrame:
    """Card clicks by (name, section), with the first category seen."""
    cards = of_type(events, "click").select("id", "at_ms", field("type").alias("kind"), field("name").alias("name"), F.coalesce(field("section"), F.lit("other")).alias("section"), field("category").alias("category"))
    return cards.where("kind = 'card' AND name IS NOT NULL").groupBy("name", "section").agg(F.count(F.lit(1)).alias("clicks"), F.min_by("category", F.struct("at_ms", "id")).alias("category"))


def impressions(events: DataFrame) -> DataFrame:
    """Impressions by (name, section)."""
    return of_type(events, "impression").select(field("name").alias("name"), F.coalesce(field("section"), F.lit("other")).alias("section")).where("name IS NOT NULL").groupBy("name", "section").agg(F.count(F.lit(1)).alias("impressions"))


def search_terms(events: DataFrame) -> DataFrame:
    """Searches by normalised query."""
    return of_type(events, "search").select(F.lower(F.trim(field("q"))).alias("query")).where("query <> ''").groupBy("query").agg(F.count(F.lit(1)).alias("searches"))


def page_views(events: DataFrame) -> DataFrame:
    """Pageviews by path: the payload's, else the event's."""
    path = F.coalesce(field("path"), F.col("page"))
    return of_type(events, "pageview").select(F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "(.)/+$", "$1").alias("path")).where("path IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("views"))


def country_sessions(events: DataFrame) -> DataFrame:
    """Distinct sessions by known country."""
    return events.where("country <> 'unknown'").groupBy("country").agg(F.count_distinct("sid").alias("sessions"))


def dwell_by_session(dwell: DataFrame) -> DataFrame:
    """Dwell by (session, name, section): sums, the last reading ratio and the first time."""
    keyed = dwell.where("session_id IS NOT NULL AND name IS NOT NULL").withColumn("section", F.coalesce("section", F.lit("other")))
    order = F.struct(F.coalesce("timestamp", F.lit(-1)), F.coalesce("reading_ratio", F.lit(-1.0)))
    return keyed.groupBy("session_id", "name", "section").agg(F.sum("dwell_ms").alias("dwell_ms"), F.round(F.sum("viewable_seconds"), 4).alias("viewable_seconds"), F.max_by("reading_ratio", order).alias("reading_ratio"), F.min("timestamp").alias("first_ms"))


def dwell_rollup(dwell: DataFrame) -> DataFrame:
    """Dwell by (name, section)."""
    return dwell.where("name IS NOT NULL").groupBy("name", F.coalesce("section", F.lit("other")).alias("section")).agg(F.sum("dwell_ms").alias("dwell_ms"), F.round(F.sum("viewable_seconds"), 4).alias("viewable_seconds"))


def milestones(events: DataFrame) -> DataFrame:
    """Scroll milestones by (path, milestone), each once for a session."""
    seen = of_type(events, "scroll_milestone").select("sid", "page", field("milestone").cast("int").alias("milestone")).where("milestone IN (25, 50, 75, 90) AND sid IS NOT NULL AND page IS NOT NULL").distinct()
    return seen.groupBy("page", "milestone").agg(F.count(F.lit(1)).alias("sessions"))


def frustrations(events: DataFrame) -> DataFrame:
    """Frustration events by (path, kind)."""
    return of_type(events, "frustration").groupBy("page", field("type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("page IS NOT NULL AND kind IS NOT NULL")


def since(days_col: str, last_day: Column, days: int) -> Column:
    """Days from ``days`` before the last one, both included."""
    return F.col(days_col) >= F.date_format(F.date_sub(F.to_date(last_day), days), "yyyy-MM-dd")


def summary(daily: DataFrame, start: str) -> DataFrame:
    """Totals from a day on; zeros if there are none."""
    return daily.where(F.col("date") >= start).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pageviews", "clicks", "searches", "sessions")])


def hour_fold(hourly: DataFrame, first_hour: str) -> DataFrame:
    """Hour buckets from ``first_hour`` on, folded by hour of day; hours without events are 0."""
    folded = hourly.where(F.col("hour") >= first_hour).groupBy(F.substring("hour", 12, 2).cast("int").alias("hour_of_day")).agg(F.sum("pageviews").alias("pageviews"))
    hours = hourly.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_of_day"))
    return hours.join(F.broadcast(folded), "hour_of_day", "left").select("hour_of_day", F.coalesce("pageviews", F.lit(0)).alias("pageviews"))


def multi_grouping(events: DataFrame) -> DataFrame:
    """Pageviews by date, section, country and in total in one pass, with whole percentages."""
    views = of_type(events, "pageview").select("date", F.split_part("page", F.lit("/"), F.lit(2)).alias("section"), "country")
    dims = [F.col(c) for c in ("date", "section", "country")]
    grouped = views.groupingSets([[c] for c in dims] + [[]], *dims).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("gid") == 3, "date").when(F.col("gid") == 5, "section").when(F.col("gid") == 6, "country").otherwise("total")
    key = F.when(F.col("gid") == 3, F.col("date")).when(F.col("gid") == 5, F.col("section")).when(F.col("gid") == 6, F.col("country"))
    total = views.agg(F.count(F.lit(1))).scalar()
    return grouped.withColumn("total", total).select(kind.alias("dimension"), F.coalesce(key, F.lit("")).alias("key"), "n", F.floor(100 * F.col("n") / F.col("total") + 0.5).cast("int").alias("pct"))


def visitor_range(events: DataFrame) -> DataFrame:
    """Least, most, rounded mean and number of the hours' distinct sessions; defaults where there is none."""
    hours = events.groupBy("hour").agg(F.count_distinct("sid").alias("u")).where("u > 0")
    return hours.agg(F.coalesce(F.min("u"), F.lit(11)).alias("low"), F.coalesce(F.max("u"), F.lit(37)).alias("high"), F.coalesce(F.floor(F.avg("u") + 0.5), F.lit(20)).cast("int").alias("mean"), F.count(F.lit(1)).alias("hours"))


def top(df: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """The rows with the largest ``by``, ties by key."""
    return df.orderBy(F.desc(by), key).limit(limit)


def top_per_group(df: DataFrame, group: str, by: str, keys: list[str], limit: int) -> DataFrame:
    """The rows with the largest ``by`` of each group, ties by keys; ranks are cut before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(by), *keys)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def section_bucket(section: Column) -> Column:
    """Main sections by name, the others together."""
    return F.when(section.isin("packages", "datasets", "learning"), section).otherwise("other")


def rate_limit_fixed(events: DataFrame, limit: int) -> DataFrame:
    """Sessions and minutes in which a session sent more than ``limit`` events (windows of a minute, reset each)."""
    return events.where("sid IS NOT NULL").groupBy("sid", F.floor(F.col("at_ms") / 60000).alias("minute")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def rate_limit_sliding(events: DataFrame, limit: int, span_ms: int = 3_600_000) -> DataFrame:
    """Events that had ``limit`` or more of the same session in the span before."""
    w = Window.partitionBy("sid").orderBy("at_ms").rangeBetween(-span_ms, 0)
    return events.where("sid IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") > limit).select("id", "n")


def vitals(events: DataFrame) -> DataFrame:
    """Mean vital by metric and its rating by fixed bounds."""
    v = of_type(events, "vitals").select(field("metric").alias("metric"), field("value").cast("double").alias("value")).where("metric IS NOT NULL AND value IS NOT NULL").groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    good = F.when(F.col("metric") == "LCP", 2500.0).when(F.col("metric") == "FID", 100.0).when(F.col("metric") == "CLS", 0.1)
    poor = F.when(F.col("metric") == "LCP", 4000.0).when(F.col("metric") == "FID", 300.0).when(F.col("metric") == "CLS", 0.25)
    rating = F.when(good.isNull(), "unrated").when(F.col("mean") <= good, "good").when(F.col("mean") <= poor, "needs-improvement").otherwise("poor")
    return v.select("metric", F.round("mean", 3).alias("mean"), "n", rating.alias("rating"))


def retained(events: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Events that a retention of ``days`` keeps; 0 keeps all."""
    return events if days == 0 else events.where(F.col("at_ms") >= now_ms - days * 86_400_000)


def export_csv(events: DataFrame, limit: int = 10_000) -> DataFrame:
    """Newest events as CSV lines, quoted only where needed; at most ``limit``."""
    from ..functions.text import csv_field

    newest = events.orderBy(F.desc("at_ms"), F.desc("id")).limit(limit)
    return newest.select("id", F.concat_ws(",", *[csv_field(F.col(c)) for c in ("id", "type", "sid", "page", "at_ms", "country", "data")]).alias("line"))
