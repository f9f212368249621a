"""Queries of the event analytics, over ``analytics_events`` and ``content_dwell``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shape(table(spark, sf_dir, "analytics_events"))


def _dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "content_dwell")


def _on(operator, *args):
    return lambda spark, sf_dir: operator(_events(spark, sf_dir), *args)


def summary_7d(spark, sf_dir):
    return A.summary(A.daily_stats(_events(spark, sf_dir)), "2025-03-24")


def hour_fold(spark, sf_dir):
    return A.hour_fold(A.hourly_stats(_events(spark, sf_dir)), "2025-03-30-16")


def topk_clicks_bucketed(spark, sf_dir):
    best = A.top(A.click_leaderboard(_events(spark, sf_dir)), "clicks", "name", 20)
    return best.select("name", A.section_bucket(F.col("section")).alias("bucket"), "clicks")


def topk_per_section(spark, sf_dir):
    return A.top_per_group(A.click_leaderboard(_events(spark, sf_dir)), "section", "clicks", ["name"], 10).select("section", "name", "clicks", "rank")


def click_leaderboard_section(spark, sf_dir):
    rows = A.click_leaderboard(_events(spark, sf_dir)).where(F.col("section") == "datasets")
    return A.top(rows, "clicks", "name", min(500, 200)).select("name", "clicks")


def timeseries_hourly(spark, sf_dir):
    return A.hourly_stats(_events(spark, sf_dir)).where("hour >= '2025-03-10-00' AND hour < '2025-03-17-00'").orderBy("hour")


def average_time(spark, sf_dir):
    """The dashboard's mean dwell, computed from the dwell events."""
    ms = A.field("dwellMs").cast("double")
    return A.of_type(_events(spark, sf_dir), "dwell").agg(F.floor(F.avg(ms) + 0.5).cast("long").alias("mean_dwell_ms"), F.count(ms).alias("n"))


def retention(spark, sf_dir):
    return A.retained(_events(spark, sf_dir), 1743436800000, 14).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "daily_stats": _on(A.daily_stats),
    "daily_sessions_by_batch": lambda s, d: A.daily_sessions_by_batch(_events(s, d), F.expr("(id - 1) DIV 50")),
    "hourly_stats": _on(A.hourly_stats),
    "click_leaderboard": _on(A.click_leaderboard),
    "click_leaderboard_section": click_leaderboard_section,
    "impressions": _on(A.impressions),
    "search_terms": _on(A.search_terms),
    "page_views": _on(A.page_views),
    "page_views_top10": lambda s, d: A.top(A.page_views(_events(s, d)), "views", "path", 10),
    "country_sessions": _on(A.country_sessions),
    "dwell_by_session": lambda s, d: A.dwell_by_session(_dwell(s, d)).na.fill(-1, ["dwell_ms", "first_ms"]),
    "dwell_rollup": lambda s, d: A.dwell_rollup(_dwell(s, d)).na.fill(-1, ["dwell_ms"]),
    "milestones": _on(A.milestones),
    "frustrations": _on(A.frustrations),
    "summary_7d": summary_7d,
    "hour_fold": hour_fold,
    "multi_grouping": _on(A.multi_grouping),
    "visitor_range": _on(A.visitor_range),
    "topk_clicks_bucketed": topk_clicks_bucketed,
    "topk_per_section": topk_per_section,
    "timeseries_hourly": timeseries_hourly,
    "average_time": average_time,
    "rate_limit_fixed": _on(A.rate_limit_fixed, 8),
    "rate_limit_sliding": _on(A.rate_limit_sliding, 25),
    "vitals_bucket": _on(A.vitals),
    "retention": retention,
    "export_events_csv": _on(A.export_csv, 2000),
    "type_counts": lambda s, d: _events(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")),
}

EV = r"""ev AS (SELECT id, regexp_replace(lower(trim(type, ' ')), '[-\s]+', '_', 'g') AS type, session_id AS sid,
    regexp_replace(regexp_replace(path, '[?#].*$', ''), '(.)/+$', '\1') AS page, timestamp AS at_ms, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS date,
    strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d-%H') AS hour, coalesce(country, 'unknown') AS country, data, CASE WHEN json_valid(data) THEN data END AS d
    FROM analytics_events WHERE timestamp IS NOT NULL)"""
_CLICKS = """cl AS (SELECT name, section, count(*) AS clicks, arg_min(coalesce(category, '~'), (at_ms, id)) AS c FROM
    (SELECT id, at_ms, d->>'$.type' AS kind, d->>'$.name' AS name, coalesce(d->>'$.section', 'other') AS section, d->>'$.category' AS category FROM ev WHERE type = 'click')
    WHERE kind = 'card' AND name IS NOT NULL GROUP BY 1, 2)"""
_HOURLY = "hs AS (SELECT hour, count(*) FILTER (WHERE type = 'pageview') AS pageviews, count(*) FILTER (WHERE type = 'click') AS clicks FROM ev WHERE type IN ('pageview', 'click') GROUP BY 1)"
_DAILY = """ds AS (SELECT date, count(*) FILTER (WHERE type = 'pageview') AS pageviews, count(*) FILTER (WHERE type = 'click') AS clicks,
    count(*) FILTER (WHERE type = 'search') AS searches, count(DISTINCT sid) AS sessions FROM ev GROUP BY 1)"""
_PATHS = r"pv AS (SELECT regexp_replace(regexp_replace(coalesce(d->>'$.path', page), '[?#].*$', ''), '(.)/+$', '\1') AS path, count(*) AS views FROM ev WHERE type = 'pageview' GROUP BY 1)"
_Q = lambda c: "CASE WHEN regexp_matches(coalesce(CAST(" + c + " AS VARCHAR), ''), '[,\"\\n]') THEN '\"' || replace(CAST(" + c + " AS VARCHAR), '\"', '\"\"') || '\"' ELSE coalesce(CAST(" + c + " AS VARCHAR), '') END"

SQL = {
    "daily_stats": f"WITH {EV}, {_DAILY} SELECT * FROM ds",
    "daily_sessions_by_batch": f"""WITH {EV}, b AS (SELECT (id - 1) // 50 AS batch, sid, date FROM ev), n AS (SELECT batch, count(DISTINCT sid) AS n FROM b GROUP BY 1)
        SELECT date, CAST(sum(n) AS BIGINT) AS sessions FROM (SELECT DISTINCT batch, date FROM b) JOIN n USING (batch) GROUP BY 1""",
    "hourly_stats": f"WITH {EV}, {_HOURLY} SELECT * FROM hs",
    "click_leaderboard": f"WITH {EV}, {_CLICKS} SELECT name, section, clicks, nullif(c, '~') AS category FROM cl",
    "click_leaderboard_section": f"WITH {EV}, {_CLICKS} SELECT name, clicks FROM cl WHERE section = 'datasets' ORDER BY clicks DESC, name LIMIT 200",
    "impressions": f"WITH {EV} SELECT d->>'$.name' AS name, coalesce(d->>'$.section', 'other') AS section, count(*) AS impressions FROM ev WHERE type = 'impression' AND d->>'$.name' IS NOT NULL GROUP BY 1, 2",
    "search_terms": f"WITH {EV} SELECT lower(trim(d->>'$.q', ' ')) AS query, count(*) AS searches FROM ev WHERE type = 'search' AND lower(trim(d->>'$.q', ' ')) <> '' GROUP BY 1",
    "page_views": f"WITH {EV}, {_PATHS} SELECT * FROM pv WHERE path IS NOT NULL",
    "page_views_top10": f"WITH {EV}, {_PATHS} SELECT * FROM pv WHERE path IS NOT NULL ORDER BY views DESC, path LIMIT 10",
    "country_sessions": f"WITH {EV} SELECT country, count(DISTINCT sid) AS sessions FROM ev WHERE country <> 'unknown' GROUP BY 1",
    "dwell_by_session": """SELECT session_id, name, coalesce(section, 'other') AS section, coalesce(CAST(sum(dwell_ms) AS BIGINT), -1) AS dwell_ms, round(sum(viewable_seconds), 4) AS viewable_seconds,
        nullif(arg_max(coalesce(reading_ratio, -1.0), (coalesce(timestamp, -1), coalesce(reading_ratio, -1.0))), -1.0) AS reading_ratio, coalesce(min(timestamp), -1) AS first_ms
        FROM content_dwell WHERE session_id IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2, 3""",
    "dwell_rollup": "SELECT name, coalesce(section, 'other') AS section, coalesce(CAST(sum(dwell_ms) AS BIGINT), -1) AS dwell_ms, round(sum(viewable_seconds), 4) AS viewable_seconds FROM content_dwell WHERE name IS NOT NULL GROUP BY 1, 2",
    "milestones": f"""WITH {EV} SELECT page, milestone, count(*) AS sessions FROM (SELECT DISTINCT sid, page, TRY_CAST(d->>'$.milestone' AS INTEGER) AS milestone FROM ev WHERE type = 'scroll_milestone')
        WHERE milestone IN (25, 50, 75, 90) AND sid IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2""",
    "frustrations": f"WITH {EV} SELECT page, d->>'$.type' AS kind, count(*) AS n FROM ev WHERE type = 'frustration' AND page IS NOT NULL AND d->>'$.type' IS NOT NULL GROUP BY 1, 2",
    "summary_7d": f"WITH {EV}, {_DAILY} SELECT " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("pageviews", "clicks", "searches", "sessions")) + " FROM ds WHERE date >= '2025-03-24'",
    "hour_fold": f"""WITH {EV}, {_HOURLY}, f AS (SELECT CAST(substr(hour, 12, 2) AS INTEGER) AS h, sum(pageviews) AS p FROM hs WHERE hour >= '2025-03-30-16' GROUP BY 1)
        SELECT CAST(r.h AS INTEGER) AS hour_of_day, CAST(coalesce(p, 0) AS BIGINT) AS pageviews FROM (SELECT unnest(range(24)) AS h) r LEFT JOIN f ON f.h = r.h""",
    "multi_grouping": f"""WITH {EV}, v AS (SELECT date, split_part(page, '/', 2) AS section, country FROM ev WHERE type = 'pageview'),
        g AS (SELECT grouping(date, section, country) AS gid, date, section, country, count(*) AS n FROM v GROUP BY GROUPING SETS ((date), (section), (country), ()))
        SELECT CASE gid WHEN 3 THEN 'date' WHEN 5 THEN 'section' WHEN 6 THEN 'country' ELSE 'total' END AS dimension,
               coalesce(CASE gid WHEN 3 THEN date WHEN 5 THEN section WHEN 6 THEN country END, '') AS key, n, CAST(floor(100 * n / (SELECT count(*) FROM v) + 0.5) AS INTEGER) AS pct FROM g""",
    "visitor_range": f"""WITH {EV}, h AS (SELECT hour, count(DISTINCT sid) AS u FROM ev GROUP BY 1 HAVING count(DISTINCT sid) > 0)
        SELECT coalesce(min(u), 11) AS low, coalesce(max(u), 37) AS high, CAST(coalesce(floor(avg(u) + 0.5), 20) AS INTEGER) AS mean, count(*) AS hours FROM h""",
    "topk_clicks_bucketed": f"WITH {EV}, {_CLICKS} SELECT name, CASE WHEN section IN ('packages', 'datasets', 'learning') THEN section ELSE 'other' END AS bucket, clicks FROM (SELECT * FROM cl ORDER BY clicks DESC, name LIMIT 20)",
    "topk_per_section": f"WITH {EV}, {_CLICKS} SELECT section, name, clicks, CAST(row_number() OVER w AS INTEGER) AS rank FROM cl WINDOW w AS (PARTITION BY section ORDER BY clicks DESC, name) QUALIFY row_number() OVER w <= 10",
    "timeseries_hourly": f"WITH {EV}, {_HOURLY} SELECT * FROM hs WHERE hour >= '2025-03-10-00' AND hour < '2025-03-17-00'",
    "average_time": f"WITH {EV} SELECT CAST(floor(avg(CAST(d->>'$.dwellMs' AS DOUBLE)) + 0.5) AS BIGINT) AS mean_dwell_ms, count(d->>'$.dwellMs') AS n FROM ev WHERE type = 'dwell'",
    "rate_limit_fixed": f"WITH {EV} SELECT sid, at_ms // 60000 AS minute, count(*) AS n FROM ev WHERE sid IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 8",
    "rate_limit_sliding": f"WITH {EV} SELECT id, n FROM (SELECT id, count(*) OVER (PARTITION BY sid ORDER BY at_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS n FROM ev WHERE sid IS NOT NULL) WHERE n > 25",
    "vitals_bucket": f"""WITH {EV}, v AS (SELECT d->>'$.metric' AS metric, avg(CAST(d->>'$.value' AS DOUBLE)) AS m, count(*) AS n FROM ev WHERE type = 'vitals' AND d->>'$.metric' IS NOT NULL AND d->>'$.value' IS NOT NULL GROUP BY 1),
        b(metric, good, poor) AS (VALUES ('LCP', 2500.0, 4000.0), ('FID', 100.0, 300.0), ('CLS', 0.1, 0.25))
        SELECT v.metric, round(m, 3) AS mean, n, CASE WHEN good IS NULL THEN 'unrated' WHEN m <= good THEN 'good' WHEN m <= poor THEN 'needs-improvement' ELSE 'poor' END AS rating FROM v LEFT JOIN b ON b.metric = v.metric""",
    "retention": f"WITH {EV} SELECT date, count(*) AS n FROM ev WHERE at_ms >= 1743436800000 - 14 * 86400000 GROUP BY 1",
    "export_events_csv": f"WITH {EV}, n AS (SELECT * FROM ev ORDER BY at_ms DESC, id DESC LIMIT 2000) SELECT id, concat_ws(',', " + ", ".join(_Q(c) for c in ("id", "type", "sid", "page", "at_ms", "country", "data")) + ") AS line FROM n",
    "type_counts": f"WITH {EV} SELECT type, count(*) AS n FROM ev GROUP BY 1",
}
