"""Queries of the session operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import sessions as S
from ..session import table
from .analytics import EV


def _events(spark, sf_dir):
    return A.shape(table(spark, sf_dir, "analytics_events"))


def _star(spark, sf_dir):
    """The star schema's event stream with its time in milliseconds."""
    return table(spark, sf_dir, "events").withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def rage_click(spark, sf_dir):
    clicks = _star(spark, sf_dir).select("event_id", "user_id", "event_type", "at_ms")
    return S.rage_clicks(clicks, "user_id", "event_type", "at_ms", "event_id", span_ms=4 * 3_600_000).select("event_id", "user_id")


def reformulation(spark, sf_dir):
    searches = _events(spark, sf_dir).where("type = 'search' AND sid IS NOT NULL").select("id", "sid", "at_ms", A.field("q").alias("q")).where("q IS NOT NULL")
    return S.reformulations(searches, "sid", "q", "at_ms", "id").select("id", "previous_id", F.round("similarity", 6).alias("similarity"))


def recent_history(spark, sf_dir):
    seen = table(spark, sf_dir, "content_dwell").where("session_id IS NOT NULL AND timestamp IS NOT NULL").select("session_id", F.lower(F.trim("name")).alias("item"), "timestamp").where("item <> ''")
    return S.recent(seen, "session_id", "item", "timestamp", 5).select("session_id", "item", "rank")


def gap_sessions(spark, sf_dir):
    found = S.gap_sessions(_star(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def visible_dwell(spark, sf_dir):
    spans = S.visible_spans(_star(spark, sf_dir), "user_id", F.col("at_ms"), F.col("event_type") == "view", "event_id")
    return spans.groupBy("user_id").agg(F.count(F.lit(1)).alias("spans"), F.sum("dwell_ms").alias("dwell_ms"))


QUERIES = {
    "session_latest": lambda s, d: S.latest_sessions(table(s, d, "session_sequences")).select("session_id", "duration_ms", "items", "pages").na.fill(-1, ["duration_ms"]),
    "session_features": lambda s, d: S.session_features(table(s, d, "session_sequences")).select("session_id", "pageviews", "unique_items", "duration_ms", "engagement_tier").na.fill(-1, ["duration_ms"]),
    "tier_rollup": lambda s, d: S.session_features(table(s, d, "session_sequences")).groupBy("engagement_tier").agg(F.count(F.lit(1)).alias("sessions"), F.sum("pageviews").alias("pageviews"), F.sum("unique_items").alias("items")),
    "search_session_clicks": lambda s, d: S.search_sessions(_events(s, d), A.field),
    "first_impression": lambda s, d: S.first_impressions(_events(s, d), A.field),
    "rage_click": rage_click,
    "reformulation": reformulation,
    "search_attribution": lambda s, d: S.attribute_clicks(_events(s, d), A.field),
    "recent_history": recent_history,
    "gap_sessions": gap_sessions,
    "visible_dwell": visible_dwell,
    "cooccurrence": lambda s, d: S.item_pairs(table(s, d, "session_sequences"), 3),
}

_LATEST = """l AS (SELECT session_id, max({'d': coalesce(duration_ms, -1), 'i': coalesce(len(item_sequence), 0), 'p': coalesce(len(page_sequence), 0)}) AS r FROM session_sequences WHERE session_id IS NOT NULL GROUP BY 1)"""
_TIER = "CASE WHEN r.d = -1 THEN NULL WHEN r.d < 10000 THEN 'bounce' WHEN r.d < 30000 THEN 'skim' WHEN r.d < 120000 THEN 'read' ELSE 'deep' END"
_STAR = "st AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS at_ms, ts FROM events)"

SQL = {
    "session_latest": f"WITH {_LATEST} SELECT session_id, r.d AS duration_ms, CAST(r.i AS INTEGER) AS items, CAST(r.p AS INTEGER) AS pages FROM l",
    "session_features": f"WITH {_LATEST} SELECT session_id, CAST(r.p AS INTEGER) AS pageviews, CAST(r.i AS INTEGER) AS unique_items, r.d AS duration_ms, {_TIER} AS engagement_tier FROM l",
    "tier_rollup": f"WITH {_LATEST} SELECT {_TIER} AS engagement_tier, count(*) AS sessions, CAST(sum(r.p) AS BIGINT) AS pageviews, CAST(sum(r.i) AS BIGINT) AS items FROM l GROUP BY 1",
    "search_session_clicks": f"""WITH {EV},
        h AS (SELECT sid, d->>'$.qid' AS qid, arg_min(coalesce(d->>'$.q', '~null'), (at_ms, id)) AS q FROM ev WHERE type = 'search' AND sid IS NOT NULL AND d->>'$.qid' IS NOT NULL GROUP BY 1, 2),
        c AS (SELECT sid, d->>'$.qid' AS qid, string_agg(coalesce(d->>'$.resultId', '') || '@' || coalesce(d->>'$.position', ''), ';' ORDER BY at_ms, id) AS clicks FROM ev WHERE type = 'search_click' AND sid IS NOT NULL AND d->>'$.qid' IS NOT NULL GROUP BY 1, 2),
        a AS (SELECT sid, d->>'$.qid' AS qid, max_by({{'m': TRY_CAST(d->>'$.dwellMs' AS BIGINT), 's': TRY_CAST(d->>'$.scrollDepth' AS INTEGER)}}, (at_ms, id)) AS l FROM ev WHERE type = 'search_abandon' AND sid IS NOT NULL AND d->>'$.qid' IS NOT NULL GROUP BY 1, 2)
        SELECT sid, qid, nullif(q, '~null') AS query, clicks, CASE WHEN l IS NULL THEN NULL WHEN l.m > 10000 AND l.s > 30 THEN 'good' WHEN l.m < 2000 THEN 'bad' ELSE 'unknown' END AS abandonment
        FROM h FULL JOIN c USING (sid, qid) FULL JOIN a USING (sid, qid)""",
    "first_impression": f"""WITH {EV} SELECT sid, name, section, arg_min(id, (at_ms, id)) AS id FROM (SELECT sid, d->>'$.name' AS name, coalesce(d->>'$.section', 'other') AS section, at_ms, id FROM ev WHERE type = 'impression' AND sid IS NOT NULL)
        WHERE name IS NOT NULL GROUP BY 1, 2, 3""",
    "rage_click": f"""WITH {_STAR}, c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) = event_type THEN 0 ELSE 1 END AS ch FROM st),
        r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS run FROM c),
        b AS (SELECT *, lag(at_ms, 2) OVER (PARTITION BY user_id, run ORDER BY at_ms, event_id) AS before FROM r)
        SELECT event_id, user_id FROM b WHERE at_ms - before < 14400000""",
    "reformulation": rf"""WITH {EV}, q AS (SELECT id, sid, at_ms, d->>'$.q' AS q FROM ev WHERE type = 'search' AND sid IS NOT NULL AND d->>'$.q' IS NOT NULL),
        p AS (SELECT id, lag(id) OVER w AS previous_id, list_distinct(list_filter(regexp_split_to_array(lower(q), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(lag(q) OVER w), '\s+'), lambda x: x <> '')) AS b
              FROM q WINDOW w AS (PARTITION BY sid ORDER BY at_ms, id)),
        j AS (SELECT id, previous_id, len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0) AS s FROM p WHERE previous_id IS NOT NULL)
        SELECT id, previous_id, round(s, 6) AS similarity FROM j WHERE s > 0.3""",
    "search_attribution": f"""WITH {EV}, r AS (SELECT id, sid, type, at_ms, CASE WHEN type = 'search' THEN d->>'$.qid' END AS qid FROM ev WHERE type IN ('search', 'click') AND sid IS NOT NULL),
        w AS (SELECT id, sid, type, last_value(qid IGNORE NULLS) OVER (PARTITION BY sid ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING) AS qid FROM r)
        SELECT id, sid, qid FROM w WHERE type = 'click' AND qid IS NOT NULL""",
    "recent_history": """WITH l AS (SELECT session_id, lower(trim(name, ' ')) AS item, max(timestamp) AS seen FROM content_dwell WHERE session_id IS NOT NULL AND timestamp IS NOT NULL AND lower(trim(name, ' ')) <> '' GROUP BY 1, 2)
        SELECT session_id, item, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seen DESC, item) AS INTEGER) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seen DESC, item) <= 5""",
    "gap_sessions": f"""WITH {_STAR}, g AS (SELECT user_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s, ts FROM st),
        r AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g), c AS (SELECT user_id, n, count(*) AS k FROM r GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(k) AS longest FROM c GROUP BY 1""",
    "visible_dwell": f"""WITH {_STAR}, n AS (SELECT user_id, event_type, lead(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) - at_ms AS d FROM st)
        SELECT user_id, count(*) AS spans, CAST(sum(d) AS BIGINT) AS dwell_ms FROM n WHERE event_type = 'view' AND d > 1000 GROUP BY 1""",
    "cooccurrence": """WITH s AS (SELECT session_id, lower(trim(i.name, ' ')) AS item, min(pos) AS pos FROM
            (SELECT session_id, unnest(x) AS i, generate_subscripts(x, 1) AS pos FROM (SELECT session_id, list_filter(item_sequence, lambda e: lower(trim(e.name, ' ')) <> '') AS x FROM session_sequences WHERE session_id IS NOT NULL)) GROUP BY 1, 2)
        SELECT a.item AS item_a, b.item AS item_b, count(*) AS coview_count, round(avg(abs(a.pos - b.pos)), 4) AS avg_distance FROM s a JOIN s b ON a.session_id = b.session_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 3""",
}
