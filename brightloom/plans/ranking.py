"""Queries of the ranking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import ENGAGEMENT, citation_boost, hero_score
from ..operators import analytics as A
from ..operators import ranking as R
from ..operators import sessions as S
from ..session import cut, table
from .analytics import _CLICKS, EV


def _signals(spark, sf_dir):
    return R.signals(A.shape(table(spark, sf_dir, "analytics_events")), table(spark, sf_dir, "content_dwell"), table(spark, sf_dir, "session_sequences"))


def item_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("item", *[F.round(c, 6).alias(c) for c in ENGAGEMENT])


def engagement_score(spark, sf_dir):
    edges = S.item_pairs(table(spark, sf_dir, "session_sequences"), 3)
    return R.engagement(R.with_cooccurrence(_signals(spark, sf_dir), edges)).select("item", F.round("raw", 6).alias("raw"))


def rank_all(spark, sf_dir):
    scored = R.normalised(cut(R.engagement(_signals(spark, sf_dir)).where("raw > 0").select("item", "raw"), "raw"), "raw", "s").withColumn("score", F.round("s", 6))
    return R.ranked(scored.select("item", "score"), "score", "item")


def _catalog(spark, sf_dir):
    """Parts as a catalog: brand as category, type's first word as kind, retail price as a score."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), (F.col("p_retailprice") / 2000).alias("score"), F.col("p_size").alias("size"))


def hybrid_rank(spark, sf_dir):
    predicted = _catalog(spark, sf_dir).select(F.col("id").alias("item"), F.col("score").alias("prediction"))
    sold = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("raw")).where("raw > 250")
    return R.hybrid(sold, predicted).select("item", F.round("score", 6).alias("score"), "cold_start")


def top3_per_kind(spark, sf_dir):
    return A.top_per_group(_catalog(spark, sf_dir).select("kind", "id", F.round("score", 6).alias("score")), "kind", "score", ["id"], 3)


def wilson_ctr(spark, sf_dir):
    ev = A.shape(table(spark, sf_dir, "analytics_events"))
    scored = R.rate_scores(R.click_rates(A.click_leaderboard(ev), A.impressions(ev)))
    return scored.select("name", "section", "clicks", "impressions", *[F.round(c, 6).alias(c) for c in ("ctr", "confidence", "popularity")])


def composite_rank(spark, sf_dir):
    ev = A.shape(table(spark, sf_dir, "analytics_events"))
    rates = cut(R.click_rates(A.click_leaderboard(ev), A.impressions(ev)), "rates")
    return R.composite_rank(rates, A.dwell_rollup(table(spark, sf_dir, "content_dwell").where("dwell_ms BETWEEN 1 AND 86400000"))).select("name", "section", F.round("score", 6).alias("score"))


def section_ctr(spark, sf_dir):
    ev = A.shape(table(spark, sf_dir, "analytics_events"))
    return R.section_rates(R.click_rates(A.click_leaderboard(ev), A.impressions(ev))).select("section", "clicks", "impressions", F.round("ctr", 6).alias("ctr"))


def coverage(spark, sf_dir):
    found = cut(_signals(spark, sf_dir), "signals")
    return R.coverage(found, found.count())


def hero(spark, sf_dir):
    items = table(spark, sf_dir, "part")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("talk", "resource", "book", "paper", "package", "dataset", "community", "career")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    scored = items.select("p_brand", "p_partkey", F.round(hero_score(kinds, F.col("p_size") * 20, F.when(F.col("p_size") % 3 == 0, F.col("p_size") * 100), 2024 - F.col("p_size") % 15), 6).alias("score"))
    return scored.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("score", -F.col("p_partkey"))).alias("hero"), F.max("score").alias("score"))


def citation_boosted(spark, sf_dir):
    items = _catalog(spark, sf_dir)
    most = items.agg(F.max("size")).scalar()
    return items.select("id", F.round(citation_boost(F.col("score"), F.col("size"), most, 0.2), 6).alias("score"))


def auc_rank_sum(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = R.auc(orders.select(F.round("o_totalprice", -3).alias("score"), F.col("o_orderstatus").alias("s")), "score", F.col("s") == "F")
    return found.select(F.round("auc", 8).alias("auc"), "positives", "negatives")


QUERIES = {
    "item_signals": item_signals,
    "engagement_score": engagement_score,
    "rank_all": rank_all,
    "hybrid_rank": hybrid_rank,
    "top3_per_kind": top3_per_kind,
    "wilson_ctr": wilson_ctr,
    "composite_rank": composite_rank,
    "section_ctr": section_ctr,
    "section_average": lambda s, d: composite_rank(s, d).groupBy("section").agg(F.round(F.avg("score"), 4).alias("mean"), F.count(F.lit(1)).alias("items")),
    "coverage": coverage,
    "category_rollup": lambda s, d: R.category_rollup(_catalog(s, d), "kind", "category", "score"),
    "hero": hero,
    "citation_boosted": citation_boosted,
    "auc_rank_sum": auc_rank_sum,
}

_SIG = """sg AS (
    SELECT CASE WHEN type IN ('scroll_milestone', 'frustration') THEN CASE WHEN contains(trim(page, '/'), '/') THEN replace(replace(lower(split_part(trim(page, '/'), '/', -1)), '-', ' '), '_', ' ') END
                WHEN type = 'search_click' THEN nullif(lower(trim(d->>'$.resultId', ' ')), '') ELSE nullif(lower(trim(d->>'$.name', ' ')), '') END AS item,
           CASE WHEN type = 'click' AND d->>'$.type' = 'card' THEN 'clicks' WHEN type = 'impression' THEN 'impressions' WHEN type = 'search_click' THEN 'search_clicks'
                WHEN type = 'scroll_milestone' AND d->>'$.milestone' IN ('50', '75', '90') THEN 'scroll_' || (d->>'$.milestone')
                WHEN type = 'frustration' AND d->>'$.type' = 'rage_click' THEN 'rage_clicks' WHEN type = 'frustration' AND d->>'$.type' = 'quick_bounce' THEN 'quick_bounces' END AS signal, 1.0::DOUBLE AS value FROM ev
    UNION ALL SELECT nullif(lower(trim(name, ' ')), ''), 'dwell_minutes', dwell_ms / 60000.0::DOUBLE FROM content_dwell WHERE dwell_ms BETWEEN 1 AND 86400000
    UNION ALL SELECT nullif(lower(trim(name, ' ')), ''), 'viewable_seconds', coalesce(viewable_seconds, 0) FROM content_dwell WHERE dwell_ms BETWEEN 1 AND 86400000
    UNION ALL SELECT nullif(item, ''), 'deep_sessions', 1.0 FROM (SELECT unnest(list_distinct(list_transform(item_sequence, lambda i: lower(trim(i.name, ' '))))) AS item FROM session_sequences WHERE duration_ms >= 120000)),
    si AS (SELECT item, """ + ", ".join(f"coalesce(sum(value) FILTER (WHERE signal = '{c}'), 0) AS {c}" for c in ENGAGEMENT) + " FROM sg WHERE item IS NOT NULL AND signal IS NOT NULL GROUP BY item)"
_RAW = "greatest(0, " + " + ".join(f"{c} * {w}" for c, w in ENGAGEMENT.items()) + ")"
_PAIRS = """cs AS (SELECT DISTINCT session_id, lower(trim(i.name, ' ')) AS item FROM (SELECT session_id, unnest(item_sequence) AS i FROM session_sequences WHERE session_id IS NOT NULL) WHERE lower(trim(i.name, ' ')) <> ''),
    ed AS (SELECT a.item AS x, b.item AS y, count(*) AS n FROM cs a JOIN cs b ON a.session_id = b.session_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 3),
    ce AS (SELECT item, sum(n) AS n FROM (SELECT x AS item, n FROM ed UNION ALL SELECT y, n FROM ed) GROUP BY 1)"""
_CAT = "ca AS (SELECT p_partkey AS id, p_name AS name, p_brand AS category, split_part(p_type, ' ', 1) AS kind, p_retailprice / 2000 AS score, p_size AS size FROM part)"
_RATES = f"""{EV}, {_CLICKS}, im AS (SELECT d->>'$.name' AS name, coalesce(d->>'$.section', 'other') AS section, count(*) AS impressions FROM ev WHERE type = 'impression' AND d->>'$.name' IS NOT NULL GROUP BY 1, 2),
    ra AS (SELECT name, section, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions FROM cl FULL JOIN im USING (name, section)),
    se AS (SELECT section, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(clicks) / greatest(sum(impressions), 1) AS ctr FROM ra GROUP BY 1),
    sc AS (SELECT name, section, ra.clicks, ra.impressions, CASE WHEN ra.impressions >= 3 THEN ra.clicks / ra.impressions WHEN ra.impressions > 0 THEN 0.5 * ra.clicks / ra.impressions + 0.5 * se.ctr ELSE 0 END AS ctr,
           CASE WHEN ra.impressions = 0 THEN 0 ELSE (ra.clicks / ra.impressions + 3.8416 / (2 * ra.impressions)
             - 1.96 * sqrt(greatest(0, (ra.clicks / ra.impressions * (1 - ra.clicks / ra.impressions) + 3.8416 / (4 * ra.impressions)) / ra.impressions))) / (1 + 3.8416 / ra.impressions) END AS confidence,
           ln(ra.clicks + 1) / ln(100) AS popularity FROM ra JOIN se USING (section))"""
_MM = lambda c: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
_COMP = f"""{_RATES}, dw AS (SELECT name, section, {_MM("dm")} AS dwell, {_MM("vs")} AS viewable FROM (SELECT name, coalesce(section, 'other') AS section, sum(dwell_ms) AS dm, round(sum(viewable_seconds), 4) AS vs FROM content_dwell
        WHERE name IS NOT NULL AND dwell_ms BETWEEN 1 AND 86400000 GROUP BY 1, 2)),
    nn AS (SELECT *, {_MM("ctr")} AS c, {_MM("popularity")} AS p FROM sc),
    co AS (SELECT name, section, round(CASE WHEN dwell IS NULL THEN 0.425 * c + 0.265 * p + 0.16 * confidence ELSE 0.30 * c + 0.25 * dwell + 0.20 * viewable + 0.15 * p + 0.10 * confidence END, 6) AS score FROM nn LEFT JOIN dw USING (name, section))"""
_KIND = "['talk', 'resource', 'book', 'paper', 'package', 'dataset', 'community', 'career'][p_partkey % 8 + 1]"

SQL = {
    "item_signals": f"WITH {EV}, {_SIG} SELECT item, " + ", ".join(f"round({c}, 6) AS {c}" for c in ENGAGEMENT) + " FROM si",
    "engagement_score": f"WITH {EV}, {_SIG}, {_PAIRS} SELECT item, round({_RAW.replace('coviews *', '(coviews + coalesce(ce.n, 0)) *')}, 6) AS raw FROM si LEFT JOIN ce USING (item)",
    "rank_all": f"WITH {EV}, {_SIG}, r AS (SELECT item, {_RAW} AS raw FROM si), p AS (SELECT * FROM r WHERE raw > 0), s AS (SELECT item, round({_MM('raw')}, 6) AS score FROM p) SELECT item, score, CAST(row_number() OVER (ORDER BY score DESC, item) AS INTEGER) AS rank FROM s",
    "hybrid_rank": f"""WITH {_CAT}, o AS (SELECT l_partkey AS item, sum(l_quantity) AS raw FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING sum(l_quantity) > 250), a AS (SELECT item, {_MM('raw')} AS actual FROM o),
        g AS (SELECT id AS item, {_MM('score')} AS guess FROM ca), m AS (SELECT item, coalesce(actual, 0.3 * guess) AS mixed, actual IS NULL AS cold_start FROM g LEFT JOIN a USING (item)) SELECT item, round({_MM('mixed')}, 6) AS score, cold_start FROM m""",
    "top3_per_kind": f"WITH {_CAT} SELECT kind, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY kind ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank FROM ca QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(score, 6) DESC, id) <= 3",
    "wilson_ctr": f"WITH {_RATES} SELECT name, section, clicks, impressions, round(ctr, 6) AS ctr, round(confidence, 6) AS confidence, round(popularity, 6) AS popularity FROM sc",
    "composite_rank": f"WITH {_COMP} SELECT * FROM co",
    "section_ctr": f"WITH {_RATES} SELECT section, clicks, impressions, round(ctr, 6) AS ctr FROM se",
    "section_average": f"WITH {_COMP} SELECT section, round(avg(score), 4) AS mean, count(*) AS items FROM co GROUP BY 1",
    "coverage": f"WITH {EV}, {_SIG} " + " UNION ALL ".join(f"SELECT '{c}' AS signal, count(*) FILTER (WHERE {c} <> 0) AS items, round(100.0 * count(*) FILTER (WHERE {c} <> 0) / count(*), 1) AS pct FROM si" for c in ENGAGEMENT),
    "category_rollup": f"WITH {_CAT} SELECT kind, category, round(sum(score), 8) AS total, round(avg(score), 8) AS mean, round(max(score), 8) AS best, count(*) AS items, count(*) FILTER (WHERE score > 0) AS engaged FROM ca GROUP BY 1, 2",
    "hero": f"""WITH h AS (SELECT p_brand, p_partkey, {_KIND} AS k, p_size * 20 AS c, CASE WHEN p_size % 3 = 0 THEN p_size * 100 ELSE 0 END AS stars, p_size % 15 AS age FROM part),
        m(k, media, proxy) AS (VALUES ('talk', 1.0, 0.8), ('resource', 0.5, 0.6), ('book', 0.4, 0.5), ('paper', 0.4, 0.5), ('package', 0.3, 0.4), ('dataset', 0.3, 0.3), ('community', 0.2, 0.2), ('career', 0.1, 0.1)),
        s AS (SELECT p_brand, p_partkey, round(0.20 * media + 0.25 * CASE WHEN h.k = 'paper' AND c > 0 THEN least(1.0, ln(1 + c) / ln(1001)) WHEN h.k = 'talk' THEN 0.6 WHEN h.k = 'book' THEN 0.5 ELSE 0.3 END
            + 0.30 * CASE WHEN stars > 0 THEN least(1.0, ln(1 + stars) / ln(10001)) ELSE proxy END + 0.25 * exp(-0.15 * age), 6) AS score FROM h JOIN m ON m.k = h.k)
        SELECT p_brand, arg_max(p_partkey, (score, -p_partkey)) AS hero, max(score) AS score FROM s GROUP BY 1""",
    "citation_boosted": f"WITH {_CAT} SELECT id, round(least(1.0, score + ln(1 + size) / ln(1 + (SELECT max(size) FROM ca)) * 0.2), 6) AS score FROM ca",
    "auc_rank_sum": """WITH b AS (SELECT round(o_totalprice, -3) AS s, count(*) FILTER (WHERE o_orderstatus = 'F') AS p, count(*) FILTER (WHERE o_orderstatus <> 'F') AS q FROM orders GROUP BY 1),
        w AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
        SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 8) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives FROM w""",
}
