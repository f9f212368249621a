"""Queries of the small catalog and session operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import item_key
from ..operators import analytics as A
from ..operators import details as D
from ..session import table
from .analytics import _CLICKS, _DAILY, _Q, EV
from .ranking import QUERIES as RANKING
from .ranking import SQL as RANKING_SQL

BY_CATEGORY = {"Labor Markets": "labor", "Retail Prices": "prices", "Transport": "transport"}
BY_KEYWORD = {"survey": "survey", "wage": "labor", "price": "prices", "farm": "agriculture", "panel": "panel", "weekly": "weekly", "data": "data"}
DOMAINS = {"Pricing": "Prices", "Causal Inference": "Causal", "Experimentation": "Experiments"}


def _archive(spark, sf_dir):
    return table(spark, sf_dir, "datasets_archive")


def _events(spark, sf_dir):
    return A.shape(table(spark, sf_dir, "analytics_events"))


def keyword_tags(spark, sf_dir):
    a = _archive(spark, sf_dir)
    return a.select("record_id", F.array_join(D.keyword_tags(F.concat_ws(" ", "name", "description"), F.col("category"), BY_CATEGORY, BY_KEYWORD), "|").alias("tags"))


def guide_links(spark, sf_dir):
    p = table(spark, sf_dir, "leading_lights").select(F.get("specialty", F.lit(0)).alias("area"), F.filter("papers", lambda x: x["year"] >= 2015).alias("late"), F.filter("papers", lambda x: x["year"] < 2015).alias("early"))
    return D.guide_links(p, F.col("area"), {"late": "resource", "early": "package"}, DOMAINS)


def carousel_details(spark, sf_dir):
    a = _archive(spark, sf_dir)
    refs = a.select("record_id", F.concat(F.lit("inline "), F.col("record_id").cast("string")).alias("name"), F.lit("inline").alias("source"))
    return D.with_inline(refs, a.where("record_id % 3 <> 0").select("record_id", "name", "source"), "record_id", ["name", "source"])


def hero_rows(spark, sf_dir):
    a = _archive(spark, sf_dir).select("record_id", F.coalesce("category", F.lit("(none)")).alias("category"), ((F.col("record_id") * 7 % 23) / 100).alias("score"))
    return D.hero_rows(a, "category", "score", "record_id").select("record_id", F.col("place").cast("int").alias("place"), "hero")


def tool_order(spark, sf_dir):
    return D.tool_order(_archive(spark, sf_dir), F.col("url"), F.col("source"), F.col("topic_tags"), "record_id", 50).select("record_id")


def home_top12(spark, sf_dir):
    ranked = RANKING["hybrid_rank"](spark, sf_dir)
    return ranked.where("NOT cold_start").orderBy(F.desc("score"), "item").limit(12).select("item", "score")


def shared_items(spark, sf_dir):
    s = table(spark, sf_dir, "session_sequences").where("session_id IS NOT NULL").select("session_id", F.posexplode("item_sequence").alias("pos", "i"))
    views = s.select("session_id", item_key(F.col("i.name")).alias("item"), "pos").where("item IS NOT NULL").groupBy("session_id", "item").agg(F.min("pos").alias("pos"))
    cards = A.of_type(_events(spark, sf_dir), "click").where((A.field("type") == "card") & F.col("sid").isNotNull())
    clicks = cards.select(F.col("sid").alias("session_id"), item_key(A.field("name")).alias("item"), "at_ms").where("item IS NOT NULL").groupBy("session_id", "item").agg(F.min("at_ms").alias("pos"))
    return D.shared_items(views, clicks)


def clicked_sessions(spark, sf_dir):
    return table(spark, sf_dir, "session_sequences").where(F.col("click_sequence").isNotNull() & (F.size("click_sequence") > 0)).select("session_id", F.size("click_sequence").alias("clicks"))


def placed_and_verified(spark, sf_dir):
    return table(spark, sf_dir, "collection_sheet").where(F.coalesce("verified", F.lit(False)) & F.col("location").isNotNull()).select("sheet_id")


def pages_per_visit(spark, sf_dir):
    return D.pages_per_visit(A.of_type(_events(spark, sf_dir), "pageview"))


def export_clicks_csv(spark, sf_dir):
    return D.csv_lines(A.click_leaderboard(_events(spark, sf_dir)), ["name", "section", "clicks"], [F.desc("clicks"), "name", "section"], 1000)


def export_daily_csv(spark, sf_dir):
    return D.csv_lines(A.daily_stats(_events(spark, sf_dir)), ["date", "pageviews", "clicks"], ["date"])


QUERIES = {
    "keyword_tags": keyword_tags,
    "guide_links": guide_links,
    "carousel_details": carousel_details,
    "hero_rows": hero_rows,
    "tool_order": tool_order,
    "home_top12": home_top12,
    "shared_items": shared_items,
    "clicked_sessions": clicked_sessions,
    "placed_and_verified": placed_and_verified,
    "pages_per_visit": pages_per_visit,
    "export_clicks_csv": export_clicks_csv,
    "export_daily_csv": export_daily_csv,
}

_TAGS = ", ".join([f"CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in BY_CATEGORY.items())} END", *[f"CASE WHEN contains(lower(concat_ws(' ', name, description)), '{k}') THEN '{v}' END" for k, v in BY_KEYWORD.items()]])
_DOMAIN = f"coalesce(CASE specialty[1] {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DOMAINS.items())} END, 'General')"
_PAIRS = lambda rows, key, out: f"SELECT a.item AS item_a, b.item AS item_b, count(*) AS {out} FROM {rows} a JOIN {rows} b ON a.{key} = b.{key} AND a.item < b.item GROUP BY 1, 2"

SQL = {
    "keyword_tags": f"""WITH t AS (SELECT record_id, unnest([{_TAGS}]) AS x, generate_subscripts([{_TAGS}], 1) AS p FROM datasets_archive), f AS (SELECT record_id, x, min(p) AS p FROM t WHERE x IS NOT NULL GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY p) AS n FROM f) SELECT a.record_id, coalesce(string_agg(x, '|' ORDER BY n) FILTER (WHERE n <= 4), '') AS tags FROM datasets_archive a LEFT JOIN r USING (record_id) GROUP BY 1""",
    "guide_links": f"""WITH l AS (SELECT {_DOMAIN} AS domain, unnest(papers) AS p FROM leading_lights) SELECT DISTINCT trim(p.url, ' ') AS url, p.title AS name, domain, coalesce(p.venue, CASE WHEN p.year >= 2015 THEN 'resource' ELSE 'package' END) AS category
        FROM l WHERE trim(p.url, ' ') <> '' AND p.year IS NOT NULL""",
    "carousel_details": "SELECT record_id, coalesce(CASE WHEN record_id % 3 <> 0 THEN name END, 'inline ' || record_id) AS name, coalesce(CASE WHEN record_id % 3 <> 0 THEN source END, 'inline') AS source FROM datasets_archive",
    "hero_rows": """WITH a AS (SELECT record_id, coalesce(category, '(none)') AS category, (record_id * 7 % 23) / 100 AS score FROM datasets_archive),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, record_id) AS INTEGER) AS place FROM a) SELECT record_id, place, place = 1 AND score > 0.1 AS hero FROM r""",
    "tool_order": "SELECT record_id FROM datasets_archive ORDER BY url IS NOT NULL DESC, source IS NOT NULL DESC, coalesce(len(topic_tags), 0) DESC, record_id LIMIT 50",
    "home_top12": f"SELECT item, score FROM ({RANKING_SQL['hybrid_rank']}) WHERE NOT cold_start ORDER BY score DESC, item LIMIT 12",
    "shared_items": f"""WITH {EV}, s AS (SELECT DISTINCT session_id, lower(trim(i.name, ' ')) AS item FROM (SELECT session_id, unnest(item_sequence) AS i FROM session_sequences WHERE session_id IS NOT NULL) WHERE lower(trim(i.name, ' ')) <> ''),
        c AS (SELECT DISTINCT sid, lower(trim(d->>'$.name', ' ')) AS item FROM ev WHERE type = 'click' AND sid IS NOT NULL AND d->>'$.type' = 'card' AND lower(trim(d->>'$.name', ' ')) <> ''),
        v AS ({_PAIRS('s', 'session_id', 'coview_count')}), k AS ({_PAIRS('c', 'sid', 'coclick_count')})
        SELECT item_a, item_b, coalesce(coview_count, 0) AS coview_count, coalesce(coclick_count, 0) AS coclick_count FROM v FULL JOIN k USING (item_a, item_b)""",
    "clicked_sessions": "SELECT session_id, CAST(len(click_sequence) AS INTEGER) AS clicks FROM session_sequences WHERE len(click_sequence) > 0",
    "placed_and_verified": "SELECT sheet_id FROM collection_sheet WHERE coalesce(verified, false) AND location IS NOT NULL",
    "pages_per_visit": f"WITH {EV} SELECT count(*) AS views, count(DISTINCT sid) AS visits, round(count(*) / greatest(count(DISTINCT sid), 1), 1) AS per_visit FROM ev WHERE type = 'pageview'",
    "export_clicks_csv": f"WITH {EV}, {_CLICKS}, n AS (SELECT name, section, CAST(clicks AS VARCHAR) AS clicks FROM (SELECT * FROM cl ORDER BY clicks DESC, name, section LIMIT 1000)) SELECT concat_ws(',', " + ", ".join(_Q(c) for c in ("name", "section", "clicks")) + ") AS line FROM n",
    "export_daily_csv": f"WITH {EV}, {_DAILY} SELECT date || ',' || pageviews || ',' || clicks AS line FROM ds",
}
