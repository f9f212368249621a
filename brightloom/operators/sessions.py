"""Session-level operators: features, sequences, attribution, frustration, history, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import abandonment, tier
from ..functions.text import jaccard


def latest_sessions(sequences: DataFrame) -> DataFrame:
    """Latest-wins state: of a session's rows the longest one by duration, then by items and pages."""
    n = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array())), F.lit(0))
    rows = sequences.where("session_id IS NOT NULL").select("session_id", F.coalesce("duration_ms", F.lit(-1)).alias("d"), n("item_sequence").alias("items"), n("page_sequence").alias("pages"), F.col("page_sequence.pid").alias("pids"))
    best = rows.groupBy("session_id").agg(F.max(F.struct("d", "items", "pages", "pids")).alias("r"))
    return best.select("session_id", F.nullif("r.d", F.lit(-1)).alias("duration_ms"), "r.items", "r.pages", "r.pids")


def session_features(sequences: DataFrame) -> DataFrame:
    """Page views, items, distinct pages, duration and engagement tier of each session."""
    rows = latest_sessions(sequences)
    return rows.select("session_id", F.col("pages").alias("pageviews"), F.col("items").alias("unique_items"), F.coalesce(F.greatest(F.size(F.array_distinct("pids")), F.lit(0)), F.lit(0)).alias("unique_pages"), "duration_ms", F.when(F.col("duration_ms").isNotNull(), tier(F.col("duration_ms"))).alias("engagement_tier"))


def search_sessions(events: DataFrame, field) -> DataFrame:
    """By (session, query id): the query, its clicks in order as ``id@position``, and how the search was left."""
    searches = events.where("type = 'search'").select("sid", field("qid").alias("qid"), field("q").alias("query"), "at_ms", "id").where("qid IS NOT NULL AND sid IS NOT NULL")
    head = searches.groupBy("sid", "qid").agg(F.min_by("query", F.struct("at_ms", "id")).alias("query"))
    clicks = events.where("type = 'search_click'").select("sid", field("qid").alias("qid"), F.struct("at_ms", "id", F.concat_ws("@", F.coalesce(field("resultId"), F.lit("")), F.coalesce(field("position"), F.lit(""))).alias("c")).alias("click")).where("qid IS NOT NULL AND sid IS NOT NULL")
    clicked = clicks.groupBy("sid", "qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("click")), lambda c: c["c"]), ";").alias("clicks"))
    left = events.where("type = 'search_abandon'").select("sid", field("qid").alias("qid"), field("dwellMs").cast("bigint").alias("dwell_ms"), field("scrollDepth").cast("int").alias("scroll"), "at_ms", "id").where("qid IS NOT NULL AND sid IS NOT NULL")
    left = left.groupBy("sid", "qid").agg(F.max_by(F.struct("dwell_ms", "scroll"), F.struct("at_ms", "id")).alias("l")).select("sid", "qid", abandonment(F.col("l.dwell_ms"), F.col("l.scroll")).alias("abandonment"))
    return head.join(clicked, ["sid", "qid"], "full_outer").join(left, ["sid", "qid"], "full_outer")


def first_impressions(events: DataFrame, field) -> DataFrame:
    """The first impression of each (session, name, section)."""
    rows = events.where("type = 'impression' AND sid IS NOT NULL").select("sid", field("name").alias("name"), F.coalesce(field("section"), F.lit("other")).alias("section"), "at_ms", "id").where("name IS NOT NULL")
    return rows.groupBy("sid", "name", "section").agg(F.min(F.struct("at_ms", "id")).alias("f")).select("sid", "name", "section", F.col("f.id").alias("id"))


def rage_clicks(clicks: DataFrame, actor: str, element: str, at_ms: str, order: str, span_ms: int = 2000, least: int = 3) -> DataFrame:
    """Clicks that are at least the ``least``-th on one element in less than the span, without another element between. The
    form that starts counting anew after each alert is sequential: ``streaming.ingest.rage_click_alerts``."""
    w = Window.partitionBy(actor).orderBy(at_ms, order)
    run = clicks.withColumn("changed", F.coalesce((F.lag(element).over(w) != F.col(element)).cast("int"), F.lit(1))).withColumn("run", F.sum("changed").over(w))
    r = Window.partitionBy(actor, "run").orderBy(at_ms, order)
    return run.withColumn("before", F.lag(at_ms, least - 1).over(r)).where(F.col(at_ms) - F.col("before") < span_ms).drop("changed", "run", "before")


def reformulations(searches: DataFrame, session: str, query: str, at_ms: str, order: str, threshold: float = 0.3) -> DataFrame:
    """Searches whose words overlap those of the session's search before by more than the threshold."""
    w = Window.partitionBy(session).orderBy(at_ms, order)
    linked = searches.withColumn("previous", F.lag(query).over(w)).withColumn("previous_id", F.lag(order).over(w))
    return linked.withColumn("similarity", jaccard(F.col(query), F.col("previous"))).where(F.col("similarity") > threshold)


def attribute_clicks(events: DataFrame, field) -> DataFrame:
    """Each click with the session's last query before it (an as-of join by running last value)."""
    rows = events.where("type IN ('search', 'click') AND sid IS NOT NULL").select("sid", "type", "at_ms", "id", F.when(F.col("type") == "search", field("qid")).alias("qid"))
    w = Window.partitionBy("sid").orderBy("at_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("qid", F.last("qid", ignorenulls=True).over(w)).where("type = 'click' AND qid IS NOT NULL").select("id", "sid", "qid")


def recent(visits: DataFrame, actor: str, item: str, at: str, keep: int = 10) -> DataFrame:
    """The actor's last ``keep`` distinct items, newest first."""
    last = visits.groupBy(actor, item).agg(F.max(at).alias("at"))
    w = Window.partitionBy(actor).orderBy(F.desc("at"), item)
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def gap_sessions(events: DataFrame, actor: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions that end when an actor is silent for the gap."""
    grouped = events.groupBy(F.session_window(ts, gap).alias("w"), actor).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(actor, F.col("w.start").alias("start"), "n")


def pairs_in_sessions(first: DataFrame, chunk: int = 64) -> DataFrame:
    """``a, b`` (structs of item and pos, a.item < b.item) for all pairs of a session's rows ``session_id, item, pos``, one for each
    item. Sessions are cut into chunks of about ``chunk`` items before a list is built, and each pair of chunks is joined by
    itself, so a machine-like session is spread over the tasks."""
    sizes = first.groupBy("session_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("session_id", F.ceil(F.col("k") / chunk).cast("int").alias("parts"))
    placed = first.join(sizes, "session_id").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    chunks = placed.groupBy("session_id", "parts", "part").agg(F.collect_list(F.struct("item", "pos")).alias("s"))
    inside = chunks.where(F.size("s") > 1).select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b")).where("a.item < b.item")
    spread = chunks.where("parts > 1").select("session_id", "part", "s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).where("part <> other")
    spread = spread.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    keys = ["session_id", "low", "high"]
    left, right = spread.where("part < other").select(*keys, F.col("s").alias("l")), spread.where("part > other").select(*keys, F.col("s").alias("r"))
    across = left.join(right, keys).select("r", F.explode("l").alias("x")).select("x", F.explode("r").alias("y"))
    forward = F.col("x.item") < F.col("y.item")
    return inside.unionByName(across.select(F.when(forward, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(forward, F.col("y")).otherwise(F.col("x")).alias("b")))


def item_pairs(sequences: DataFrame, least: int = 2) -> DataFrame:
    """Co-occurrence edges by (item_a < item_b): sessions with both, and the mean distance of their first places.

    Items below the support can't be in a kept pair and are removed first.
    """
    names = F.transform(F.filter("item_sequence", lambda i: F.lower(F.trim(i["name"])) != ""), lambda i: F.lower(F.trim(i["name"])))
    rows = sequences.where("session_id IS NOT NULL").select("session_id", F.posexplode(names).alias("pos", "item"))
    first = rows.groupBy("session_id", "item").agg(F.min("pos").alias("pos"))
    often = first.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("item")
    pairs = pairs_in_sessions(first.join(often, "item", "left_semi"))
    edges = pairs.groupBy(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b")).agg(F.count(F.lit(1)).alias("coview_count"), F.round(F.avg(F.abs(F.col("a.pos") - F.col("b.pos"))), 4).alias("avg_distance"))
    return edges.where(F.col("coview_count") >= least)


def visible_spans(events: DataFrame, actor: str, at_ms: Column, opens: Column, order: str) -> DataFrame:
    """Dwell from opening events: each runs until the actor's next event; spans of a second or less don't count."""
    w = Window.partitionBy(actor).orderBy("t", order)
    spans = events.withColumn("t", at_ms).withColumn("next", F.lead("t").over(w)).where(opens)
    return spans.withColumn("dwell_ms", F.col("next") - F.col("t")).where("dwell_ms > 1000")


def reading_ratio(dwell_ms: Column, words: Column, mode: str = "intended") -> Column:
    """Time spent as a share of the time to read ``words`` at 238 a minute; ``mode="reference"`` has the reference's unit slip."""
    expected = words / 238.0 * 60 if mode == "intended" else words / 238.0 / 60
    return F.round(dwell_ms / 1000 / expected, 2)
