"""Engagement scoring, hybrid ranking and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import ENGAGEMENT, composite, ctr, log_popularity, scale, wilson
from ..session import cut
from .analytics import field


def signals(events: DataFrame, dwell: DataFrame, sequences: DataFrame) -> DataFrame:
    """The 13 signal counters of each item (by item identity), in one pass per source and one grouping over all."""
    name = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    page = F.regexp_replace(F.element_at(F.split(F.btrim(F.col("page"), F.lit("/")), "/"), -1), "[-_]", " ")
    on_page = F.when(F.size(F.split(F.btrim(F.col("page"), F.lit("/")), "/")) >= 2, F.lower(page))
    by_payload = F.when(F.col("type") == "search_click", name(field("resultId"))).otherwise(name(field("name")))
    kind, milestone = field("type"), field("milestone").cast("int")
    signal = (
        F.when((F.col("type") == "click") & (kind == "card"), "clicks")
        .when(F.col("type") == "impression", "impressions")
        .when(F.col("type") == "search_click", "search_clicks")
        .when((F.col("type") == "scroll_milestone") & milestone.isin(50, 75, 90), F.concat(F.lit("scroll_"), milestone.cast("string")))
        .when((F.col("type") == "frustration") & (kind == "rage_click"), "rage_clicks")
        .when((F.col("type") == "frustration") & (kind == "quick_bounce"), "quick_bounces")
    )
    at_page = F.col("type").isin("scroll_milestone", "frustration")
    told = events.where(F.col("type").isin("click", "impression", "search_click", "scroll_milestone", "frustration"))  # no other type has a signal
    from_events = told.select(F.when(at_page, on_page).otherwise(by_payload).alias("item"), signal.alias("signal"), F.lit(1.0).alias("value"))
    spent = dwell.where("dwell_ms BETWEEN 1 AND 86400000").select(name("name").alias("item"), F.explode(F.array(F.struct(F.lit("dwell_minutes").alias("signal"), (F.col("dwell_ms") / 60000.0).alias("value")), F.struct(F.lit("viewable_seconds").alias("signal"), F.coalesce("viewable_seconds", F.lit(0.0)).alias("value")))).alias("s")).select("item", "s.signal", "s.value")
    deep = sequences.where("duration_ms >= 120000").select(F.explode(F.array_distinct(F.transform("item_sequence", lambda i: F.lower(F.trim(i["name"]))))).alias("item")).select(F.nullif("item", F.lit("")).alias("item"), F.lit("deep_sessions").alias("signal"), F.lit(1.0).alias("value"))
    rows = from_events.unionByName(spent).unionByName(deep).where("item IS NOT NULL AND signal IS NOT NULL")
    return rows.groupBy("item").pivot("signal", list(ENGAGEMENT)).agg(F.sum("value")).na.fill(0.0)


def with_cooccurrence(signals_: DataFrame, edges: DataFrame) -> DataFrame:
    """Signals with each pair's co-views added to both of its ends."""
    ends = edges.select(F.explode(F.array("item_a", "item_b")).alias("item"), "coview_count").groupBy("item").agg(F.sum("coview_count").cast("double").alias("c"))
    return signals_.join(ends, "item", "left").withColumn("coviews", F.col("coviews") + F.coalesce("c", F.lit(0.0))).drop("c")


def engagement(signals_: DataFrame) -> DataFrame:
    """``item, raw``: the weighted sum of the signals, at least 0."""
    total = reduce(lambda s, kv: s + F.col(kv[0]) * kv[1], ENGAGEMENT.items(), F.lit(0.0))
    return signals_.withColumn("raw", F.greatest(F.lit(0.0), total))


def normalised(df: DataFrame, value: str, out: str) -> DataFrame:
    """A column scaled over all rows; the two bounds are a scalar subquery instead of a window over everything. The rows are
    read twice: give a written table where they are costly."""
    bounds = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("b")).scalar()
    return df.withColumn("_b", bounds).withColumn(out, scale(F.col(value), F.col("_b.low"), F.col("_b.high"))).drop("_b")


def running(df: DataFrame, order: list, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before a row in the given order, without one task that sorts all: rows
    are range-partitioned, summed by partition, and summed within theirs on top of what stands before."""
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_v", value), "running")
    sums = placed.groupBy("_part").agg(F.sum("_v").alias("_s"))  # one row per partition
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0))).select("_part", "_before")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.coalesce(F.sum("_v").over(inside), F.lit(0)) + F.col("_before")).drop("_part", "_v", "_before")


def ranked(df: DataFrame, score: str, key: str) -> DataFrame:
    """Ranks 1..n by score, ties by key."""
    return running(df, [F.desc(score), F.asc(key)], F.lit(1), "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def hybrid(observed: DataFrame, predicted: DataFrame, key: str = "item") -> DataFrame:
    """Observed items keep their scaled score, cold ones get 0.3 of their scaled prediction; scaled again together."""
    actual = normalised(cut(observed.where("raw > 0").select(key, "raw"), "observed"), "raw", "actual")
    guess = normalised(cut(predicted.select(key, "prediction"), "predicted"), "prediction", "guess")
    both = guess.join(actual.select(key, "actual"), key, "left")
    both = both.withColumn("cold_start", F.col("actual").isNull()).withColumn("mixed", F.coalesce("actual", 0.3 * F.col("guess")))
    return normalised(both, "mixed", "score").select(key, "score", "cold_start")


def click_rates(clicks: DataFrame, shown: DataFrame) -> DataFrame:
    """Clicks and impressions of each (name, section), whichever side has it; missing ones are 0."""
    return clicks.select("name", "section", "clicks").join(shown, ["name", "section"], "full_outer").na.fill(0, ["clicks", "impressions"])


def section_rates(rates: DataFrame) -> DataFrame:
    """Clicks over impressions by section."""
    return rates.groupBy("section").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")).withColumn("ctr", F.col("clicks") / F.greatest("impressions", F.lit(1)))


def rate_scores(rates: DataFrame) -> DataFrame:
    """Click rate, Wilson bound and log popularity of each row."""
    averages = section_rates(rates).select("section", F.col("ctr").alias("average"))
    joined = rates.join(averages, "section")
    return joined.select("name", "section", "clicks", "impressions", ctr(F.col("clicks"), F.col("impressions"), F.col("average")).alias("ctr"), wilson(F.col("clicks"), F.col("impressions")).alias("confidence"), log_popularity(F.col("clicks")).alias("popularity"))


def composite_rank(rates: DataFrame, dwell: DataFrame) -> DataFrame:
    """The composite engagement score: rates, summed dwell and viewable time (scaled over all), popularity, confidence."""
    scored = rate_scores(rates)
    spent = normalised(normalised(dwell, "dwell_ms", "dwell"), "viewable_seconds", "viewable").select("name", "section", "dwell", "viewable")
    scored = normalised(normalised(scored, "ctr", "ctr_n"), "popularity", "pop_n")
    joined = scored.join(spent, ["name", "section"], "left")
    return joined.withColumn("score", composite(F.col("ctr_n"), F.col("dwell"), F.col("viewable"), F.col("pop_n"), F.col("confidence")))


def category_rollup(items: DataFrame, kind: str, category: str, score: str) -> DataFrame:
    """Total, mean and largest score, items and items with a score, by kind and category."""
    return items.groupBy(kind, category).agg(F.round(F.sum(score), 8).alias("total"), F.round(F.avg(score), 8).alias("mean"), F.round(F.max(score), 8).alias("best"), F.count(F.lit(1)).alias("items"), F.count_if(F.col(score) > 0).alias("engaged"))


def coverage(signals_: DataFrame, items: int | Column) -> DataFrame:
    """Items with each signal and their share of all items, in percent with one decimal."""
    counts = signals_.agg(*[F.count_if(F.col(c) != 0).alias(c) for c in ENGAGEMENT])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("items")) for c in ENGAGEMENT])).alias("s")).select("s.*")
    return long.withColumn("pct", F.round(100.0 * F.col("items") / (F.lit(items) if isinstance(items, int) else items), 1))


def auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """ROC-AUC by rank sums with ties shared. Distinct scores are pre-aggregated; only those are ranked."""
    by = df.groupBy(score).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("q"))
    below = running(by, [F.asc(score)], F.col("q"), "below")
    wins = below.agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("wins"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return wins.select((F.col("wins") / (F.col("np") * F.col("nq"))).alias("auc"), F.col("np").alias("positives"), F.col("nq").alias("negatives"))
