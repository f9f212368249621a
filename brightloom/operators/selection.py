"""Labels, curation and assembled selections: what turns clusters and lists into rows to show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import keyword_matches


def top_values(items: DataFrame, group: str, values: Column, limit: int) -> DataFrame:
    """``group, value, n, rank``: the commonest values of each group, ties by value."""
    counts = items.select(group, F.explode(values).alias("value")).groupBy(group, "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def labels(tops: DataFrame, group: str, parts: int = 2) -> DataFrame:
    """A label of each group from its commonest values: the last part after ``>``, in title case, joined by an ampersand."""
    clean = F.initcap(F.trim(F.element_at(F.split("value", ">"), -1)))
    picked = tops.where(F.col("rank") <= parts).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", clean.alias("l")))).alias("ls"))
    return picked.select(group, F.array_join(F.array_distinct(F.transform("ls", lambda s: s["l"])), " & ").alias("label"))


#: Words that make a label generic.
GENERIC = ("insights", "techniques", "analysis", "overview", "framework", "methods", "approaches", "strategies", "resources", "tools")


def is_generic(label: Column, terms: tuple[str, ...] = GENERIC, least: int = 2) -> Column:
    """Whether a label has at least ``least`` generic words."""
    low = F.lower(label)
    return reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in terms]) >= least


def is_good_name(name: Column, banned: tuple[str, ...] = ()) -> Column:
    """A name of 3 characters or more, two to six words, and none of the banned terms."""
    words = F.size(F.filter(F.split(F.trim(name), "\\s+"), lambda w: w != ""))
    low = F.lower(name)
    return F.coalesce((F.length(F.trim(name)) >= 3) & words.between(2, 6) & ~reduce(lambda a, b: a | b, [low.contains(t) for t in banned], F.lit(False)), F.lit(False))


def display_order(clusters: DataFrame) -> DataFrame:
    """``cluster_id`` from 0 in the order: diverse technical, other diverse, homogeneous technical, other homogeneous, career; larger first.

    Columns: label, size, kinds (number of types), technical, career. Clusters are few; the order is over them alone."""
    place = F.when(F.col("career"), 4).when((F.col("kinds") > 1) & F.col("technical"), 0).when(F.col("kinds") > 1, 1).when(F.col("technical"), 2).otherwise(3)
    return clusters.withColumn("priority", place).withColumn("cluster_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("priority", F.desc("size"), "label")) - 1)


def curation_score(label: Column, size: Column, kinds: Column, top_scores: Column, lowered: tuple[str, ...], raised: tuple[str, ...]) -> Column:
    """Worth of a cluster for the front page, without the reference's random part."""
    low = F.lower(label)
    has = lambda terms: reduce(lambda a, b: a | b, [low.contains(t) for t in terms], F.lit(False))
    bonus = F.aggregate(F.slice(F.sort_array(top_scores, asc=False), 1, 5), F.lit(0.0), lambda s, x: s + x * 50)
    return F.when(has(lowered), -50).otherwise(0) + F.when(has(raised), 30).otherwise(0) + F.when(size.between(10, 50), 10).when(size > 100, -5).otherwise(0) + F.when(kinds == 1, -20).otherwise(0) + bonus


def shuffled(items: DataFrame, key: str, seed: int) -> DataFrame:
    """Items with a place in a seeded order that doesn't depend on the cluster."""
    return items.withColumn("place", F.xxhash64(F.lit(seed), key))


def page(items: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of an order."""
    return items.orderBy(*order).offset(number * size).limit(size)


def carousel(items: DataFrame, text: Column, keywords: list[str], kind: str, key: str, least: int = 1, low: int = 4, high: int = 8) -> DataFrame:
    """Items that match a theme: most matches first, kinds in turn, at most ``high``; nothing if there are fewer than ``low``."""
    found = keyword_matches(items, text, keywords, least)
    w = Window.partitionBy(kind).orderBy(F.desc("matches"), key)
    turn = found.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= high)
    picked = turn.orderBy("turn", F.desc("matches"), key).limit(high)
    return picked.where(picked.agg(F.count(F.lit(1))).scalar() >= low)


def next_topics(topics: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Topics not covered yet; all of them once every one is."""
    left = topics.join(covered, key, "left_anti")
    none_left = left.agg(F.count(F.lit(1)) == 0).scalar()
    flagged = topics.join(covered.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    return flagged.where(F.col("_done").isNull() | none_left).drop("_done")


def inject_scores(items: DataFrame, scores: DataFrame, name: str, score: str) -> DataFrame:
    """Scores by lower-case name, 0 where there is none."""
    s = scores.select(F.lower(F.trim(name)).alias("_k"), F.col(score).alias("model_score")).groupBy("_k").agg(F.max("model_score").alias("model_score"))
    return items.withColumn("_k", F.lower(F.trim(name))).join(s, "_k", "left").withColumn("model_score", F.coalesce("model_score", F.lit(0.0))).drop("_k")


def consolidate(value: Column, mapping: dict[str, str]) -> Column:
    """A value mapped by a fixed table, in title case where it isn't in it."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(table[F.lower(F.trim(value))], F.initcap(F.trim(value)))


def candidate_names(lines: Column) -> Column:
    """Name at the start of a bullet line: two to four capitalised words before a comma, dash or bracket."""
    found = F.regexp_extract(lines, "^\\s*[-*•]\\s*\\**((?:\\p{Lu}[\\p{L}.'-]*\\s+){1,3}\\p{Lu}[\\p{L}'-]+)\\**\\s*(?:[,(–-]|$)", 1)
    return F.nullif(found, F.lit(""))


def rolling_hash(text: Column) -> Column:
    """The 32-bit string hash h = 31 h + c, in base 36 without sign."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))
    return F.lower(F.conv(F.abs(total).cast("string"), 10, 36))


def compact(number: Column) -> Column:
    """1,234 as 1.2K and 1,234,567 as 1.2M."""
    return F.when(number >= 1_000_000, F.concat(F.format_number(number / 1_000_000, 1), F.lit("M"))).when(number >= 1000, F.concat(F.format_number(number / 1000, 1), F.lit("K"))).otherwise(number.cast("string"))


def seconds_text(ms: Column) -> Column:
    """Milliseconds as ``75s`` or ``2m 5s``."""
    s = F.floor(ms / 1000)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
