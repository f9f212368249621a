"""Small catalog and session operators: links of guides, tags by keyword, rows with a hero, details with a fall-back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import csv_field
from .sessions import pairs_in_sessions


def keyword_tags(text: Column, category: Column, by_category: dict[str, str], by_keyword: dict[str, str], most: int = 4) -> Column:
    """The category's tag and those of the keywords in the text, in the order of the tables, each once, at most ``most``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    of_category = F.create_map(*[F.lit(x) for kv in by_category.items() for x in kv])[category]
    return F.slice(F.array_distinct(F.array_compact(F.array(of_category, *[F.when(low.contains(k), t) for k, t in by_keyword.items()]))), 1, most)


def guide_links(guides: DataFrame, domain: Column, parts: dict[str, str], domains: dict[str, str], default: str = "General") -> DataFrame:
    """``url, name, domain, category`` of all links in the arrays ``parts`` (array column: default category) of guides; the domain
    by a table or else the default. Links without url are left out."""
    of = F.coalesce(F.create_map(*[F.lit(x) for kv in domains.items() for x in kv])[domain], F.lit(default)).alias("domain")
    rows = [guides.select(of, F.explode(c).alias("l"), F.lit(category).alias("fallback")) for c, category in parts.items()]
    links = reduce(DataFrame.unionByName, [r.select(F.trim("l.url").alias("url"), F.col("l.title").alias("name"), "domain", F.coalesce("l.venue", "fallback").alias("category")) for r in rows])
    return links.where("url <> ''").distinct()


def with_inline(refs: DataFrame, items: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """References joined to their items; where the item or a value is missing the reference's own value stands."""
    known = items.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = refs.join(known, key, "left")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def hero_rows(items: DataFrame, row: str, score: str, key: str, least: float = 0.1) -> DataFrame:
    """Items of each row in the order of their scores; the first is the hero if its score is above ``least``."""
    place = F.row_number().over(Window.partitionBy(row).orderBy(F.desc(score), key))
    return items.withColumn("place", place).withColumn("hero", F.coalesce((F.col("place") == 1) & (F.col(score) > least), F.lit(False)))


def tool_order(items: DataFrame, docs: Column, code: Column, uses: Column, key: str, most: int) -> DataFrame:
    """Items with documentation first, then with code, then by the number of uses; at most ``most``."""
    return items.orderBy(docs.isNotNull().desc(), code.isNotNull().desc(), F.coalesce(F.size(uses), F.lit(0)).desc(), key).limit(most)


def shared_items(views: DataFrame, clicks: DataFrame) -> DataFrame:
    """``item_a < item_b, coview_count, coclick_count``: pairs of items viewed or clicked in one session (both tables have
    ``session_id, item, pos``, one row for each item of a session)."""
    count = lambda rows, out: pairs_in_sessions(rows).groupBy(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b")).agg(F.count(F.lit(1)).alias(out))
    both = count(views, "coview_count").join(count(clicks, "coclick_count"), ["item_a", "item_b"], "full_outer").na.fill(0, ["coview_count", "coclick_count"])
    return both.where("coview_count > 0 OR coclick_count > 0")


def pages_per_visit(views: DataFrame) -> DataFrame:
    """``views, visits, per_visit`` of page views: sessions counted exactly, the quotient to one decimal."""
    return views.agg(F.count(F.lit(1)).alias("views"), F.count_distinct("sid").alias("visits")).withColumn("per_visit", F.round(F.col("views") / F.greatest("visits", F.lit(1)), 1))


def csv_lines(rows: DataFrame, columns: list[str], order: list, limit: int = 10_000) -> DataFrame:
    """Rows as CSV lines in the given order, quoted only where needed; at most ``limit``."""
    return rows.orderBy(*order).limit(limit).select(F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in columns]).alias("line"))
