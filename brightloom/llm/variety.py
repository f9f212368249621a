"""Choosing a varied subset: minimum-cost flow quotas over category combinations.

1. Copies that differ in formatting count once (``copies.unique_records``). A record's lead tag is its rarest
   topic tag in the corpus, so common tags don't swallow the records that make the data varied.
2. Records are counted by (category, lead tag). One unit of flow per chosen record runs source -> category -> (category,
   lead tag) -> lead tag -> sink. The middle edges hold the counts as capacities; the u-th unit through a category or a
   tag costs u / target, so use beyond the balanced target is punished convexly and the cheapest flow is the most
   balanced one that the data allow. Successive shortest paths give it exactly.
3. Quotas are filled by a deterministic rank: first the first record of each set of tags, in the order of a seeded
   hash, then the second ones, and so on. Ranks are limited to the subset's size before the shuffle, so a hot
   combination sends no more than that from a task.

The driver sees one row per combination, of each category at most as many tags as the largest subset has records. No more
can matter: were a unit to run through a tag beyond those, one of the category's kept tags would be unused, as fewer
other units than that exist, and would cost no more. Targets count all tags.

Defined cases: null or blank category and tags are a category and a tag of their own, "(none)"; spellings of them are
compared without case, dashes and outer blanks; if there are fewer records than asked for, all are chosen; repeated
rows count once; an empty table gives an empty subset.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .copies import unique_records


def quotas(counts: dict[tuple[str, str], int], size: int, tags_in_all: int | None = None) -> dict[tuple[str, str], int]:
    """How many records to take of each (category, tag), by successive shortest paths. ``tags_in_all`` is the number of tags
    of the corpus where ``counts`` lists fewer."""
    categories, tags = (sorted({key[i] for key in counts}) for i in (0, 1))
    ci, ti = ({k: i for i, k in enumerate(names)} for names in (categories, tags))
    room = np.zeros((len(categories), len(tags)), np.int32)
    for (c, t), n in counts.items():
        room[ci[c], ti[t]] = min(n, size)
    flow = np.zeros_like(room)
    used_c, used_t = np.zeros(len(categories)), np.zeros(len(tags))
    target_c, target_t = size / max(1, len(categories)), size / max(1, tags_in_all or len(tags))
    for _ in range(min(size, int(sum(counts.values())))):
        cost_c, cost_t = (used_c + 0.5) / target_c, (used_t + 0.5) / target_t
        seen_c, seen_t = np.zeros(len(categories), bool), np.zeros(len(tags), bool)
        from_c, from_t = np.full(len(tags), -1), np.full(len(categories), -1)
        best, end, least = np.inf, -1, cost_t.min()
        for root in np.argsort(cost_c, kind="stable"):
            if cost_c[root] + least >= best - 1e-12:
                break
            if seen_c[root]:
                continue
            seen_c[root], queue = True, [root]
            while queue and best > cost_c[root] + least + 1e-12:  # no path of this root is shorter than that
                c = queue.pop()
                new = np.flatnonzero((flow[c] < room[c]) & ~seen_t)
                if not len(new):
                    continue
                seen_t[new], from_c[new] = True, c
                t = new[np.argmin(cost_t[new])]
                if cost_c[root] + cost_t[t] < best - 1e-12:
                    best, end = cost_c[root] + cost_t[t], t
                busy = new[used_t[new] > 0]
                through = flow[:, busy] > 0
                for other in np.flatnonzero(through.any(1) & ~seen_c):
                    seen_c[other], from_t[other] = True, busy[np.argmax(through[other])]
                    queue.append(other)
        if end < 0:
            break
        used_t[end] += 1
        t = end
        while True:
            c = from_c[t]
            flow[c, t] += 1
            if from_t[c] < 0:
                used_c[c] += 1
                break
            t = from_t[c]
            flow[c, t] -= 1
    return {(categories[c], tags[t]): int(flow[c, t]) for c, t in zip(*np.nonzero(flow))}


def _label(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(text), "[\\s_-]+", " ")), F.lit("")), F.lit("(none)"))


def varied_subsets(records: DataFrame, sizes: list[int], id_col: str = "record_id", seed: int = 17) -> DataFrame:
    """``size, record_id, category, lead_tag, place``: for every size, that many records (or all, if there are fewer)."""
    largest = max(sizes)
    tags = F.array_sort(F.array_distinct(F.transform(F.coalesce("topic_tags", F.array().cast("array<string>")), _label)))
    shaped = records.select(F.col(id_col).alias("id"), _label(F.col("category")).alias("category"), F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("(none)"))).alias("tags"))
    kept = unique_records(records, id_col).select(F.col("record_id").alias("id"))
    once = cut(shaped.join(kept, "id", "left_semi").dropDuplicates(["id"]), "once")
    frequency = once.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    lead = once.select("id", F.explode("tags").alias("tag")).join(frequency, "tag").groupBy("id").agg(F.min(F.struct("n", "tag"))["tag"].alias("lead_tag"))
    placed = once.join(lead, "id")
    placed = cut(placed.withColumn("place", F.xxhash64(F.lit(seed), "id")), "placed")
    combinations = cut(placed.groupBy("category", "lead_tag").agg(F.count(F.lit(1)).alias("n")), "combinations")
    tags_in_all = combinations.select("lead_tag").distinct().count()
    some = combinations.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.xxhash64("lead_tag"), "lead_tag"))).where(F.col("k") <= largest)
    counts = {(r[0], r[1]): r[2] for r in some.select("category", "lead_tag", "n").collect()}  # at most `largest` of a category
    wanted = [(k, c, t, n) for k in sizes for (c, t), n in quotas(counts, k, tags_in_all).items()]
    again = Window.partitionBy("category", "lead_tag", "tags").orderBy("place", "id")
    within = Window.partitionBy("category", "lead_tag").orderBy("again", "place", "id")
    ranked = placed.withColumn("again", F.row_number().over(again)).where(F.col("again") <= largest)
    ranked = ranked.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= largest)
    quota = placed.sparkSession.createDataFrame(wanted, "size int, category string, lead_tag string, quota int")
    chosen = ranked.join(F.broadcast(quota), ["category", "lead_tag"]).where("rank <= quota")
    return chosen.select("size", F.col("id").alias(id_col), "category", "lead_tag", F.col("rank").alias("place"))
