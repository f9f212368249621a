"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import copies, mixing, names, packing, pairs, stuffing, tokens, variety


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows typed for one person and spellings of one organisation."""
    sheet, lights = table(spark, sf_dir, "collection_sheet"), table(spark, sf_dir, "leading_lights")
    spelled = cut(names.companies(sheet.select(F.col("current_company").alias("spelling")).unionByName(lights.select(F.col("company").alias("spelling")))), "spelled")
    members = cut(names.persons(sheet, spelled), "members")
    people = names.person_pairs(members)
    voted = cut(names.vote(spelled, members), "voted")
    return people.select(F.lit("person").alias("kind"), "key_a", "key_b").unionByName(names.company_pairs(voted).select(F.lit("company").alias("kind"), "key_a", "key_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items in 8 sessions or more and 6 times as often as independent items would be."""
    found = pairs.frequent_pairs(table(spark, sf_dir, "session_sequences"), min_support=8, min_lift=6.0)
    return found.where("n_ab >= 8 AND n_ab * n_sessions >= 6 * n_a * n_b").select("item_a", "item_b")


def p2_pair_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, lift, expectation under the fitted null and q-value of the pairs with false-discovery rate 1 %."""
    found = pairs.pair_surprise(table(spark, sf_dir, "session_sequences"), min_support=1, min_lift=0.0)
    return found.where("q_value <= 0.01")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of an earlier record."""
    return copies.copies(table(spark, sf_dir, "datasets_archive"))


def p5_unique_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, with its number of copies."""
    return copies.unique_records(table(spark, sf_dir, "datasets_archive"))


def p6_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Varied subsets of 50, 200 and 1,000 records."""
    return variety.varied_subsets(table(spark, sf_dir, "datasets_archive"), [50, 200, 1000])


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each subset: records, categories and lead tags covered, and the share of the largest category."""
    chosen = p6_subset(spark, sf_dir)
    by = chosen.groupBy("size", "category").agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("size").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("categories"), (F.max("n") / F.sum("n")).alias("largest_share"))
    return top.join(chosen.groupBy("size").agg(F.countDistinct("lead_tag").alias("lead_tags")), "size")


def _profiles(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [(r[0], r[1]) for r in table(spark, sf_dir, "pack_limits").orderBy("profile").collect()]  # a table of fixed size


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of all documents, for each profile on its own."""
    counted = tokens.token_counts(table(spark, sf_dir, "documents"))
    return packing.pack(counted, _profiles(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p7_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused capacity by profile."""
    return packing.utilisation(p7_packing(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


def _mixture(spark: SparkSession, sf_dir: str, totals: list[int | None]) -> list:
    counted = cut(tokens.token_counts(table(spark, sf_dir, "documents"), keep=("source",)), "counted")
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "source_targets").collect()}  # a table of fixed size
    if -1 in totals:
        corpus = counted.where(F.col("source").isin(list(targets))).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        totals = [corpus if t == -1 else t for t in totals]
    return [mixing.mix(counted, targets, t) for t in totals]


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture in which every source has its target share: documents and how often each is used."""
    return _mixture(spark, sf_dir, [None])[0][0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached, for the largest mixture that meets all targets and for one as large as the corpus (where some can't be met)."""
    out = []
    for mode, (rows, plans) in zip(("all targets met", "size of the corpus"), _mixture(spark, sf_dir, [None, -1])):
        total = sum(p.tokens for p in plans.values())
        got = rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
        goal = spark.createDataFrame([(k, p.share, p.budget, total) for k, p in plans.items()], "source string, target_share double, budget bigint, total bigint")
        tokens_used = F.coalesce("tokens", F.lit(0))
        out.append(goal.join(got, "source", "left").select(F.lit(mode).alias("mode"), "source", "target_share", "budget", tokens_used.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), (tokens_used / F.col("total")).alias("share"), (tokens_used >= F.col("budget")).alias("met")))
    return out[0].unionByName(out[1])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly keywords, links or tags."""
    return stuffing.flag_stuffed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_pair_surprise": p2_pair_surprise, "p5_found": p5_found, "p5_unique_records": p5_unique_records, "p6_subset": p6_subset, "p6_coverage": p6_coverage, "p7_packing": p7_packing, "p7_utilisation": p7_utilisation, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found}

_URL = r"regexp_replace(nfc_normalize(lower(url)), '[\s\p{Z}\p{C}]+', '', 'g')"
_KEYS = rf"""
    r AS (SELECT record_id, name, url,
                 array_to_string(list_sort(regexp_extract_all(regexp_replace(nfc_normalize(lower(name)), '[\x{{00AD}}\x{{2019}}\x{{02BC}}''`´]', '', 'g'), '[\p{{L}}\p{{N}}\p{{M}}]+')), ' ') AS nk,
                 regexp_replace(regexp_replace({_URL}, '^https?://', ''), '^www\.', '') AS u FROM datasets_archive),
    k AS (SELECT record_id, name, url, nk, CASE WHEN u IS NULL THEN NULL ELSE regexp_replace(split_part(u, '?', 1), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g') || '?' ||
                 coalesce(array_to_string(list_sort(list_filter(list_transform(string_split(CASE WHEN contains(u, '?') THEN substr(u, instr(u, '?') + 1) ELSE '' END, '&'),
                 lambda p: regexp_replace(p, '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')), lambda p: p <> '')), '&'), '') END AS uk FROM r),
    g AS (SELECT *, min(record_id) OVER (PARTITION BY nk, uk) AS keep_id, count(*) OVER (PARTITION BY nk, uk) AS copies FROM k)"""

SQL = {
    "p2_found": """
        WITH s AS (SELECT DISTINCT session_id, lower(trim(i.name, ' ')) AS item FROM (SELECT session_id, unnest(item_sequence) AS i FROM session_sequences WHERE session_id IS NOT NULL)
                   WHERE lower(trim(i.name, ' ')) <> ''),
        n AS (SELECT item, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM s a JOIN s b ON a.session_id = b.session_id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 8)
        SELECT item_a, item_b FROM p JOIN n x ON x.item = item_a JOIN n y ON y.item = item_b
        WHERE n_ab * (SELECT count(DISTINCT session_id) FROM s) >= 6 * x.n * y.n""",
    "p5_found": f"WITH {_KEYS} SELECT keep_id, record_id AS copy_id FROM g WHERE record_id <> keep_id",
    "p5_unique_records": f"WITH {_KEYS} SELECT record_id, name, url, copies FROM g WHERE record_id = keep_id",
}
