"""Catalog preparation and quality: flattening, deduplication, validation, classification, merging, synchronisation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_match, normalise_url, slug_a


def numbered_slugs(items: DataFrame, name: str, prefix: Column, order: list[str]) -> DataFrame:
    """``slug``: prefix and name slug, with ``-1``, ``-2`` for repeats in the given order."""
    base = F.concat(prefix, F.lit("-"), slug_a(F.col(name)))
    w = Window.partitionBy("base").orderBy(*order)
    n = F.row_number().over(w) - 1
    return items.withColumn("base", base).withColumn("slug", F.when(n > 0, F.concat("base", F.lit("-"), n.cast("string"))).otherwise(F.col("base"))).drop("base")


def flatten(groups: DataFrame, outer: str, inner: str) -> DataFrame:
    """One row per innermost element of two nested arrays of structs; groups without any keep no row."""
    level = groups.select(*[c for c in groups.columns if c != outer], F.explode(outer).alias("_o"))
    fields = [f.name for f in level.schema["_o"].dataType.fields if f.name != inner]
    level = level.select(*[c for c in level.columns if c != "_o"], *[F.col(f"_o.{f}").alias(f"{outer}_{f}") for f in fields], F.explode(f"_o.{inner}").alias("_i"))
    return level.select(*[c for c in level.columns if c != "_i"], "_i.*")


def duplicates(items: DataFrame, key: Column, order: list[str], name: str) -> DataFrame:
    """Rows whose key an earlier row has, with the first row's name."""
    keyed = items.withColumn("_key", key).where(F.col("_key").isNotNull())
    first = keyed.groupBy("_key").agg(F.min_by(F.struct(F.col(name).alias("first_name"), F.struct(*order).alias("at")), F.struct(*order)).alias("_f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return keyed.join(first, "_key").where(F.struct(*order) != F.col("_f.at")).select(*items.columns, F.col("_f.first_name").alias("first_name"))


def missing_fields(items: DataFrame, id_col: str, required: list[str]) -> DataFrame:
    """``id, field``: one row for each required field that is null or blank."""
    tests = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required]
    return items.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*tests))).alias("field"))


def submission_errors(items: DataFrame) -> Column:
    """Error list of a submission (name, url, description, type)."""
    known = F.col("type").isin("package", "dataset", "learning", "paper", "talk", "book", "community")  # fixed values
    tests = [
        F.when(~F.coalesce(known, F.lit(False)), "unknown type"),
        F.when(F.coalesce(F.length(F.trim("name")), F.lit(0)) < 2, "name too short"),
        F.when(F.length("name") > 200, "name too long"),
        F.when(~F.coalesce(F.col("url").rlike("^https?://\\S+$"), F.lit(False)), "bad url"),
        F.when(F.length("description") > 1000, "description too long"),
    ]
    return F.array_compact(F.array(*tests))


def not_yet_listed(links: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """Links whose normalised url isn't listed, each url once (left anti join)."""
    new = links.withColumn("_u", normalise_url(F.col(url))).where("_u <> ''")
    old = listed.select(normalise_url(F.col(url)).alias("_u")).where("_u <> ''").distinct()
    return new.join(old, "_u", "left_anti").drop("_u")


def merge_by_priority(sources: list[DataFrame], key: Column, order: list[str]) -> DataFrame:
    """Union of sources in which the first source that has a key wins; ties by order."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).withColumn("_key", key)
    columns = [c for c in rows.columns if c not in ("_key",)]
    best = rows.groupBy("_key").agg(F.min_by(F.struct(*columns), F.struct("_source", *order)).alias("r"))
    return best.select("r.*")


def outer_merge(left: DataFrame, right: DataFrame, keys: list[str], zero: list[str]) -> DataFrame:
    """Full outer join on keys with zeros for what one side lacks."""
    return left.join(right, keys, "full_outer").na.fill(0, zero)


def like_join(items: DataFrame, patterns: DataFrame, text: str, default: str) -> DataFrame:
    """The label of the first pattern (by ``ord``) that a text contains. Patterns (``ord, pattern, label``) are a short
    fixed list, which is checked; each item tests them as one expression, so there is no join at all."""
    rules = patterns.orderBy("ord").limit(10_001).collect()
    if len(rules) > 10_000:
        raise ValueError("more patterns than a containment list can hold; join on words instead")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.filter(F.array(*[F.struct(F.lit(r["pattern"].lower()).alias("p"), F.lit(r["label"]).alias("l")) for r in rules]), lambda r: low.contains(r["p"]))
    return items.withColumn("label", F.coalesce(F.get(found, F.lit(0))["l"], F.lit(default)))


def keyword_matches(items: DataFrame, text: Column, keywords: list[str], least: int) -> DataFrame:
    """Items that contain at least ``least`` of the keywords, with the number of them."""
    low = F.lower(text)
    n = reduce(lambda a, b: a + b, [F.coalesce(low.contains(k), F.lit(False)).cast("int") for k in keywords])
    return items.withColumn("matches", n).where(F.col("matches") >= least)


def round_robin(items: DataFrame, kind: str, order: list[str], limit: int) -> DataFrame:
    """Takes kinds in turn, each kind in its own order; kinds come in the order of their first item."""
    w = Window.partitionBy(kind).orderBy(*order)
    turn = items.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    first = items.groupBy(kind).agg(F.min(F.struct(*order)).alias("first"))
    return turn.join(first, kind).orderBy("turn", "first").limit(limit).drop("first")


def round_robin_shifting(items: DataFrame, kind: str, order: str, limit: int) -> DataFrame:
    """The reference's variant: the list of kinds shrinks as they run out while the index goes on. Sequential, over at
    most ``limit`` items of each kind."""
    short = items.select(F.col(kind).alias("kind"), F.col(order).alias("ord")).withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("ord"))).where(F.col("r") <= limit).withColumn("one", F.lit(0))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        queues = {k: list(g["ord"]) for k, g in pdf.groupby("kind", sort=False)}
        kinds, at, out = list(queues), 0, []
        while kinds and len(out) < limit:
            k = kinds[at % len(kinds)]
            out.append(queues[k].pop(0))
            kinds = [x for x in kinds if queues[x]]
            at += 1
        return pd.DataFrame({"ord": out, "place": range(1, len(out) + 1)})

    return short.groupBy("one").applyInPandas(pick, "ord bigint, place int")


def interleave_thirds(ranked: DataFrame, rank: str, total: int) -> DataFrame:
    """Top, middle and bottom thirds of a ranking, taken in turn: position from rank by arithmetic."""
    third = -(-total // 3)
    part, inside = F.floor((F.col(rank) - 1) / third), (F.col(rank) - 1) % third
    return ranked.withColumn("part", part.cast("int")).withColumn("position", (inside * 3 + part).cast("int"))


def fill_down(lines: DataFrame, doc: str, pos: str, header: Column) -> DataFrame:
    """``header`` of the last line that had one, carried down within a document."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("header", F.last(header, ignorenulls=True).over(w))


def needs_update(items: DataFrame, state: DataFrame, key: str, hash_: Column, version: str) -> DataFrame:
    """Items that are new, changed, or of an older schema version."""
    joined = items.withColumn("hash", hash_).join(state.select(key, F.col("hash").alias("old_hash"), F.col("version").alias("old_version")), key, "left")
    reason = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("hash"), "changed").when(F.col("old_version") < version, "version")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").drop("old_hash", "old_version")


def apply_results(items: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Results joined back by key; a null result keeps the old value."""
    new = results.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = items.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def confidence(questions: Column, summary: Column, difficulty: Column, audience: Column, prerequisites: Column, kind: Column, special: dict[str, Column]) -> Column:
    """Quality of an enrichment: 1 less penalties, within [0, 1]. ``special`` names the list that items of a type must have."""
    advanced = F.exists(F.coalesce(prerequisites, F.array().cast("array<string>")), lambda p: F.regexp_like(F.lower(p), F.lit("phd|research|advanced|expert")))
    lacking = F.lit(False)
    for name, column in special.items():
        lacking = lacking | (F.coalesce(kind == name, F.lit(False)) & (F.coalesce(F.size(column), F.lit(0)) <= 0))
    n = F.coalesce(F.size(questions), F.lit(0))
    bad_audience = F.coalesce(~F.forall(audience, lambda a: a.isin("Early-PhD", "Junior-DS", "Mid-DS", "Senior-DS", "Curious-browser")), F.lit(False))
    score = (
        F.lit(1.0)
        - F.when(n <= 0, 0.3).when(n < 4, 0.15).otherwise(0.0)
        - F.when(F.coalesce(summary, F.lit("")) == "", 0.2).when(F.length(summary) < 50, 0.1).otherwise(0.0)
        - F.when(F.coalesce(difficulty.isin("beginner", "intermediate", "advanced"), F.lit(False)), 0.0).otherwise(0.2)
        - F.when(F.coalesce(F.size(audience), F.lit(0)) <= 0, 0.1).when(bad_audience, 0.15).otherwise(0.0)
        - F.when(F.coalesce(difficulty == "beginner", F.lit(False)) & F.coalesce(advanced, F.lit(False)), 0.1).otherwise(0.0)
        - F.when(lacking, 0.1).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def completeness(items: DataFrame, columns: list[str]) -> DataFrame:
    """``field, filled, share`` of each column."""
    counts = items.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("s")
    return counts.select("_n", rows).select("s.field", "s.filled", F.round(F.col("s.filled") / F.greatest("_n", F.lit(1)), 6).alias("share"))


def geocode(items: DataFrame, place: str, places: DataFrame) -> DataFrame:
    """Coordinates by exact name, else by containment either way, else by the part before a comma. Places are a short
    list, which is checked; an item tests them in one expression."""
    known = places.limit(10_001).collect()
    if len(known) > 10_000:
        raise ValueError("more places than a containment list can hold")
    low = F.lower(F.trim(F.col(place)))
    city = F.trim(F.split_part(low, F.lit(","), F.lit(1)))

    def grade(name: str) -> Column:
        return F.when(low == name, 3).when(low.contains(name) | F.lit(name).contains(low), 2).when(city == name, 1).otherwise(0)

    graded = F.array(*[F.struct(grade(p["place"].lower()).alias("grade"), F.lit(len(p["place"])).alias("size"), F.lit(p["place"].lower()).alias("place"), F.lit(p["lat"]).alias("lat"), F.lit(p["lng"]).alias("lng")) for p in known])
    best = F.array_max(graded)
    return items.withColumn("_g", F.when(best["grade"] > 0, best)).select(*items.columns, "_g.lat", "_g.lng")


def link_health(links: DataFrame, status: str = "status") -> DataFrame:
    """Counts by status and the share of checked links that work; 100 if none was checked."""
    counts = links.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("ok", "skipped", "timeout", "error")])
    checked = F.col("ok") + F.col("timeout") + F.col("error")
    return counts.withColumn("score", F.when(checked == 0, F.lit(100.0)).otherwise(F.round(100.0 * F.col("ok") / checked, 1)))


def classify(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """First rule with a keyword in the text."""
    return first_match(text, rules, default)


def eligible(people: DataFrame) -> DataFrame:
    """People with a doctorate who are verified and senior or professors."""
    return people.where(F.col("phd_institution").isNotNull() & (F.coalesce("is_senior", F.lit(False)) | F.coalesce("is_professor", F.lit(False))) & F.coalesce("verified", F.lit(False)))


def person_line(people: DataFrame) -> Column:
    """A description of a person from the parts that are known."""
    part = lambda pattern, c: F.when(F.trim(F.col(c)) != "", F.format_string(pattern, F.trim(F.col(c))))
    return F.concat_ws(", ", part("%s", "current_title"), part("at %s", "current_company"), part("PhD from %s", "phd_institution"), part("known for %s", "known_for"))


def likeness(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Ratio of matching blocks of two texts (2 x matches / total length), as an Arrow-batched function."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, s.lower(), t.lower()).ratio() if s and t else 0.0 for s, t in zip(x, y)])

    return pairs.withColumn("likeness", ratio(F.col(a), F.col(b)))


def best_title_match(wanted: DataFrame, known: DataFrame, threshold: float = 0.6, year_bonus: float = 0.15) -> DataFrame:
    """For each wanted title the known one of the same block (a first long word) that is most like it; an equal year
    adds a bonus. Both sides have ``id, title, year``."""
    block = lambda c: F.get(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 4), F.lit(0))
    a = wanted.select(F.col("id").alias("id_a"), F.col("title").alias("title_a"), F.col("year").alias("year_a"), block("title").alias("block"))
    b = known.select(F.col("id").alias("id_b"), F.col("title").alias("title_b"), F.col("year").alias("year_b"), block("title").alias("block"))
    scored = likeness(a.join(b, "block"), "title_a", "title_b").where(F.col("likeness") > threshold)
    score = F.round(F.col("likeness") + F.when(F.col("year_a") == F.col("year_b"), year_bonus).otherwise(0.0), 6)
    return scored.groupBy("id_a").agg(F.max_by(F.struct("id_b", score.alias("score")), F.struct(score, -F.col("id_b"))).alias("m")).select("id_a", "m.id_b", "m.score")


def unique_labels(labels: DataFrame, group: str, order: str, alternatives: Callable[[], Column]) -> DataFrame:
    """Labels made unique: the first keeps its label, later ones add their alternative, further clashes a number."""
    w = Window.partitionBy("label").orderBy(order)
    second = labels.withColumn("n", F.row_number().over(w)).withColumn("label2", F.when(F.col("n") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" ("), alternatives(), F.lit(")"))))
    w2 = Window.partitionBy("label2").orderBy(order)
    return second.withColumn("m", F.row_number().over(w2)).withColumn("unique_label", F.when(F.col("m") == 1, F.col("label2")).otherwise(F.concat("label2", F.lit(" "), F.col("m").cast("string")))).select(group, "unique_label")


def eligible_by_keywords(people: DataFrame, fields: tuple[str, ...], titles: tuple[str, ...]) -> DataFrame:
    """People whose doctoral field and title each contain one of the keywords."""
    has = lambda c, words: reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(w), F.lit(False)) for w in words])
    return people.where(has("phd_field", fields) & has("current_title", titles))


#: Defaults of the fields that a submission of each type gets.
SUBMISSION_DEFAULTS = {"package": {"language": "Python"}, "dataset": {"data_format": "CSV"}, "paper": {"citations": "0"}, "resource": {"level": "All"}}


def submission_record(forms: DataFrame, kind: str) -> DataFrame:
    """Submitted forms of one type in its catalog's shape: trimmed fields, defaults, tags from comma-separated text."""
    cols = [F.trim("name").alias("name"), F.coalesce(F.trim("description"), F.lit("")).alias("description"), F.trim("url").alias("url"), F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Other")).alias("category")]
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "").alias("tags")
    return forms.where(F.col("type") == kind).select("id", *cols, tags, *[F.lit(v).alias(k) for k, v in SUBMISSION_DEFAULTS.get(kind, {}).items()])


def card_filter(items: DataFrame, query: str, text: tuple[str, ...], equal: dict[str, str], always: dict[str, str] | None = None) -> DataFrame:
    """Items whose text contains the query and whose attributes are those chosen, without case; "all" chooses nothing.
    ``always`` gives attribute values that pass any choice."""
    tests = [reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False)) for c in text])] if query else []
    for c, v in equal.items():
        if v.lower() != "all":
            same = F.coalesce(F.lower(F.col(c)) == v.lower(), F.lit(False))
            tests.append(same | F.coalesce(F.lower(F.col(c)) == always[c].lower(), F.lit(False)) if always and c in always else same)
    return items.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def best_per_category(items: DataFrame, category: str, score: str, key: str) -> DataFrame:
    """Categories in the order of their best item's score, with that item."""
    return items.groupBy(category).agg(F.max(score).alias("best"), F.max_by(key, F.struct(F.col(score), -F.col(key))).alias("item")).orderBy(F.desc("best"), category)


def with_details(links: DataFrame, items: DataFrame, target: str, key: str) -> DataFrame:
    """Linked ids with the linked items' columns; links to unknown items are dropped."""
    return links.join(items.withColumnRenamed(key, target), target)
