"""Queries of the catalog operators, over the archive, the people tables and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..session import table


def _archive(spark, sf_dir):
    return table(spark, sf_dir, "datasets_archive")


def _sheet(spark, sf_dir):
    return table(spark, sf_dir, "collection_sheet")


def _lights(spark, sf_dir):
    return table(spark, sf_dir, "leading_lights")


def slug(spark, sf_dir):
    rows = C.numbered_slugs(_archive(spark, sf_dir).where("name IS NOT NULL").select("record_id", "name"), "name", F.lit("dataset"), ["record_id"])
    return rows.select("record_id", "slug")


def flatten_nested(spark, sf_dir):
    regions, nations, customers = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    inner = customers.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("people"))
    middle = nations.join(inner, nations.n_nationkey == inner.c_nationkey).groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "people")).alias("nations"))
    nested = regions.join(middle, regions.r_regionkey == middle.n_regionkey).select("r_name", "nations")
    return C.flatten(nested, "nations", "people")


def nested_totals(spark, sf_dir):
    n = F.coalesce(F.size("papers"), F.lit(0))
    return _lights(spark, sf_dir).agg(F.count(F.lit(1)).alias("people"), F.sum(F.greatest(n, F.lit(0))).alias("papers"), F.sum(F.size(F.filter(F.coalesce("papers", F.array().cast("array<struct<title:string,year:int,venue:string,url:string>>")), lambda p: p["venue"].isNotNull()))).cast("long").alias("with_venue"))


def dup_urls(spark, sf_dir):
    return C.duplicates(_archive(spark, sf_dir).select("record_id", "name", "url"), T.normalise_url(F.col("url")), ["record_id"], "name").select("record_id", "first_name")


def url_normalise_antijoin(spark, sf_dir):
    a = _archive(spark, sf_dir).select("record_id", "url")
    return C.not_yet_listed(a.where("record_id % 2 = 0"), a.where("record_id % 2 = 1")).select("record_id")


def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def outer_merge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda flag, out: lines.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count(F.lit(1)).alias(out))
    return C.outer_merge(side("R", "returned"), side("A", "accepted"), ["l_partkey"], ["returned", "accepted"])


def priority_merge(spark, sf_dir):
    a = _archive(spark, sf_dir).where("name IS NOT NULL").select("record_id", "name", "source")
    merged = C.merge_by_priority([a.where("source IS NOT NULL"), a.where("source IS NULL")], F.lower(F.trim("name")), ["record_id"])
    return merged.select("record_id", "name", F.col("_source").alias("priority"))


RULES = [("survey", ("survey", "questionnaire", "poll")), ("register", ("register", "registry", "roster")), ("series", ("series", "index", "tracker", "monitor")), ("price", ("price", "fare"))]


def like_join(spark, sf_dir):
    patterns = spark.createDataFrame([(1, "weekly", "frequent"), (2, "daily", "frequent"), (3, "annual", "yearly"), (4, "historical", "old")], "ord int, pattern string, label string")
    return C.like_join(_archive(spark, sf_dir).select("record_id", "name"), patterns, "name", "other").select("record_id", "label")


def keyword_min_match(spark, sf_dir):
    text = F.concat_ws(" ", "name", "description")
    return C.keyword_matches(_archive(spark, sf_dir), text, ["price", "survey", "trade", "weekly", "panel"], 2).select("record_id", "matches")


def round_robin(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"))
    return C.round_robin(p, "kind", ["p_partkey"], 40).select("p_partkey", "kind", "turn")


def interleave(spark, sf_dir):
    from ..operators.ranking import ranked

    p = table(spark, sf_dir, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("score"))
    return C.interleave_thirds(ranked(p, "score", "s_suppkey"), "rank", p.count()).select("s_suppkey", "position", "part")


def header_filldown(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    filled = C.fill_down(lines, "doc_id", "pos", F.when(F.col("line").startswith("Question: "), F.substring("line", 11, 1 << 30)))
    return filled.where("header IS NOT NULL").groupBy("doc_id", "header").agg(F.count(F.lit(1)).alias("lines"))


def incremental_diff(spark, sf_dir):
    a = _archive(spark, sf_dir).select("record_id", "name", "description")
    state = a.where("record_id % 3 <> 0").select("record_id", F.when(F.col("record_id") % 5 == 0, "stale").otherwise(T.content_hash(F.col("name"), F.col("description"))).alias("hash"), F.when(F.col("record_id") % 7 == 0, "2.1").otherwise("2.2").alias("version"))
    return C.needs_update(a, state, "record_id", T.content_hash(F.col("name"), F.col("description")), "2.2").select("record_id", "reason")


def setops(spark, sf_dir):
    a = table(spark, sf_dir, "content_dwell").select(T.item_key(F.col("name")).alias("item")).where("item IS NOT NULL")
    b = table(spark, sf_dir, "session_sequences").select(F.explode("item_sequence").alias("i")).select(T.item_key(F.col("i.name")).alias("item")).where("item IS NOT NULL")
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "dwell only": a.exceptAll(b).distinct().join(b, "item", "left_anti"), "sequence only": b.subtract(a)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("items"), F.min("item").alias("first"))
        out = row if out is None else out.unionByName(row)
    return out


def urls(spark, sf_dir):
    u = F.col("url")
    return _archive(spark, sf_dir).select("record_id", T.host(u).alias("host"), T.root_domain(u).alias("root"), T.domain_class(u).alias("class"), T.normalise_url(u).alias("normal"))


def doi_extract(spark, sf_dir):
    text = F.concat(F.lit("see https://doi.org/10."), (F.col("p_partkey") + 1000).cast("string"), F.lit("/abc."), F.col("p_size").cast("string"), F.lit(";"))
    repo = F.concat(F.lit("https://github.com/org/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(".git"))
    return table(spark, sf_dir, "part").select("p_partkey", T.doi(text).alias("doi"), T.github_repo(repo).alias("repo"))


def submissions(spark, sf_dir):
    a = _archive(spark, sf_dir).select("record_id", "name", "url", "description", F.element_at(F.array(*[F.lit(t) for t in ("thing", "dataset", "learning", "resource", "career", "community")]), (F.col("record_id") % 6 + 1).cast("int")).alias("type"))
    return a.select("record_id", F.array_join(C.submission_errors(a), "; ").alias("errors")).where("errors <> ''")


def embed_text(spark, sf_dir):
    a = _archive(spark, sf_dir)
    return a.select("record_id", F.md5(T.embedding_text(F.col("name"), F.col("description"), F.col("category"), F.col("topic_tags"), F.col("tags"))).alias("digest"))


def enrichment_confidence(spark, sf_dir):
    a = _archive(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(t) for t in ("paper", "package", "dataset", "talk")]), (F.col("record_id") % 4 + 1).cast("int"))
    before = F.when(F.col("record_id") % 3 == 0, F.array(F.lit("Algebra"), F.lit("PhD seminar"))).when(F.col("record_id") % 3 == 1, F.array(F.lit("Algebra")))
    c = C.confidence(F.coalesce("topic_tags", F.array().cast("array<string>")), F.col("summary"), F.col("difficulty"), F.array(F.lit("Mid-DS")), before, kind, {"paper": F.col("tags"), "package": F.col("topic_tags"), "dataset": F.col("domain_tags")})
    return a.select("record_id", F.round(c, 4).alias("confidence"))


def people_lines(spark, sf_dir):
    return _sheet(spark, sf_dir).select("sheet_id", C.person_line(_sheet(spark, sf_dir)).alias("line"))


def geocode(spark, sf_dir):
    places = spark.createDataFrame([("Verradorn", 48.1, 2.0), ("Dravoport", 51.2, 0.1), ("Quilula", 40.4, -3.7), ("Norenne", 59.9, 10.7)], "place string, lat double, lng double")
    return C.geocode(_sheet(spark, sf_dir).where("location IS NOT NULL").select("sheet_id", "location"), "location", places).where("lat IS NOT NULL").select("sheet_id", "lat", "lng")


def link_health(spark, sf_dir):
    status = F.when(F.col("url").isNull(), "skipped").when(F.col("record_id") % 50 == 0, "timeout").when(F.col("record_id") % 33 == 0, "error").otherwise("ok")
    return C.link_health(_archive(spark, sf_dir).select(status.alias("status")))


def tags_from_fields(spark, sf_dir):
    a = _archive(spark, sf_dir)
    made = F.array_compact(F.array(F.lower("category"), F.lower("type"), F.lower("difficulty")))
    return a.select("record_id", F.array_join(F.slice(F.array_distinct(F.when(F.size(F.coalesce("topic_tags", F.array().cast("array<string>"))) == 0, made).otherwise(F.col("topic_tags"))), 1, 4), "|").alias("tags"))


def title_match(spark, sf_dir):
    papers = _lights(spark, sf_dir).select("slug", F.explode("papers").alias("p")).select(F.xxhash64("slug", "p.title").alias("id"), F.col("p.title").alias("title"), F.col("p.year").alias("year"))
    return C.best_title_match(papers, papers.withColumn("title", F.concat("title", F.lit(" (working paper)"))))


def submission_records(spark, sf_dir):
    a = _archive(spark, sf_dir)
    forms = a.select(F.col("record_id").alias("id"), "name", "description", "url", "category", F.array_join("tags", " , ").alias("tags"), F.lit("dataset").alias("type"))
    return C.submission_record(forms, "dataset").withColumn("tags", F.array_join("tags", "|"))


def more_like_this(spark, sf_dir):
    """Related vectors of some items with the details of what they relate to."""
    from ..operators.vectors import neighbours

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    details = v.where("label < 5").select("id", F.col("label").cast("int").alias("label"))
    return C.with_details(neighbours(v.where("id % 100 = 0"), v, 10, 0.0).select("src", "dst", "rank"), details, "dst", "id").select("src", "dst", "rank", "label")


QUERIES = {
    "submission_records": submission_records,
    "more_like_this": more_like_this,
    "people_by_keywords": lambda s, d: C.eligible_by_keywords(_sheet(s, d), ("econom", "statist"), ("professor", "scientist")).select("sheet_id"),
    "card_filter": lambda s, d: C.card_filter(_archive(s, d), "Survey", ("name", "description"), {"category": "trade", "type": "all", "difficulty": "beginner"}, {"difficulty": "intermediate"}).select("record_id"),
    "best_per_category": lambda s, d: C.best_per_category(table(s, d, "part"), "p_brand", "p_retailprice", "p_partkey").select("p_brand", F.round("best", 2).alias("best"), "item"),
    "slug": slug,
    "slug_variants": lambda s, d: _archive(s, d).where("name IS NOT NULL").select("record_id", T.slug_b(F.col("name")).alias("b"), T.slug_c(F.col("name")).alias("c")),
    "flatten_nested": flatten_nested,
    "nested_totals": nested_totals,
    "dup_urls": dup_urls,
    "validate_required": lambda s, d: C.missing_fields(_archive(s, d), "record_id", ["name", "url", "description", "category", "source"]),
    "url_normalise_antijoin": url_normalise_antijoin,
    "semi_join": semi_join,
    "outer_merge": outer_merge,
    "priority_merge": priority_merge,
    "classify_chain": lambda s, d: _archive(s, d).select("record_id", C.classify(F.col("name"), RULES, "other").alias("class")),
    "like_join": like_join,
    "keyword_min_match": keyword_min_match,
    "round_robin": round_robin,
    "interleave_thirds": interleave,
    "header_filldown": header_filldown,
    "incremental_diff": incremental_diff,
    "setops": setops,
    "path_to_name": lambda s, d: table(s, d, "analytics_events").select("id", T.path_to_name(F.regexp_replace("path", "[?#].*$", "")).alias("name")),
    "urls": urls,
    "doi_extract": doi_extract,
    "submissions": submissions,
    "embed_text": embed_text,
    "enrichment_confidence": enrichment_confidence,
    "completeness": lambda s, d: C.completeness(_sheet(s, d), ["name", "current_title", "current_company", "phd_institution", "phd_year", "phd_field", "twitter", "location", "notes"]),
    "eligible": lambda s, d: C.eligible(_sheet(s, d)).select("sheet_id"),
    "people_lines": people_lines,
    "geocode": geocode,
    "link_health": link_health,
    "tags_from_fields": tags_from_fields,
    "short_descriptions": lambda s, d: _archive(s, d).where(F.length("description") < 50).select("record_id", F.length("description").alias("n")),
    "title_match": title_match,
}

_SLUG = lambda c: rf"left(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 100)"
_NU = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(url, ' ')), '^https?://', ''), '^www\.', ''), '/+$', '')"
_FOLD = lambda c: rf"regexp_replace(strip_accents({c}), '[^\x00-\x7F]', '', 'g')"
_HOST = r"nullif(regexp_replace(regexp_extract(lower(trim(url, ' ')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '')"
_HASH = "left(sha256(coalesce(name, chr(0)) || '|' || coalesce(description, chr(0))), 16)"
_CLEAN = lambda c: f"nullif(trim({c}, ' '), '')"
_CONTAINS = lambda words: " OR ".join(f"contains(n, '{w}')" for w in words)
_TOKENS = ("price", "survey", "trade", "weekly", "panel")

SQL = {
    "submission_records": r"""SELECT record_id AS id, trim(name, ' ') AS name, coalesce(trim(description, ' '), '') AS description, trim(url, ' ') AS url, coalesce(nullif(trim(category, ' '), ''), 'Other') AS category,
        array_to_string(list_filter(list_transform(string_split(coalesce(array_to_string(tags, ' , '), ''), ','), lambda t: trim(t, ' ')), lambda t: t <> ''), '|') AS tags, 'CSV' AS data_format FROM datasets_archive""",
    "more_like_this": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings), s AS (SELECT a.id AS src, b.id AS dst, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda t: t[1] * t[2])), 3) AS s FROM v a, v b WHERE a.id <> b.id AND a.id % 100 = 0),
        k AS (SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS INTEGER) AS rank FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 10)
        SELECT src, dst, rank, CAST(label AS INTEGER) AS label FROM k JOIN v ON v.id = dst WHERE label < 5""",
    "people_by_keywords": "SELECT sheet_id FROM collection_sheet WHERE (contains(lower(phd_field), 'econom') OR contains(lower(phd_field), 'statist')) AND (contains(lower(current_title), 'professor') OR contains(lower(current_title), 'scientist'))",
    "card_filter": "SELECT record_id FROM datasets_archive WHERE (contains(lower(name), 'survey') OR coalesce(contains(lower(description), 'survey'), false)) AND lower(category) = 'trade' AND lower(difficulty) IN ('beginner', 'intermediate')",
    "best_per_category": "SELECT p_brand, round(max(p_retailprice), 2) AS best, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS item FROM part GROUP BY 1",
    "slug": f"WITH s AS (SELECT record_id, 'dataset-' || {_SLUG('name')} AS b FROM datasets_archive WHERE name IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY record_id) - 1 AS n FROM s) SELECT record_id, CASE WHEN n > 0 THEN b || '-' || n ELSE b END AS slug FROM n",
    "flatten_nested": "SELECT r_name, n_name AS nations_n_name, c_custkey, c_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey",
    "nested_totals": "SELECT count(*) AS people, CAST(sum(coalesce(len(papers), 0)) AS BIGINT) AS papers, CAST(sum(coalesce(len(list_filter(papers, lambda p: p.venue IS NOT NULL)), 0)) AS BIGINT) AS with_venue FROM leading_lights",
    "dup_urls": f"WITH k AS (SELECT record_id, name, {_NU} AS u FROM datasets_archive WHERE url IS NOT NULL), f AS (SELECT record_id, first_value(name) OVER w AS first_name, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY u ORDER BY record_id)) SELECT record_id, first_name FROM f WHERE n > 1",
    "validate_required": " UNION ALL ".join(f"SELECT record_id AS id, '{c}' AS field FROM datasets_archive WHERE {c} IS NULL OR trim({c}, ' ') = ''" for c in ("name", "url", "description", "category", "source")),
    "url_normalise_antijoin": f"WITH k AS (SELECT record_id, {_NU} AS u FROM datasets_archive WHERE url IS NOT NULL) SELECT record_id FROM k WHERE record_id % 2 = 0 AND u <> '' AND u NOT IN (SELECT u FROM k WHERE record_id % 2 = 1)",
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "outer_merge": """WITH r AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
        SELECT l_partkey, coalesce(r.n, 0) AS returned, coalesce(a.n, 0) AS accepted FROM r FULL JOIN a USING (l_partkey)""",
    "priority_merge": "SELECT record_id, name, CAST(source IS NULL AS INTEGER) AS priority FROM datasets_archive WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(trim(name, ' ')) ORDER BY source IS NULL, record_id) = 1",
    "classify_chain": "SELECT record_id, CASE " + " ".join(f"WHEN {_CONTAINS(w)} THEN '{label}'" for label, w in RULES) + " ELSE 'other' END AS class FROM (SELECT record_id, coalesce(lower(name), '') AS n FROM datasets_archive)",
    "like_join": "SELECT record_id, CASE WHEN contains(n, 'weekly') OR contains(n, 'daily') THEN 'frequent' WHEN contains(n, 'annual') THEN 'yearly' WHEN contains(n, 'historical') THEN 'old' ELSE 'other' END AS label FROM (SELECT record_id, coalesce(lower(name), '') AS n FROM datasets_archive)",
    "keyword_min_match": "SELECT * FROM (SELECT record_id, " + " + ".join(f"CAST(contains(n, '{w}') AS INTEGER)" for w in _TOKENS) + " AS matches FROM (SELECT record_id, lower(concat_ws(' ', name, description)) AS n FROM datasets_archive)) WHERE matches >= 2",
    "round_robin": """WITH k AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS kind FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p_partkey) AS turn, min(p_partkey) OVER (PARTITION BY kind) AS f FROM k)
        SELECT p_partkey, kind, CAST(turn AS INTEGER) AS turn FROM t ORDER BY turn, f LIMIT 40""",
    "interleave_thirds": """WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY round(s_acctbal, 2) DESC, s_suppkey) - 1 AS r, (count(*) OVER () + 2) // 3 AS t FROM supplier)
        SELECT s_suppkey, CAST((r % t) * 3 + r // t AS INTEGER) AS position, CAST(r // t AS INTEGER) AS part FROM r""",
    "header_filldown": r"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
        h AS (SELECT doc_id, last_value(CASE WHEN starts_with(line, 'Question: ') THEN substr(line, 11) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS header FROM l)
        SELECT doc_id, header, count(*) AS lines FROM h WHERE header IS NOT NULL GROUP BY 1, 2""",
    "incremental_diff": f"""WITH a AS (SELECT record_id, {_HASH} AS h FROM datasets_archive), s AS (SELECT record_id, CASE WHEN record_id % 5 = 0 THEN 'stale' ELSE h END AS o, CASE WHEN record_id % 7 = 0 THEN '2.1' ELSE '2.2' END AS v FROM a WHERE record_id % 3 <> 0),
        r AS (SELECT a.record_id, CASE WHEN o IS NULL THEN 'new' WHEN o <> h THEN 'changed' WHEN v < '2.2' THEN 'version' END AS reason FROM a LEFT JOIN s USING (record_id)) SELECT * FROM r WHERE reason IS NOT NULL""",
    "setops": """WITH a AS (SELECT DISTINCT lower(trim(name, ' ')) AS item FROM content_dwell WHERE lower(trim(name, ' ')) <> ''),
        b AS (SELECT DISTINCT lower(trim(i.name, ' ')) AS item FROM (SELECT unnest(item_sequence) AS i FROM session_sequences) WHERE lower(trim(i.name, ' ')) <> '')
        SELECT 'union' AS part, count(*) AS items, min(item) AS first FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'both', count(*), min(item) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
        UNION ALL SELECT 'dwell only', count(*), min(item) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'sequence only', count(*), min(item) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "path_to_name": r"WITH p AS (SELECT id, trim(regexp_replace(path, '[?#].*$', ''), '/') AS p FROM analytics_events) SELECT id, CASE WHEN contains(p, '/') THEN regexp_replace(lower(split_part(p, '/', -1)), '[-_]', ' ', 'g') END AS name FROM p",
    "urls": f"""WITH h AS (SELECT record_id, url, {_HOST} AS host FROM datasets_archive)
        SELECT record_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS root, CASE WHEN host IS NULL THEN 'none' ELSE 'other' END AS class, {_NU} AS normal FROM h""",
    "doi_extract": "SELECT p_partkey, '10.' || (p_partkey + 1000) || '/abc.' || p_size AS doi, 'org/' || replace(p_brand, '#', '-') AS repo FROM part",
    "submissions": r"""WITH e AS (SELECT record_id, concat_ws('; ', CASE WHEN record_id % 6 IN (0, 3, 4) THEN 'unknown type' END, CASE WHEN coalesce(length(trim(name, ' ')), 0) < 2 THEN 'name too short' END, CASE WHEN length(name) > 200 THEN 'name too long' END,
        CASE WHEN NOT coalesce(regexp_full_match(url, 'https?://\S+'), false) THEN 'bad url' END, CASE WHEN length(description) > 1000 THEN 'description too long' END) AS errors FROM datasets_archive) SELECT * FROM e WHERE errors <> ''""",
    "embed_text": f"""SELECT record_id, md5(concat_ws('. ', {_CLEAN('name')}, {_CLEAN('description')}, 'Category: ' || {_CLEAN('category')}, 'Topics: ' || {_CLEAN("CASE WHEN len(topic_tags) > 0 THEN array_to_string(topic_tags, ', ') END")},
        'Tags: ' || {_CLEAN("CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') END")})) AS digest FROM datasets_archive""",
    "enrichment_confidence": """SELECT record_id, CAST(round(greatest(0, least(1, 1.0 - CASE WHEN coalesce(len(topic_tags), 0) = 0 THEN 0.3 WHEN len(topic_tags) < 4 THEN 0.15 ELSE 0 END - CASE WHEN coalesce(summary, '') = '' THEN 0.2 WHEN length(summary) < 50 THEN 0.1 ELSE 0 END
        - CASE WHEN coalesce(difficulty IN ('beginner', 'intermediate', 'advanced'), false) THEN 0 ELSE 0.2 END - CASE WHEN coalesce(difficulty = 'beginner', false) AND record_id % 3 = 0 THEN 0.1 ELSE 0 END
        - CASE WHEN coalesce(len(CASE record_id % 4 WHEN 0 THEN tags WHEN 1 THEN topic_tags WHEN 2 THEN domain_tags ELSE ['x'] END), 0) = 0 THEN 0.1 ELSE 0 END)), 4) AS DOUBLE) AS confidence FROM datasets_archive""",
    "completeness": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR), ' ') <> '') AS filled, round(count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR), ' ') <> '') / count(*), 6) AS share FROM collection_sheet" for c in ("name", "current_title", "current_company", "phd_institution", "phd_year", "phd_field", "twitter", "location", "notes")),
    "eligible": "SELECT sheet_id FROM collection_sheet WHERE phd_institution IS NOT NULL AND (coalesce(is_senior, false) OR coalesce(is_professor, false)) AND coalesce(verified, false)",
    "people_lines": f"SELECT sheet_id, concat_ws(', ', {_CLEAN('current_title')}, 'at ' || {_CLEAN('current_company')}, 'PhD from ' || {_CLEAN('phd_institution')}, 'known for ' || {_CLEAN('known_for')}) AS line FROM collection_sheet",
    "geocode": """WITH p(p, lat, lng) AS (VALUES ('verradorn', 48.1, 2.0), ('dravoport', 51.2, 0.1), ('quilula', 40.4, -3.7), ('norenne', 59.9, 10.7))
        SELECT sheet_id, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM collection_sheet JOIN p ON contains(lower(trim(location, ' ')), p.p) OR contains(p.p, lower(trim(location, ' ')))""",
    "link_health": """WITH s AS (SELECT CASE WHEN url IS NULL THEN 'skipped' WHEN record_id % 50 = 0 THEN 'timeout' WHEN record_id % 33 = 0 THEN 'error' ELSE 'ok' END AS s FROM datasets_archive)
        SELECT count(*) FILTER (WHERE s = 'ok') AS ok, count(*) FILTER (WHERE s = 'skipped') AS skipped, count(*) FILTER (WHERE s = 'timeout') AS timeout, count(*) FILTER (WHERE s = 'error') AS error,
               CAST(round(100.0 * count(*) FILTER (WHERE s = 'ok') / count(*) FILTER (WHERE s <> 'skipped'), 1) AS DOUBLE) AS score FROM s""",
    "slug_variants": rf"""SELECT record_id, regexp_replace(regexp_replace(trim(regexp_replace(lower({_FOLD('name')}), '[^a-z0-9_\s-]', '', 'g'), ' '), '[\s-]+', '-', 'g'), '^-|-$', '', 'g') AS b,
        left(regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9_\s-]', '', 'g'), ' '), '[\s_]+', '-', 'g'), 80) AS c FROM datasets_archive WHERE name IS NOT NULL""",
    "tags_from_fields": """WITH m AS (SELECT record_id, CASE WHEN coalesce(len(topic_tags), 0) = 0 THEN list_filter([lower(category), lower(type), lower(difficulty)], lambda x: x IS NOT NULL) ELSE topic_tags END AS t FROM datasets_archive),
        u AS (SELECT record_id, unnest(t) AS x, generate_subscripts(t, 1) AS p FROM m), f AS (SELECT record_id, x, min(p) AS p FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY p) AS n FROM f)
        SELECT m.record_id, coalesce(string_agg(x, '|' ORDER BY n) FILTER (WHERE n <= 4), '') AS tags FROM m LEFT JOIN r ON r.record_id = m.record_id GROUP BY 1""",
    "short_descriptions": "SELECT record_id, CAST(length(description) AS INTEGER) AS n FROM datasets_archive WHERE length(description) < 50",
}
