"""Queries of the search operators, over ``datasets_archive`` as the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import model_boost, question_bonus
from ..operators import search as S
from ..session import table


def _items(spark, sf_dir):
    """The archive in the shape of search items."""
    a = table(spark, sf_dir, "datasets_archive")
    kind = F.coalesce(F.lower("type"), F.lit("dataset"))
    return a.select(
        F.col("record_id").alias("id"), "name", "description", F.lower("category").alias("category"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("source", F.lit("")).alias("authors"),
        F.substring("archived_date", 1, 4).cast("int").alias("year"), kind.alias("type"), F.transform(F.coalesce("topic_tags", F.array().cast("array<string>")), lambda t: F.lower(t)).alias("topics"), "difficulty",
    )


def parse_filter(spark, sf_dir):
    return _items(spark, sf_dir).where(S.matches(S.parse('type:survey topic:trade -weekly by:statistics'))).select("id")


def keyword_bm25(spark, sf_dir):
    scored = S.bm25(S.index(_items(spark, sf_dir)), S.query_terms("wage survey"))
    return scored.select("id", F.round("score", 5).alias("score"))


def keyword_fuzzy(spark, sf_dir):
    """A misspelt word and the beginning of one: prefix and fuzzy terms."""
    index = S.index(_items(spark, sf_dir))
    return S.bm25(index, S.near_terms(index, ["survay", "wag"])).select("id", F.round("score", 5).alias("score"))


def exact_boost(spark, sf_dir):
    return _items(spark, sf_dir).where("name IS NOT NULL").select("id", F.round(S.exact_boost(F.lit(1.0), "wage survey"), 6).alias("boost"))


def rrf(spark, sf_dir):
    items = _items(spark, sf_dir).where("name IS NOT NULL")
    keyword = items.where("lower(name) LIKE '%survey%'").select("id", (F.length("name") % 7).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(100)
    semantic = items.select("id", (F.length("name") / 100).alias("score")).orderBy(F.desc("score"), "id").limit(100)
    return S.rrf(keyword, semantic).select("id", F.round("score", 8).alias("score"))


def final_score(spark, sf_dir):
    items = _items(spark, sf_dir).where("name IS NOT NULL")
    bonus = question_bonus(F.array(F.concat(F.lit("where to find "), F.lower("name"))), "farm snow data")
    boost = S.audience_boost(F.when(F.col("difficulty") == "beginner", "Junior-DS").otherwise("Senior-DS"), "a guide for farm snow data")
    return items.select("id", F.round((0.016 + bonus) * boost * model_boost((F.col("id") % 11) / 10.0), 6).alias("score"))


_KINDS = ("paper", "package", "dataset", "resource", "book", "talk", "community", "career")
_QUERIES = ("How to price ads", "wage paper", "the DATASET of rents", "datasets", "pip wheel", "salary by role", "lecture on rents", "slack group", "textbook", "RCT design", "did panel", "churn", "solar farm", "ML models", "html", "stan models", "auction", "bidding", "k-means", "nothing here", "survey 101", "sota")


def intent_boost(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in _KINDS]), (F.col("id") % len(_KINDS) + 1).cast("int"))
    items = _items(spark, sf_dir).withColumn("type", kind)
    return items.select("id", F.explode(F.array(*[F.struct(F.lit(q).alias("query"), S.intent_factor(q).alias("factor")) for q in _QUERIES])).alias("q")).select("id", "q.query", "q.factor")


def facet_filter(spark, sf_dir):
    facets = S.Facets({"type": ["survey", "sensor"], "topics": ["trade", "health"]}, (2024, 2026))
    return _items(spark, sf_dir).where(facets.condition()).select("id")


def sort_modes(spark, sf_dir):
    rows = _items(spark, sf_dir).where("name IS NOT NULL").select("id", "name", "type", (F.col("id") % 97).alias("score"))
    return S.sort_results(rows, "type", ["survey", "sensor", "administrative"]).limit(200)  # as many as the page keeps


def synonyms(spark, sf_dir):
    words = F.split(F.lower("name"), "[^a-z]+")
    table_ = F.create_map(*[x for k, v in S.SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    found = F.flatten(F.transform(words, lambda w: F.coalesce(table_[w], F.array().cast("array<string>"))))
    return _items(spark, sf_dir).where("name IS NOT NULL").select("id", F.array_join(F.array_distinct(found), "; ").alias("expansion"))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''")


QUERIES = {
    "parse_filter": parse_filter,
    "keyword_bm25": keyword_bm25,
    "keyword_fuzzy": keyword_fuzzy,
    "exact_boost": exact_boost,
    "rrf": rrf,
    "final_score": final_score,
    "intent_boost": intent_boost,
    "facets": lambda s, d: S.facet_counts(_items(s, d), ["type", "year", "difficulty", "category"], ["topics"]),
    "facet_filter": facet_filter,
    "sort_modes": sort_modes,
    "synonyms": synonyms,
    "snippet": lambda s, d: _documents(s, d).select("doc_id", T.snippet(F.regexp_replace("text", "\\s+", " "), "patent races").alias("snippet")),
    "smart_truncate": lambda s, d: _documents(s, d).select("doc_id", T.smart_truncate(F.regexp_replace("text", "\\s+", " "), 120).alias("head")),
    "highlight": lambda s, d: _documents(s, d).select("doc_id", F.md5(T.highlight(F.col("text"), "panel data")).alias("digest")),
    "fuzzy_names": lambda s, d: S.fuzzy_names(_items(s, d).where("name IS NOT NULL"), "tranport"),
    "search": lambda s, d: S.search(_items(s, d), 'wage survey type:survey -weekly').select("id", F.round("score", 5).alias("score")),
    "search_post": lambda s, d: S.search(_items(s, d), 'wage survey type:survey', top=50, filter_mode="post").select("id", F.round("score", 5).alias("score")),
}

_IT = """it AS (SELECT record_id AS id, name, description, lower(category) AS category, coalesce(tags, []) AS tags, coalesce(source, '') AS authors, CAST(left(archived_date, 4) AS INTEGER) AS year,
    coalesce(lower(type), 'dataset') AS type, list_transform(coalesce(topic_tags, []), lambda t: lower(t)) AS topics, difficulty FROM datasets_archive)"""
_TOK = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_POST = f"""tk AS (SELECT id, unnest({_TOK('name')}) AS term, 3.0::DOUBLE AS w FROM it UNION ALL SELECT id, unnest({_TOK("array_to_string(tags, ' ')")}), 1.5 FROM it
    UNION ALL SELECT id, unnest({_TOK('description')}), 1.0 FROM it UNION ALL SELECT id, unnest({_TOK('category')}), 0.8 FROM it),
    po AS (SELECT term, id, sum(w) AS weight FROM tk GROUP BY 1, 2)"""


def _bm25_sql(terms: dict[str, float], posts: str = "po") -> str:
    values = ", ".join(f"('{t}', {f})" for t, f in terms.items())
    return f"qt(term, f) AS (VALUES {values}), {_bm25_rest(posts)}"


def _bm25_rest(posts: str = "po") -> str:
    return f"""le AS (SELECT id, sum(weight) AS length FROM {posts} GROUP BY 1), st AS (SELECT count(*) AS n, avg(length) AS mean FROM le),
    hi AS (SELECT p.*, f FROM {posts} p JOIN qt USING (term)), df AS (SELECT term, count(*) AS df FROM hi GROUP BY 1),
    bm AS (SELECT id, round(sum(f * ln(1 + (n - df + 0.5) / (df + 0.5)) * weight * 2.2 / (weight + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM hi JOIN df USING (term) JOIN le USING (id), st GROUP BY 1)"""


_TEXT = "lower(concat_ws(' ', name, description, array_to_string(tags, ' '), authors))"
_BOOST = lambda q, words: f"""CASE WHEN lower(name) = '{q}' THEN 3.0 WHEN starts_with(lower(name), '{q}') THEN 2.0 WHEN regexp_matches(lower(name), '\\b{q}\\b') THEN 1.5 ELSE 1.0 END
    * CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), '{q}'))) > 0 THEN 1.2 ELSE 1.0 END * CASE WHEN {' AND '.join(f"contains(concat_ws(' ', lower(name), lower(description)), '{w}')" for w in words)} THEN 1.3 ELSE 1.0 END
    * CASE WHEN length(description) > 100 THEN 1.05 ELSE 1.0 END * CASE WHEN type IN ('paper', 'package') THEN 1.1 ELSE 1.0 END"""  # noqa: E731
_WAGE = {"questionnaire": 0.9, "poll": 0.9, "earnings": 0.9, "salary": 0.9, "wage": 1.0, "survey": 1.0}
_FLAT = r"regexp_replace(text, '\s+', ' ', 'g')"

SQL = {
    "parse_filter": f"WITH {_IT} SELECT id FROM it WHERE type = 'survey' AND contains(array_to_string(topics, ','), 'trade') AND contains(lower(authors), 'statistics') AND NOT contains({_TEXT}, 'weekly')",
    "keyword_bm25": f"WITH {_IT}, {_POST}, {_bm25_sql(_WAGE)} SELECT id, round(score, 5) AS score FROM bm",
    "keyword_fuzzy": f"""WITH {_IT}, {_POST}, vo AS (SELECT DISTINCT term, length(term) AS s FROM po), q(w, most) AS (VALUES ('survay', 1), ('wag', 1)),
        qm AS (SELECT term, CASE WHEN term = w THEN 1.0 ELSE greatest(CASE WHEN starts_with(term, w) THEN 0.375 * s / (s + 0.3 * (s - length(w))) END, CASE WHEN levenshtein(term, w) <= most THEN 0.45 * s / (s + levenshtein(term, w)) END) END AS f FROM vo, q),
        qt AS (SELECT term, sum(f)::DOUBLE AS f FROM qm WHERE f IS NOT NULL GROUP BY 1), {_bm25_rest()} SELECT id, round(score, 5) AS score FROM bm""",
    "exact_boost": f"WITH {_IT} SELECT id, round({_BOOST('wage survey', ['wage', 'survey'])}, 6) AS boost FROM it WHERE name IS NOT NULL",
    "rrf": f"""WITH {_IT}, k AS (SELECT id, CAST(length(name) % 7 AS DOUBLE) AS score FROM it WHERE lower(name) LIKE '%survey%' ORDER BY score DESC, id LIMIT 100),
        s AS (SELECT id, length(name) / 100 AS score FROM it WHERE name IS NOT NULL ORDER BY score DESC, id LIMIT 100),
        a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS ra FROM k), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rb FROM s), m AS (SELECT (SELECT max(score) FROM k) AS bk, (SELECT max(score) FROM s) AS bs)
        SELECT id, round(coalesce(CASE WHEN bk > 15 THEN 1.5 ELSE 1.0 END / (60 + ra), 0) + coalesce(CASE WHEN bs > 0.7 THEN 1.3 WHEN bk > 15 THEN 0.7 ELSE 1.0 END / (60 + rb), 0), 8) AS score FROM a FULL JOIN b USING (id), m""",
    "final_score": f"""WITH {_IT}, h AS (SELECT id, 'where to find ' || lower(name) AS q, difficulty FROM it WHERE name IS NOT NULL),
        w AS (SELECT *, CAST(contains(q, 'farm') AS INTEGER) + CAST(contains(q, 'snow') AS INTEGER) + CAST(contains(q, 'data') AS INTEGER) AS n FROM h)
        SELECT id, round((0.016 + CASE WHEN contains(q, 'farm snow data') OR contains('farm snow data', q) THEN 0.3 WHEN n >= 3 THEN 0.2 WHEN n >= 2 THEN 0.1 ELSE 0 END)
          * CASE WHEN difficulty = 'beginner' THEN 1.25 ELSE 0.85 END * (1 + (id % 11) / 10.0::DOUBLE * 0.4), 6) AS score FROM w""",
    "intent_boost": f"""WITH r(place, pattern, types, factor) AS (VALUES {", ".join(f"({i}, '{p}', {list(t)}, {f}::DOUBLE)" for i, (p, t, f) in enumerate(S.INTENTS))}), q(query) AS (VALUES {", ".join(f"('{q}')" for q in _QUERIES)}),
        m AS (SELECT query, arg_min(types, place) AS types, arg_min(factor, place) AS factor FROM q JOIN r ON regexp_matches(query, pattern, 'i') GROUP BY 1),
        i AS (SELECT record_id AS id, {list(_KINDS)}[record_id % {len(_KINDS)} + 1] AS type FROM datasets_archive)
        SELECT id, query, CASE WHEN list_contains(types, type) THEN factor ELSE 1.0::DOUBLE END AS factor FROM i CROSS JOIN q LEFT JOIN m USING (query)""",
    "facets": f"""WITH {_IT}, f AS (SELECT 'type' AS facet, type AS value FROM it UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM it UNION ALL SELECT 'difficulty', difficulty FROM it UNION ALL SELECT 'category', category FROM it UNION ALL SELECT 'topics', unnest(topics) FROM it)
        SELECT facet, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY 1, 2""",
    "facet_filter": f"WITH {_IT} SELECT id FROM it WHERE type IN ('survey', 'sensor') AND list_has_any(topics, ['trade', 'health']) AND year BETWEEN 2024 AND 2026",
    "sort_modes": f"WITH {_IT} SELECT id, name, type, id % 97 AS score FROM it WHERE name IS NOT NULL ORDER BY CASE type WHEN 'survey' THEN 1 WHEN 'sensor' THEN 2 WHEN 'administrative' THEN 3 ELSE 99 END, id % 97 DESC, id LIMIT 200",
    "synonyms": f"""WITH {_IT}, sy(w, s, k) AS (VALUES {", ".join(f"('{w}', '{s}', {i})" for w, v in S.SYNONYMS.items() for i, s in enumerate(v))}),
        wo AS (SELECT id, unnest(x) AS w, generate_subscripts(x, 1) AS p FROM (SELECT id, regexp_split_to_array(lower(name), '[^a-z]+') AS x FROM it WHERE name IS NOT NULL)),
        f AS (SELECT id, s, min((p, k)) AS o FROM wo JOIN sy USING (w) GROUP BY 1, 2), g AS (SELECT id, string_agg(s, '; ' ORDER BY o) AS e FROM f GROUP BY 1)
        SELECT it.id, coalesce(e, '') AS expansion FROM it LEFT JOIN g USING (id) WHERE name IS NOT NULL""",
    "snippet": f"""WITH t AS (SELECT doc_id, {_FLAT} AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
        h AS (SELECT doc_id, t, coalesce(nullif(instr(lower(t), 'patent races'), 0), nullif(instr(lower(t), 'patent'), 0), nullif(instr(lower(t), 'races'), 0)) AS hit FROM t),
        w AS (SELECT *, greatest(hit - 41, 0) AS st, substr(t, CAST(greatest(hit - 41, 0) AS BIGINT) + 1, 150) AS w FROM h),
        m AS (SELECT *, CASE WHEN st > 0 THEN '...' || ltrim(CASE WHEN instr(w, ' ') BETWEEN 2 AND 15 THEN substr(w, instr(w, ' ') + 1) ELSE w END, ' ') ELSE w END AS m FROM w),
        e AS (SELECT *, length(m) - nullif(instr(reverse(m), ' '), 0) + 1 AS l, 151 - nullif(instr(reverse(left(t, 150)), '.'), 0) AS sp, 151 - nullif(instr(reverse(left(t, 150)), ' '), 0) AS bl FROM m)
        SELECT doc_id, CASE WHEN hit IS NULL THEN CASE WHEN length(t) <= 150 THEN t WHEN sp > 75 THEN left(t, sp) WHEN bl > 105 THEN left(t, bl - 1) || '...' ELSE left(t, 150) || '...' END
            WHEN st + 150 >= length(t) THEN m WHEN l - 1 > length(m) - 20 AND l > 1 THEN left(m, l - 1) || '...' ELSE m || '...' END AS snippet FROM e""",
    "smart_truncate": f"""WITH t AS (SELECT doc_id, {_FLAT} AS t, left({_FLAT}, 120) AS h FROM documents WHERE text IS NOT NULL AND text <> ''),
        c AS (SELECT *, 121 - nullif(instr(reverse(h), '.'), 0) AS st, 121 - nullif(instr(reverse(h), ' '), 0) AS bl FROM t)
        SELECT doc_id, CASE WHEN length(t) <= 120 THEN t WHEN st > 60 THEN left(h, st) WHEN bl > 84 THEN left(h, bl - 1) || '...' ELSE h || '...' END AS head FROM c""",
    "highlight": "SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(panel data|panel|data)', '<mark>\\1</mark>', 'g')) AS digest FROM documents WHERE text IS NOT NULL AND text <> ''",
    "fuzzy_names": f"WITH {_IT}, d AS (SELECT id, name, round(list_min(list_transform({_TOK('name')}, lambda t: levenshtein(t, 'tranport') / greatest(length(t), 8))), 4) AS distance FROM it WHERE name IS NOT NULL) SELECT * FROM d WHERE distance <= 0.4",
    "search": f"""WITH {_IT}, {_POST}, {_bm25_sql(_WAGE)},
        t AS (SELECT bm.* FROM bm JOIN it USING (id) WHERE type = 'survey' AND NOT contains({_TEXT}, 'weekly') ORDER BY score DESC, id LIMIT 400) SELECT id, round(score * {_BOOST('wage survey', ['wage', 'survey'])}, 5) AS score FROM t JOIN it USING (id) ORDER BY round(score * {_BOOST('wage survey', ['wage', 'survey'])}, 9) DESC, id LIMIT 200""",
    "search_post": f"""WITH {_IT}, {_POST}, {_bm25_sql(_WAGE)}, t AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 50)
        SELECT id, round(score * {_BOOST('wage survey', ['wage', 'survey'])}, 5) AS score FROM t JOIN it USING (id) WHERE type = 'survey' LIMIT 200""",
}
