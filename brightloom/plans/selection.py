"""Queries of labels, curation, user lists and small catalog steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import selection as S
from ..session import table


def _archive(spark, sf_dir):
    return table(spark, sf_dir, "datasets_archive")


def _category():
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower("category"), "\\s+", " ")), F.lit("")), F.lit("(none)"))


def _tagged(spark, sf_dir):
    return _archive(spark, sf_dir).select("record_id", _category().alias("category"), F.coalesce("topic_tags", F.array().cast("array<string>")).alias("t"))


def top_tags(spark, sf_dir):
    return S.top_values(_tagged(spark, sf_dir), "category", F.transform("t", lambda t: F.lower(t)), 5)


def cluster_labels(spark, sf_dir):
    return S.labels(top_tags(spark, sf_dir), "category")


def label_dedupe(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Group "), (F.col("s_nationkey") % 5).cast("string")).alias("label"), "s_nationkey")
    return C.unique_labels(s, "s_suppkey", "s_suppkey", lambda: F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))


def _clusters(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("size"), F.count_distinct(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("kinds"), F.sort_array(F.collect_list(F.round(F.col("p_retailprice") / 10000, 6)), False).alias("scores"))


def display_order(spark, sf_dir):
    c = _clusters(spark, sf_dir).withColumn("technical", F.col("label").like("%1%")).withColumn("career", F.col("label").like("%2"))
    return S.display_order(c).select("label", "size", "priority", "cluster_id")


def curation(spark, sf_dir):
    c = _clusters(spark, sf_dir)
    return c.select("label", F.round(S.curation_score(F.col("label"), F.col("size"), F.col("kinds"), F.col("scores"), ("#1",), ("#2", "#3")), 4).alias("score"))


def name_checks(spark, sf_dir):
    a = _archive(spark, sf_dir).where("name IS NOT NULL")
    return a.select("record_id", S.is_good_name(F.col("name"), ("old", "test")).alias("good"), S.is_generic(F.col("description")).alias("generic"), T.host(F.col("url")).rlike("verra|quil").alias("skipped"))


def dwelled_not_listed(spark, sf_dir):
    """Favourites in no list: items a session dwelled on that its item sequence lacks (anti join against exploded lists)."""
    d = table(spark, sf_dir, "content_dwell").select("session_id", T.item_key(F.col("name")).alias("item")).where("session_id IS NOT NULL AND item IS NOT NULL").distinct()
    q = table(spark, sf_dir, "session_sequences").where("session_id IS NOT NULL").select("session_id", F.explode("item_sequence").alias("i")).select("session_id", T.item_key(F.col("i.name")).alias("item")).where("item IS NOT NULL")
    return d.join(q, ["session_id", "item"], "left_anti")


def score_injection(spark, sf_dir):
    scores = table(spark, sf_dir, "content_dwell").where("dwell_ms BETWEEN 1 AND 86400000").groupBy("name").agg(F.max(F.col("dwell_ms") / 1000).alias("score"))
    items = table(spark, sf_dir, "session_sequences").select(F.explode("item_sequence").alias("i")).select(F.col("i.name").alias("name")).where("name IS NOT NULL").distinct()
    return S.inject_scores(items, scores, "name", "score").select("name", F.round("model_score", 3).alias("model_score"))


def consolidation(spark, sf_dir):
    mapping = {"energy & utilities economics": "Energy", "labor markets": "Labour", "retail prices": "Prices"}
    return _archive(spark, sf_dir).where("category IS NOT NULL").select(S.consolidate(F.regexp_replace("category", "\\s+", " "), mapping).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def move_rows(spark, sf_dir):
    """Rows removed by a list of names, and rows moved to another table by another list."""
    a = _archive(spark, sf_dir).where("name IS NOT NULL").select("record_id", "name")
    removed, moved = a.where("record_id % 10 = 0").select("name").distinct(), a.where("record_id % 10 = 1").select("name").distinct()
    kept = a.join(removed, "name", "left_anti")
    return kept.join(moved, "name", "left_semi").select("record_id", F.lit("moved").alias("to")).unionByName(kept.join(moved, "name", "left_anti").select("record_id", F.lit("kept").alias("to")))


def candidates(spark, sf_dir):
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("**, "), F.col("title"))
    return table(spark, sf_dir, "leading_lights").select("slug", S.candidate_names(line).alias("name"))


def topic_rotation(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    some = S.next_topics(n, n.where("n_nationkey < 20"), "n_nationkey").select("n_name", F.lit("some left").alias("state"))
    return some.unionByName(S.next_topics(n, n, "n_nationkey").select("n_name", F.lit("reset").alias("state")))


def often_cited(spark, sf_dir):
    """Highest values first, one for each prefix of 30 characters, at most 40."""
    p = table(spark, sf_dir, "part").where("p_retailprice >= 1000").select("p_partkey", "p_name", F.round("p_retailprice", 2).alias("v"))
    best = p.groupBy(F.lower(F.substring("p_name", 1, 30)).alias("prefix")).agg(F.max_by(F.struct("p_partkey", "v"), F.struct("v", -F.col("p_partkey"))).alias("b"))
    return best.select("b.p_partkey", "b.v").orderBy(F.desc("v"), "p_partkey").limit(40)


def themed(spark, sf_dir):
    a = _archive(spark, sf_dir).where("name IS NOT NULL").select("record_id", "name", F.coalesce("type", F.lit("none")).alias("type"))
    return S.carousel(a, F.col("name"), ["wage", "price", "trade", "survey"], "type", "record_id").select("record_id", "type", "matches")


def rolling_hashes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", S.rolling_hash(F.col("n_name")).alias("hash"))


def display_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.compact(F.floor("o_totalprice")).alias("price"), S.seconds_text(F.col("o_orderkey") * 777).alias("time"))


def search_documents(spark, sf_dir):
    """Items as search documents: arrays joined, empty fields left out."""
    a = _archive(spark, sf_dir)
    doc = F.to_json(F.struct(F.col("record_id").alias("id"), "name", F.nullif(F.trim("description"), F.lit("")).alias("description"), F.when(F.size("tags") > 0, F.array_join("tags", " ")).alias("tags"), "category"))
    return a.select("record_id", F.get_json_object(doc, "$.name").alias("name"), F.get_json_object(doc, "$.tags").alias("tags"), F.get_json_object(doc, "$.description").alias("description"))


def people_by_type(spark, sf_dir):
    rules = [("academia", ("professor", "postdoctoral")), ("policy", ("policy", "economist")), ("industry", ("data", "applied", "pricing", "experimentation", "scientist"))]
    p = table(spark, sf_dir, "leading_lights")
    return p.select("slug", C.classify(F.col("title"), rules, "other").alias("type"), F.array_join(F.slice("specialty", 1, 2), " & ").alias("focus"))


QUERIES = {
    "top_tags": top_tags,
    "cluster_labels": cluster_labels,
    "label_dedupe": label_dedupe,
    "display_order": display_order,
    "curation": curation,
    "name_checks": name_checks,
    "dwelled_not_listed": dwelled_not_listed,
    "score_injection": score_injection,
    "consolidation": consolidation,
    "move_rows": move_rows,
    "candidates": candidates,
    "topic_rotation": topic_rotation,
    "often_cited": often_cited,
    "themed": themed,
    "rolling_hashes": rolling_hashes,
    "display_numbers": display_numbers,
    "search_documents": search_documents,
    "people_by_type": people_by_type,
    "page_of_parts": lambda s, d: S.page(table(s, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 3, 15),
    "seeded_shuffle": lambda s, d: S.shuffled(table(s, d, "supplier").select("s_suppkey"), "s_suppkey", 7),
}

_CATEGORY = r"coalesce(nullif(trim(regexp_replace(lower(category), '\s+', ' ', 'g'), ' '), ''), '(none)')"
_TOP = f"""c AS (SELECT {_CATEGORY} AS category, unnest(list_transform(coalesce(topic_tags, []), lambda t: lower(t))) AS value FROM datasets_archive), n AS (SELECT category, value, count(*) AS n FROM c GROUP BY 1, 2),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS INTEGER) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, value) <= 5)"""
_INIT = lambda c: f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
_CL = "cl AS (SELECT p_brand AS label, count(*) AS size, count(DISTINCT split_part(p_type, ' ', 1)) AS kinds, list(round(p_retailprice / 10000, 6) ORDER BY p_retailprice DESC) AS scores FROM part GROUP BY 1)"

SQL = {
    "top_tags": f"WITH {_TOP} SELECT * FROM t",
    "cluster_labels": f"WITH {_TOP} SELECT category, string_agg({_INIT('value')}, ' & ' ORDER BY rank) AS label FROM t WHERE rank <= 2 GROUP BY 1",
    "label_dedupe": """WITH s AS (SELECT s_suppkey, 'Group ' || (s_nationkey % 5) AS label, s_nationkey FROM supplier), a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY s_suppkey) = 1 THEN label ELSE label || ' (n' || s_nationkey || ')' END AS l2 FROM s),
        b AS (SELECT *, row_number() OVER (PARTITION BY l2 ORDER BY s_suppkey) AS m FROM a) SELECT s_suppkey, CASE WHEN m = 1 THEN l2 ELSE l2 || ' ' || m END AS unique_label FROM b""",
    "display_order": f"""WITH {_CL}, p AS (SELECT *, CASE WHEN label LIKE '%2' THEN 4 WHEN kinds > 1 AND label LIKE '%1%' THEN 0 WHEN kinds > 1 THEN 1 WHEN label LIKE '%1%' THEN 2 ELSE 3 END AS priority FROM cl)
        SELECT label, size, CAST(priority AS INTEGER) AS priority, CAST(row_number() OVER (ORDER BY priority, size DESC, label) - 1 AS INTEGER) AS cluster_id FROM p""",
    "curation": f"""WITH {_CL} SELECT label, round(CASE WHEN contains(label, '#1') THEN -50 ELSE 0 END + CASE WHEN contains(label, '#2') OR contains(label, '#3') THEN 30 ELSE 0 END + CASE WHEN size BETWEEN 10 AND 50 THEN 10 WHEN size > 100 THEN -5 ELSE 0 END
        + CASE WHEN kinds = 1 THEN -20 ELSE 0 END + list_sum(list_transform(scores[1:5], lambda x: x * 50)), 4) AS score FROM cl""",
    "name_checks": rf"""SELECT record_id, length(trim(name, ' ')) >= 3 AND len(list_filter(regexp_split_to_array(trim(name, ' '), '\s+'), lambda w: w <> '')) BETWEEN 2 AND 6 AND NOT contains(lower(name), 'old') AND NOT contains(lower(name), 'test') AS good,
        {" + ".join(f"CAST(contains(lower(description), '{t}') AS INTEGER)" for t in S.GENERIC)} >= 2 AS generic,
        regexp_matches(nullif(regexp_replace(regexp_extract(lower(trim(url, ' ')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), ''), 'verra|quil') AS skipped FROM datasets_archive WHERE name IS NOT NULL""",
    "dwelled_not_listed": """SELECT DISTINCT session_id, lower(trim(name, ' ')) AS item FROM content_dwell d WHERE session_id IS NOT NULL AND lower(trim(name, ' ')) <> ''
        EXCEPT SELECT session_id, lower(trim(i.name, ' ')) FROM (SELECT session_id, unnest(item_sequence) AS i FROM session_sequences WHERE session_id IS NOT NULL)""",
    "score_injection": """WITH s AS (SELECT lower(trim(name, ' ')) AS k, max(dwell_ms / 1000) AS m FROM content_dwell WHERE dwell_ms BETWEEN 1 AND 86400000 GROUP BY 1), i AS (SELECT DISTINCT i.name FROM (SELECT unnest(item_sequence) AS i FROM session_sequences) WHERE i.name IS NOT NULL)
        SELECT name, round(coalesce(m, 0), 3) AS model_score FROM i LEFT JOIN s ON s.k = lower(trim(name, ' '))""",
    "consolidation": rf"""WITH c AS (SELECT trim(regexp_replace(category, '\s+', ' ', 'g'), ' ') AS c FROM datasets_archive WHERE category IS NOT NULL)
        SELECT CASE lower(c) WHEN 'energy & utilities economics' THEN 'Energy' WHEN 'labor markets' THEN 'Labour' WHEN 'retail prices' THEN 'Prices' ELSE {_INIT('c')} END AS category, count(*) AS n FROM c GROUP BY 1""",
    "move_rows": """WITH a AS (SELECT record_id, name FROM datasets_archive WHERE name IS NOT NULL), k AS (SELECT * FROM a WHERE name NOT IN (SELECT name FROM a WHERE record_id % 10 = 0))
        SELECT record_id, CASE WHEN name IN (SELECT name FROM a WHERE record_id % 10 = 1) THEN 'moved' ELSE 'kept' END AS to FROM k""".replace(" AS to ", ' AS "to" '),
    "candidates": "SELECT slug, name FROM leading_lights",
    "topic_rotation": "SELECT n_name, 'some left' AS state FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_name, 'reset' FROM nation",
    "often_cited": """WITH p AS (SELECT p_partkey, round(p_retailprice, 2) AS v, lower(left(p_name, 30)) AS x FROM part WHERE p_retailprice >= 1000), b AS (SELECT p_partkey, v FROM p QUALIFY row_number() OVER (PARTITION BY x ORDER BY v DESC, p_partkey) = 1)
        SELECT * FROM b ORDER BY v DESC, p_partkey LIMIT 40""",
    "themed": f"""WITH m AS (SELECT record_id, coalesce(type, 'none') AS type, {" + ".join(f"CAST(contains(lower(name), '{k}') AS INTEGER)" for k in ("wage", "price", "trade", "survey"))} AS matches FROM datasets_archive WHERE name IS NOT NULL),
        t AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY matches DESC, record_id) AS turn FROM m WHERE matches >= 1) SELECT record_id, type, matches FROM t ORDER BY turn, matches DESC, record_id LIMIT 8""",
    "rolling_hashes": """SELECT n_name, lower(to_base(abs(list_reduce(list_transform(string_split(n_name, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)), 36)) AS hash FROM nation""",
    "display_numbers": """SELECT o_orderkey, CASE WHEN p >= 1000000 THEN printf('%.1f', p / 1000000) || 'M' WHEN p >= 1000 THEN printf('%.1f', p / 1000) || 'K' ELSE CAST(p AS VARCHAR) END AS price, CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS time
        FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderkey * 777 // 1000 AS s FROM orders)""",
    "search_documents": "SELECT record_id, name, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ' ') END AS tags, nullif(trim(description, ' '), '') AS description FROM datasets_archive",
    "people_by_type": """SELECT slug, CASE WHEN contains(t, 'professor') OR contains(t, 'postdoctoral') THEN 'academia' WHEN contains(t, 'policy') OR contains(t, 'economist') THEN 'policy'
        WHEN contains(t, 'data') OR contains(t, 'applied') OR contains(t, 'pricing') OR contains(t, 'experimentation') OR contains(t, 'scientist') THEN 'industry' ELSE 'other' END AS type, array_to_string(specialty[1:2], ' & ') AS focus
        FROM (SELECT slug, specialty, coalesce(lower(title), '') AS t FROM leading_lights)""",
    "page_of_parts": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 15 OFFSET 45",
}
