"""Queries of the learning operators. Most are checked by rows only: the models have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import ml as M
from ..operators import ranking as R
from ..session import cut, table
from .analytics import EV
from .ranking import _SIG, _signals
from .vectors import _DOT


def _archive_features(spark, sf_dir):
    a = table(spark, sf_dir, "datasets_archive").select("record_id", "name", "description", "category", "type", "difficulty", "tags", "topic_tags", "url")
    return M.item_features(a, ["category", "type", "difficulty"], ["name", "description"], ["tags", "topic_tags"], {"has_url": F.col("url").isNotNull(), "is_secure": F.col("url").startswith("https")}, [])


def item_features(spark, sf_dir):
    rows, names = _archive_features(spark, sf_dir)
    return rows.select("record_id", *[F.col(n).cast("bigint").alias(n) for n in names])


def _training(spark, sf_dir):
    """Parts with the quantity returned as the target, in the shape of the ranking model's input."""
    sold = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("y"))
    p = table(spark, sf_dir, "part").join(sold, "p_partkey", "left").na.fill(0.0, ["y"])
    rows, names = M.item_features(p, ["p_brand", "p_type"], ["p_name"], [], {}, ["p_size", "p_retailprice"])
    return cut(M.stratified_split(rows, "p_partkey", F.col("y") > 0), "training"), names


def regression(model):
    def run(spark, sf_dir):
        rows, names = _training(spark, sf_dir)
        predicted, _ = M.regress(rows, names, "y", model)
        return M.evaluate(predicted, "y").select("metric", F.round("value", 6).alias("value"))

    return run


def model_rank(spark, sf_dir):
    """Hybrid ranking end to end: observed parts keep their score, the others get the model's."""
    rows, names = _training(spark, sf_dir)
    predicted, _ = M.regress(rows, names, "y", "ridge")
    return R.hybrid(rows.select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 2 == 0, F.col("y")).otherwise(0.0).alias("raw")), predicted.select(F.col("p_partkey").alias("item"), "prediction")).select("item", F.round("score", 6).alias("score"), "cold_start")


def split(spark, sf_dir):
    rows, _ = _training(spark, sf_dir)
    return rows.groupBy((F.col("y") > 0).alias("positive")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("train").cast("int")), 1).alias("share"))


def als(spark, sf_dir):
    ev = A.shape(table(spark, sf_dir, "analytics_events"))
    named = lambda t, f: A.of_type(ev, t).select("sid", A.field(f).alias("name"))
    ratings = M.preferences(table(spark, sf_dir, "content_dwell"), named("click", "name"), named("impression", "name"), named("search_click", "resultId"))
    return M.als_similar(cut(ratings, "ratings"))


def als_input(spark, sf_dir):
    ev = A.shape(table(spark, sf_dir, "analytics_events"))
    named = lambda t, f: A.of_type(ev, t).select("sid", A.field(f).alias("name"))
    ratings = M.preferences(table(spark, sf_dir, "content_dwell"), named("click", "name"), named("impression", "name"), named("search_click", "resultId"))
    return ratings.select("sid", "item", F.round("rating", 4).alias("rating"))


def tfidf(spark, sf_dir):
    a = table(spark, sf_dir, "datasets_archive").select("record_id", F.concat_ws(" ", "name", "description").alias("text"))
    from pyspark.ml.functions import vector_to_array

    rows, _ = M.tfidf(a, "text")
    return rows.select("record_id", F.size(F.filter(vector_to_array("tfidf"), lambda x: x > 0)).alias("terms"))


def coldstart_knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    seen = v.where("id % 4 <> 0").withColumn("score", (F.col("id") % 17) / 16.0)
    return M.cold_start(v.where("id % 4 = 0"), seen).select("id", F.round("score", 5).alias("score"))


def signal_auc(spark, sf_dir):
    """How well each item's impressions tell that it was clicked."""
    found = R.auc(_signals(spark, sf_dir).select("impressions", (F.col("clicks") > 0).alias("clicked")), "impressions", F.col("clicked"))
    return found.select(F.round("auc", 8).alias("auc"), "positives", "negatives")


QUERIES = {
    "item_features": item_features,
    "split": split,
    "regression_tweedie": regression("tweedie"),
    "regression_ridge": regression("ridge"),
    "regression_trees": regression("trees"),
    "model_rank": model_rank,
    "als_input": als_input,
    "als": als,
    "tfidf": tfidf,
    "coldstart_knn": coldstart_knn,
    "signal_auc": signal_auc,
}

_CODE = lambda c: f"dense_rank() OVER (ORDER BY coalesce({c}, 'unknown')) - 1"
SQL = {
    "item_features": f"""SELECT record_id, {", ".join(f"{_CODE(c)} AS {c}_code" for c in ("category", "type", "difficulty"))}, coalesce(length(name), 0) AS name_length, coalesce(length(description), 0) AS description_length,
        CAST(coalesce(len(tags), 0) AS BIGINT) AS tags_count, CAST(coalesce(len(topic_tags), 0) AS BIGINT) AS topic_tags_count, CAST(url IS NOT NULL AS BIGINT) AS has_url, CAST(coalesce(starts_with(url, 'https'), false) AS BIGINT) AS is_secure FROM datasets_archive""",
    "als_input": f"""WITH {EV}, r AS (SELECT session_id AS sid, lower(trim(name, ' ')) AS item, dwell_ms / 1000 AS rating FROM content_dwell WHERE dwell_ms BETWEEN 1 AND 86400000
        UNION ALL SELECT coalesce(sid, 'without session: ' || lower(trim(d->>'$.name', ' '))), lower(trim(d->>'$.name', ' ')), CASE type WHEN 'click' THEN 10.0 ELSE 0.5 END FROM ev WHERE type IN ('click', 'impression') UNION ALL SELECT sid, lower(trim(d->>'$.resultId', ' ')), 5.0 FROM ev WHERE type = 'search_click')
        SELECT sid, item, round(sum(rating), 4) AS rating FROM r WHERE sid IS NOT NULL AND item <> '' GROUP BY 1, 2""",
    "coldstart_knn": f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), s AS (SELECT a.id, b.id AS o, round({_DOT("a.vec", "b.vec")}, 3) AS s, (b.id % 17) / 16.0::DOUBLE AS y FROM v a, v b WHERE a.id % 4 = 0 AND b.id % 4 <> 0),
        k AS (SELECT id, s, y FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, o) <= 5), g AS (SELECT id, sum(s * y) / sum(s) AS g FROM k GROUP BY 1)
        SELECT v.id, round(coalesce(g, (SELECT avg((id % 17) / 16.0::DOUBLE) FROM v WHERE id % 4 <> 0)), 5) AS score FROM v LEFT JOIN g USING (id) WHERE v.id % 4 = 0""",
    "signal_auc": f"""WITH {EV}, {_SIG}, b AS (SELECT impressions AS s, count(*) FILTER (WHERE clicks > 0) AS p, count(*) FILTER (WHERE clicks <= 0) AS q FROM si GROUP BY 1),
        w AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
        SELECT round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 8) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives FROM w""",
}
