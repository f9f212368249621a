"""Queries of the vector operators, over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import vectors as O
from ..session import table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("int").alias("label"))


def vector_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return O.top_k_literal(v, v.where("id = 7").first()["vec"], 100)


def related_items(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return O.neighbours(v, v, 5, 0.3)


def search_neighbours(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return O.neighbours(v.where("id % 100 = 0"), v, 20, -1.0)


def centroids(spark, sf_dir):
    found = O.centroids(_vectors(spark, sf_dir))
    return found.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def nearest_centroid(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return O.nearest_centroid(v, O.centroids(v), 0.2)


def quantize_roundtrip(spark, sf_dir):
    q = _vectors(spark, sf_dir).select("id", V.quantize(F.col("vec")).alias("q"))
    back = q.select("id", F.col("q.codes").alias("codes"), V.dequantize(F.col("q")).alias("v"))
    total = F.aggregate("codes", F.lit(0), lambda s, x: s + x)
    return back.select("id", total.alias("code_sum"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("value_sum"))


def _members(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    hard = F.when(F.col("id") % 3 == 0, "beginner").when(F.col("id") % 3 == 1, "intermediate").otherwise("advanced")
    return O.cluster_relevance(v, O.centroids(v), F.col("id") % 50, hard)


def diversity(spark, sf_dir):
    return O.diversity(_vectors(spark, sf_dir)).select("label", "n", F.round("diversity", 6).alias("diversity"))


def diversity_summary(spark, sf_dir):
    d = O.diversity(_vectors(spark, sf_dir))
    return d.agg(F.round(F.avg("diversity"), 6).alias("mean"), F.round(F.min("diversity"), 6).alias("low"), F.round(F.max("diversity"), 6).alias("high"), F.count_if(F.col("diversity").between(0.3, 0.7)).alias("in_range"))


def type_coverage(spark, sf_dir):
    m = _members(spark, sf_dir).withColumn("kind", (F.col("id") % 4).cast("int")).withColumn("relevance", F.round("relevance", 6))
    return O.type_coverage(m, "label", "kind", "relevance", 2).select("label", "kind", "id", "relevance", "place")


def merge_small(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return O.merge_small(sizes, O.centroids(v), 55, -1.0)


QUERIES = {
    "vector_topk": vector_topk,
    "related_items": related_items,
    "search_neighbours": search_neighbours,
    "related_by_cells": lambda s, d: O.related_by_cells(_vectors(s, d), 5, 0.3),
    "centroids": centroids,
    "nearest_centroid": nearest_centroid,
    "quantize_roundtrip": quantize_roundtrip,
    "relevance": lambda s, d: _members(s, d).select("id", "label", F.round("relevance", 6).alias("relevance")),
    "diversity": diversity,
    "diversity_summary": diversity_summary,
    "type_coverage": type_coverage,
    "merge_small": merge_small,
    "mmr": lambda s, d: O.mmr(_members(s, d)),
    "kmeans": lambda s, d: O.kmeans(_vectors(s, d), 10),
    "best_k": lambda s, d: O.best_k(_vectors(s, d), [5, 10, 15]),
}

_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS INTEGER) AS label FROM embeddings)"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1] * t[2]))"
_COS = lambda a, b: f"list_cosine_similarity({a}, {b})"
_E = "e AS (SELECT id, label, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM v)"
_C = "c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1)"
_KNN = lambda where, k, t: f"""WITH {_V}, s AS (SELECT a.id AS src, b.id AS dst, round({_DOT("a.vec", "b.vec")}, 3) AS score FROM v a, v b WHERE a.id <> b.id {where})
    SELECT src, dst, score, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INTEGER) AS rank FROM s WHERE score > {t} QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) <= {k}"""  # noqa: E731
_REL = f"""{_V}, {_E}, {_C}, mo AS (SELECT label, greatest(max(ln(1 + id % 50)), 1.0) AS most FROM v GROUP BY 1),
    r AS (SELECT v.id, v.label, 0.3 * CASE WHEN v.id % 50 > 0 THEN ln(1 + v.id % 50) / most ELSE 0.5 END + 0.2 * CASE v.id % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.8 END + 0.5 * ({_COS("v.vec", "c.centroid")} + 1) / 2 AS relevance
          FROM v JOIN c USING (label) JOIN mo USING (label))"""
_DIV = f"""{_V}, d AS (SELECT a.label, count(*) FILTER (WHERE a.id < b.id) AS pairs, avg(1 - {_COS("a.vec", "b.vec")}) FILTER (WHERE a.id < b.id) AS diversity FROM v a JOIN v b ON a.label = b.label GROUP BY 1),
    n AS (SELECT label, count(*) AS n FROM v GROUP BY 1)"""

SQL = {
    "vector_topk": f"WITH {_V} SELECT a.id, round({_DOT('a.vec', 'q.vec')}, 6) AS score FROM v a, (SELECT vec FROM v WHERE id = 7) q ORDER BY score DESC, a.id LIMIT 100",
    "related_items": _KNN("", 5, 0.3),
    "search_neighbours": _KNN("AND a.id % 100 = 0", 20, -1),
    "centroids": f"WITH {_V}, {_E} SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS x FROM e GROUP BY 1, 2",
    "nearest_centroid": f"""WITH {_V}, {_E}, {_C}, s AS (SELECT v.id, c.label AS center, round({_COS("v.vec", "c.centroid")}, 6) AS score FROM v, c)
        SELECT id, center, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, center) = 1 AND score > 0.2""",
    "quantize_roundtrip": f"""WITH {_V}, b AS (SELECT id, vec, list_min(vec) AS lo, CASE WHEN list_max(vec) > list_min(vec) THEN list_max(vec) - list_min(vec) ELSE 1.0 END AS w FROM v),
        q AS (SELECT id, lo, w, list_transform(vec, lambda x: CAST(floor((x - lo) / w * 255) AS INTEGER)) AS codes FROM b)
        SELECT id, CAST(list_sum(codes) AS INTEGER) AS code_sum, round(list_sum(list_transform(codes, lambda c: c / 255.0::DOUBLE * w + lo)), 5) AS value_sum FROM q""",
    "relevance": f"WITH {_REL} SELECT id, label, round(relevance, 6) AS relevance FROM r",
    "diversity": f"WITH {_DIV} SELECT n.label, n, round(coalesce(diversity, 0), 6) AS diversity FROM n LEFT JOIN d USING (label)",
    "diversity_summary": f"WITH {_DIV}, x AS (SELECT coalesce(diversity, 0) AS g FROM n LEFT JOIN d USING (label)) SELECT round(avg(g), 6) AS mean, round(min(g), 6) AS low, round(max(g), 6) AS high, count(*) FILTER (WHERE g BETWEEN 0.3 AND 0.7) AS in_range FROM x",
    "type_coverage": f"""WITH {_REL}, k AS (SELECT label, CAST(id % 4 AS INTEGER) AS kind, id, round(relevance, 6) AS relevance FROM r)
        SELECT *, CAST(row_number() OVER (PARTITION BY label, kind ORDER BY relevance DESC, id) AS INTEGER) AS place FROM k QUALIFY row_number() OVER (PARTITION BY label, kind ORDER BY relevance DESC, id) <= 2""",
    "merge_small": f"""WITH {_V}, {_E}, {_C}, n AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
        s AS (SELECT a.label, b.label AS merged_into, round({_COS("a.centroid", "b.centroid")}, 6) AS score FROM c a JOIN n x ON x.label = a.label AND x.n <= 55, c b JOIN n y ON y.label = b.label AND y.n > 55)
        SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, merged_into) = 1 AND score > -1""",
}
