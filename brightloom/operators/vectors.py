"""Vector search, neighbours, clusters and diverse selection over ``(id, vec array<float>, label)``.

Similarities of many vectors run as blocked matrix products: a block of queries is a numpy matrix, every partition of
the index multiplies its batches with it and keeps only the best ``k`` of each query, so what is shuffled is
queries x partitions x k rows, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import relevance
from ..functions.vectors import cosine, dot, literal, norm
from ..session import cut, work_dir

BLOCK = 1024
MAX_CENTERS = 20_000
CHUNK = 4096


def top_k_literal(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The ``k`` vectors with the largest inner product with one query."""
    score = F.round(dot(F.col("vec"), literal(query)), 6)
    return vectors.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _best(matrix: np.ndarray, ids: np.ndarray, k: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[float, int]]] = {}
        for pdf in batches:
            own = pdf["id"].to_numpy()
            sims = np.stack(pdf["vec"].to_numpy()).astype(np.float64) @ matrix.T
            for j in range(len(ids)):
                column = np.round(sims[:, j], 3)
                column[own == ids[j]] = -np.inf
                hits = np.flatnonzero(column > threshold)
                if len(hits) > k:  # ties at the border stay in, they are ranked by id at the end
                    least = np.partition(column[hits], -k)[-k]
                    hits = hits[column[hits] >= least]
                if len(hits):
                    best = held.get(j, []) + [(-column[h], int(own[h])) for h in hits]
                    held[j] = sorted(best)[:k]
        rows = [(int(ids[j]), i, float(-s)) for j, best in held.items() for s, i in best]
        yield pd.DataFrame(rows, columns=["src", "dst", "score"])

    return run


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """``src, dst, score, rank``: the ``k`` nearest of each query by inner product (rounded to 3 digits), itself excluded.

    The query set goes through in blocks of ``BLOCK`` vectors; a block is all that the driver holds and that is sent to
    the tasks, and each block but the last is a job whose result is written. For all vectors of a large catalog against
    each other take ``related_by_cells``.
    """
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    spark, schema = vectors.sparkSession, "src bigint, dst bigint, score double, rank int"

    def best(block: list[tuple]) -> DataFrame:
        ids = np.array([r[0] for r in block])
        matrix = np.array([r[1] for r in block], np.float64)
        found = vectors.select("id", "vec").mapInPandas(_best(matrix, ids, k, threshold), "src bigint, dst bigint, score double")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    block, folder, blocks = [], work_dir(spark, "neighbours"), 0
    for row in queries.select("id", "vec").orderBy("id").toLocalIterator(prefetchPartitions=True):
        if len(block) == BLOCK:  # more are coming: this block is done by itself and written
            best(block).write.parquet(f"{folder}/block={blocks}")
            block, blocks = [], blocks + 1
        block.append((row[0], row[1]))
    last = best(block) if block else spark.createDataFrame([], schema)
    if not blocks:
        return last
    written = spark.read.schema(schema).parquet(*[f"{folder}/block={i}" for i in range(blocks)])
    return written.unionByName(last)


def _cell_pairs(k: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        index, asked = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(index) or not len(asked):
            return pd.DataFrame({"src": [], "dst": [], "score": []})
        ids, own = asked["id"].to_numpy(), index["id"].to_numpy()
        sims = np.round(np.stack(asked["vec"].to_numpy()).astype(float) @ np.stack(index["vec"].to_numpy()).astype(float).T, 3)
        sims[ids[:, None] == own[None, :]] = -np.inf
        keep = min(k, sims.shape[1])
        top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        score = np.take_along_axis(sims, top, 1)
        out = pd.DataFrame({"src": np.repeat(ids, keep), "dst": own[top].ravel(), "score": score.ravel()})
        return out[out["score"] > threshold]

    return run


def related_by_cells(vectors: DataFrame, k: int, threshold: float, probes: int = 8, sample: int = 50_000, seed: int = 42) -> DataFrame:
    """Approximate ``neighbours`` of all vectors for catalogs where all pairs are too many.

    Cells are k-means centres fitted on at most ``sample`` vectors (of a seeded hash order); every vector is indexed in
    its cell and looks into its ``probes`` nearest ones. A cell is cut into chunks of ``CHUNK`` vectors on both sides, so
    no task holds an unbounded cell. Recall against brute force is measured in the tests.
    """
    n = vectors.count()
    cells = max(1, min(MAX_CENTERS, int(n**0.5 / 2)))
    share = min(1.0, sample / max(1, n))
    fitted = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(share * 1_000_000))
    unit = fitted.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    centers = np.array(KMeans(k=cells, seed=seed, maxIter=100).fit(unit).clusterCenters())
    wide = min(probes, len(centers))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (centers**2).sum(1) / 2
        for pdf in batches:
            if len(pdf):
                sims = np.stack(pdf["vec"].to_numpy()).astype(float) @ centers.T - half
                near = np.argsort(-sims, axis=1, kind="stable")[:, :wide]
                yield pdf.assign(cells=near.tolist())

    placed = vectors.select("id", "vec").mapInPandas(place, "id bigint, vec array<float>, cells array<int>")
    chunk = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col("parts")).cast("int")
    sizes = placed.groupBy(F.element_at("cells", 1).alias("cell")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    index = placed.withColumn("cell", F.element_at("cells", 1)).join(F.broadcast(sizes), "cell").select("cell", chunk(1).alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") * wide - 1)).alias("ask"), F.lit(0).alias("side"), "id", "vec")
    asked = placed.select("id", "vec", F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64(F.lit(2), "id"), F.col("parts") * wide).cast("int").alias("ask"), F.lit(1).alias("side"), "id", "vec")
    found = index.unionByName(asked).groupBy("cell", "part", "ask").applyInPandas(_cell_pairs(k, threshold), "src bigint, dst bigint, score double")
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, by: str = "label") -> DataFrame:
    """Element-wise mean vector of each group."""
    parts = vectors.select(by, F.posexplode("vec").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def diversity(vectors: DataFrame, by: str = "label") -> DataFrame:
    """Mean pairwise cosine distance in each group, without pairs: the sum of all pairwise cosines is the squared
    length of the sum of unit vectors, less one for each vector."""
    unit = vectors.select(by, F.transform("vec", lambda x: x.cast("double")).alias("v")).withColumn("u", F.transform("v", lambda x: x / norm(F.col("v"))))
    sums = unit.select(by, F.posexplode("u").alias("pos", "x")).groupBy(by, "pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    return total.select(by, "n", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(1 - (F.col("q") - F.col("n")) / pairs).alias("diversity"))


def nearest_centroid(points: DataFrame, centers: DataFrame, threshold: float, by: str = "label") -> DataFrame:
    """The most similar centre of each vector, if it is above the threshold; ties by the smaller centre. Centres are few
    by construction (their number is checked) and go to the tasks as one matrix."""
    known = centers.select(by, "centroid").orderBy(by).limit(MAX_CENTERS + 1).collect()
    if len(known) > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centres")
    names = np.array([r[0] for r in known])
    matrix = np.array([r[1] for r in known], float).reshape(len(known), -1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or not len(names):
                continue
            v = np.stack(pdf["vec"].to_numpy()).astype(float)
            sims = np.round(v @ matrix.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), 6)
            best = sims.argmax(1)
            yield pd.DataFrame({"id": pdf["id"], "center": names[best], "score": sims[np.arange(len(v)), best]})

    kinds = f"id {points.schema['id'].dataType.simpleString()}, center {centers.schema[by].dataType.simpleString()}, score double"
    return points.select("id", "vec").mapInPandas(nearest, kinds).where(F.col("score") > threshold)


def merge_small(sizes: DataFrame, centers: DataFrame, largest_small: int, threshold: float, by: str = "label") -> DataFrame:
    """Clusters of at most ``largest_small`` members and the large cluster each is merged into."""
    sized = centers.join(sizes, by)
    small = sized.where(F.col("n") <= largest_small).select(F.col(by).alias("id"), F.col("centroid").alias("vec"))
    return nearest_centroid(small, sized.where(F.col("n") > largest_small).select(by, "centroid"), threshold, by).select(F.col("id").alias(by), F.col("center").alias("merged_into"), "score")


def cluster_relevance(vectors: DataFrame, centers: DataFrame, citations: Column, difficulty: Column, by: str = "label") -> DataFrame:
    """Relevance of each member of a cluster: its citations against the cluster's most, difficulty, centrality."""
    rows = vectors.withColumn("cited", F.log1p(citations))
    most = rows.groupBy(by).agg(F.greatest(F.max("cited"), F.lit(1.0)).alias("most"))
    joined = rows.join(centers, by).join(most, by)
    return joined.select("id", by, "vec", relevance(F.when(F.col("cited") > 0, F.col("cited") / F.col("most")), difficulty, cosine(F.col("vec"), F.col("centroid"))).alias("relevance"))


def type_coverage(members: DataFrame, group: str, kind: str, score: str, least: int) -> DataFrame:
    """The ``least`` best of each kind in each group."""
    w = Window.partitionBy(group, kind).orderBy(F.desc(score), "id")
    return members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= least)


def _mmr(pick: int, weight: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf["vec"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        rel, most = pdf["relevance"].to_numpy(), np.zeros(len(pdf))
        chosen: list[int] = []
        while len(chosen) < min(pick, len(pdf)):
            value = rel.copy() if not chosen else weight * rel - (1 - weight) * most
            value[chosen] = -np.inf
            best = int(np.argmax(value))
            chosen.append(best)
            most = v @ v[best] if len(chosen) == 1 else np.maximum(most, v @ v[best])
        return pd.DataFrame({"label": key[0], "id": pdf["id"].to_numpy()[chosen], "place": range(1, len(chosen) + 1)})

    return run


def mmr(members: DataFrame, pick: int = 15, weight: float = 0.6, in_task: int = 2000) -> DataFrame:
    """Maximal marginal relevance in each label: the most relevant first, then relevance against likeness to those
    chosen, ties by relevance and id. Every member can be chosen. Groups of up to ``in_task`` members are chosen from in a
    task each; of larger ones every round takes the best of all members, distributed, and passes on only its vector."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    some = members.select("label", "id", "vec", "relevance").join(sizes, "label")
    small = some.where(F.col("_n") <= in_task).drop("_n").groupBy("label").applyInPandas(_mmr(pick, weight), "label int, id bigint, place int")
    if not sizes.where(F.col("_n") > in_task).take(1):
        return small
    base = cut(some.where(F.col("_n") > in_task).select("label", "id", F.transform("vec", lambda x: x.cast("double") / F.greatest(norm(F.col("vec")), F.lit(1e-12))).alias("v"), "relevance"), "members")
    chosen = None
    for place in range(1, pick + 1):
        rest, value = base, F.col("relevance")
        if chosen is not None:
            so_far = chosen.groupBy("label").agg(F.collect_list("v").alias("vs"), F.collect_list("id").alias("ids"))
            rest = base.join(so_far, "label").where(~F.array_contains("ids", F.col("id")))
            value = weight * F.col("relevance") - (1 - weight) * F.array_max(F.transform("vs", lambda o: F.aggregate(F.zip_with("v", o, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)))
        best = rest.groupBy("label").agg(F.max_by(F.struct("id", "v"), F.struct(value.alias("value"), "relevance", -F.col("id"))).alias("b"))
        best = cut(best.select("label", "b.id", "b.v", F.lit(place).alias("place")), "best")  # one row of each label
        chosen = best if chosen is None else chosen.unionByName(best)
    return small.unionByName(chosen.select("label", "id", "place"))


def kmeans(vectors: DataFrame, k: int, seed: int = 42, rounds: int = 100) -> DataFrame:
    """``id, cluster``: k-means over unit vectors."""
    unit = vectors.select("id", array_to_vector(F.transform("vec", lambda x: x.cast("double") / norm(F.col("vec")))).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds).fit(unit).transform(unit).select("id", F.col("prediction").alias("cluster"))


def best_k(vectors: DataFrame, choices: list[int], seed: int = 42) -> DataFrame:
    """Silhouette of k-means by number of clusters."""
    unit = vectors.select("id", array_to_vector(F.transform("vec", lambda x: x.cast("double") / norm(F.col("vec")))).alias("features"))
    scores = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed, maxIter=100).fit(unit).transform(unit)))) for k in choices]
    return vectors.sparkSession.createDataFrame(scores, "k int, silhouette double")
