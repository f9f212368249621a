"""Learning operators: features, split, regression and its evaluation, collaborative filtering, TF-IDF, cold start."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import running
from .vectors import neighbours


def label_codes(items: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_code``: the place of a value among the sorted distinct ones (null counts as "unknown")."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
    codes = running(items.select(value.alias("_value")).distinct(), [F.asc("_value")], F.lit(1), f"{column}_code")
    return items.join(codes, value == F.col("_value")).drop("_value")


def item_features(items: DataFrame, kinds: list[str], texts: list[str], lists: list[str], flags: dict[str, Column], numbers: list[str]) -> tuple[DataFrame, list[str]]:
    """Numeric features of catalog items and their names: codes of categories, text lengths, list sizes, flags, numbers."""
    out = items
    for c in kinds:
        out = label_codes(out, c)
    out = out.withColumns({f"{c}_length": F.coalesce(F.length(c), F.lit(0)) for c in texts})
    out = out.withColumns({f"{c}_count": F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in lists})
    out = out.withColumns({k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in flags.items()})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers})
    return out, [*[f"{c}_code" for c in kinds], *[f"{c}_length" for c in texts], *[f"{c}_count" for c in lists], *flags, *numbers]


def stratified_split(items: DataFrame, key: str, stratum: Column, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``train``: of each stratum the given share by a seeded hash, the same on every run and cluster."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key), stratum.cast("string")), F.lit(1_000_000)) / 1_000_000
    return items.withColumn("train", place < share)


def regress(items: DataFrame, features: list[str], target: str, model: str = "tweedie"):
    """Fits on the rows with ``train`` and returns (all rows with a prediction of at least 0, the fitted pipeline)."""
    assembled = VectorAssembler(inputCols=features, outputCol="raw_features")
    scaled = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    learners = {
        "tweedie": GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol=target, maxIter=50, regParam=0.01),
        "ridge": LinearRegression(labelCol=target, regParam=10.0, elasticNetParam=0.0),
        "trees": GBTRegressor(labelCol=target, maxDepth=5, maxIter=100, stepSize=0.05, seed=42),
    }
    fitted = Pipeline(stages=[assembled, scaled, learners[model]]).fit(items.where("train"))
    return fitted.transform(items).withColumn("prediction", F.greatest("prediction", F.lit(0.0))), fitted


def evaluate(predicted: DataFrame, target: str) -> DataFrame:
    """RMSE, MAE, R2, the mean's RMSE, ROC-AUC and PR-AUC (of a positive target) on the rows not trained on."""
    held = predicted.where("NOT train")
    scores = {m: float(RegressionEvaluator(labelCol=target, metricName=m).evaluate(held)) for m in ("rmse", "mae", "r2")}
    mean = predicted.where("train").agg(F.avg(target)).first()[0]
    scores["rmse_of_mean"] = float(held.agg(F.sqrt(F.avg((F.col(target) - mean) ** 2))).first()[0])
    signs = held.withColumn("_y", (F.col(target) > 0).cast("double"))
    for m, name in (("areaUnderROC", "roc_auc"), ("areaUnderPR", "pr_auc")):
        scores[name] = float(BinaryClassificationEvaluator(labelCol="_y", rawPredictionCol="prediction", metricName=m).evaluate(signs))
    return predicted.sparkSession.createDataFrame(sorted(scores.items()), "metric string, value double")


def preferences(dwell: DataFrame, clicks: DataFrame, shown: DataFrame, searched: DataFrame) -> DataFrame:
    """``sid, item, rating`` of implicit feedback: seconds spent, 10 a click, 0.5 an impression, 5 a search click. Clicks and
    impressions without a session go to a pseudo-session of their item."""
    parts = [
        dwell.where("dwell_ms BETWEEN 1 AND 86400000").select(F.col("session_id").alias("sid"), F.lower(F.trim("name")).alias("item"), (F.col("dwell_ms") / 1000).alias("rating")),
        *[df.select("sid", F.lower(F.trim("name")).alias("item"), F.lit(w).alias("rating")) for df, w in ((clicks, 10.0), (shown, 0.5), (searched, 5.0))],
    ]
    for i in (1, 2):
        parts[i] = parts[i].withColumn("sid", F.coalesce("sid", F.concat(F.lit("without session: "), "item")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("sid IS NOT NULL AND item <> ''")
    return rows.groupBy("sid", "item").agg(F.sum("rating").alias("rating"))


def als_similar(ratings: DataFrame, top: int = 5, seed: int = 42, rounds: int = 15) -> DataFrame:
    """``item, similar, score, rank``: the items with the most similar ALS factors.

    Items and sessions are coded by 31-bit hashes, which ALS needs; a collision merges two items' feedback, with
    probability n / 2^31 for an item among n.
    """
    items = ratings.select("item").distinct()
    codes = items.withColumn("code", F.pmod(F.xxhash64("item"), F.lit((1 << 31) - 1)))
    users = ratings.select("sid").distinct().withColumn("user", F.pmod(F.xxhash64("sid"), F.lit((1 << 31) - 1)).cast("int"))
    data = ratings.join(codes, "item").join(users, "sid").select("user", F.col("code").cast("int").alias("code"), "rating")
    rank = max(5, min(32, items.count() - 1))
    model = ALS(implicitPrefs=True, rank=rank, regParam=0.1, maxIter=rounds, seed=seed, userCol="user", itemCol="code", ratingCol="rating").fit(data)
    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = model.itemFactors.withColumn("n", length).where("n > 0").select(F.col("id").cast("bigint").alias("id"), F.transform("features", lambda x: x / F.col("n")).alias("vec"))
    near = neighbours(unit, unit, top, 0.0)
    a, b = codes.select(F.col("item"), F.col("code").alias("src")), codes.select(F.col("item").alias("similar"), F.col("code").alias("dst"))
    return near.join(a, "src").join(b, "dst").select("item", "similar", "score", "rank")


def tfidf(items: DataFrame, text: str, features: int = 1000):
    """Items with a ``tfidf`` vector over one- and two-word terms (in at least 2 items and at most 80 % of them)."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern="\\W+")
    kept = StopWordsRemover(inputCol="_words", outputCol="_kept")
    pairs = NGram(n=2, inputCol="_kept", outputCol="_pairs")
    prepared = Pipeline(stages=[words, kept, pairs]).fit(items).transform(items).withColumn("_terms", F.concat("_kept", "_pairs"))
    counted = Pipeline(stages=[CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=features, minDF=2, maxDF=0.8), IDF(inputCol="_counts", outputCol="tfidf")]).fit(prepared)
    return counted.transform(prepared).drop("_words", "_kept", "_pairs", "_terms", "_counts"), counted


def cold_start(cold: DataFrame, observed: DataFrame, k: int = 5) -> DataFrame:
    """``id, score``: the similarity-weighted mean score of the ``k`` nearest observed items; the observed mean where none is near.

    ``cold`` has id and vec, ``observed`` also score."""
    near = neighbours(cold, observed, k, 0.0).join(observed.select(F.col("id").alias("dst"), F.col("score").alias("known")), "dst")
    mean = observed.agg(F.avg("score")).scalar()
    guess = near.groupBy(F.col("src").alias("id")).agg((F.sum(F.col("score") * F.col("known")) / F.sum("score")).alias("guess"))
    return cold.select("id").join(guess, "id", "left").select("id", F.coalesce(F.col("guess"), mean).alias("score"))
