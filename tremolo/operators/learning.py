"""Classification, regression and mixtures of feature rows, on Spark's own learners.

``rows(id, unit_of, label, x array<double>)``: ``unit_of`` names what must not be split between training
and test (a recording or culture). Folds are dealt by it, so that no recording is on both sides. Rows
with a null label or vector are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IndexToString, MinMaxScaler, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut

METHODS = ("forest", "svm", "bayes", "logistic")


def _ready(rows: DataFrame) -> DataFrame:
    fine = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.where(F.col("label").isNotNull() & F.col("unit_of").isNotNull() & fine).withColumn("raw", array_to_vector("x"))


def folds(rows: DataFrame, k: int = 0, spread: bool = True) -> DataFrame:
    """``rows`` with a column fold: by recording, ``k`` of them with labels spread evenly (each label's
    recordings are dealt in turn, in order of a hash; ``spread=False``: all in one turn, for labels that
    are numbers), or with k = 0 one for each recording (N6)."""
    owners = rows.groupBy("unit_of").agg(F.min("label").alias("l"))
    turn = F.row_number().over(Window.partitionBy(*(["l"] if k and spread else [])).orderBy(F.xxhash64("unit_of"), "unit_of")) - 1  # a row for each recording
    dealt = owners.select(F.col("unit_of").alias("o"), (turn % k if k else turn).cast("int").alias("fold"))
    return rows.join(dealt, F.col("unit_of") == F.col("o")).drop("o")


def _learner(method: str, trees: int, seed: int):  # noqa: ANN202
    if method == "forest":
        return RandomForestClassifier(featuresCol="f", labelCol="y", numTrees=trees, maxDepth=10, seed=seed)
    if method == "bayes":
        return NaiveBayes(featuresCol="f", labelCol="y", modelType="gaussian")
    if method == "logistic":
        return LogisticRegression(featuresCol="f", labelCol="y", regParam=0.01)
    if method == "svm":
        return OneVsRest(classifier=LinearSVC(featuresCol="f", labelCol="y", regParam=0.01), featuresCol="f", labelCol="y")
    raise ValueError(f"method is one of {', '.join(METHODS)}")


def classify(train: DataFrame, test: DataFrame, method: str = "forest", trees: int = 100, seed: int = 1) -> DataFrame:
    """``test`` with the column predicted, by a model of ``train`` (L7, L13). Features are scaled by the
    training rows alone."""
    train, test = _ready(train), test.withColumn("raw", array_to_vector("x"))
    names = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(train.withColumn("label", F.col("label").cast("string")))
    scale = StandardScaler(inputCol="raw", outputCol="f", withMean=True).fit(train)
    known = names.transform(scale.transform(train).withColumn("label", F.col("label").cast("string")))
    model = _learner(method, trees, seed).fit(known)
    out = model.transform(scale.transform(test))
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels)
    return back.transform(out).select(*[c for c in test.columns if c != "raw"], "predicted")


def cross_classify(rows: DataFrame, method: str = "forest", k: int = 5, trees: int = 100, seed: int = 1) -> DataFrame:
    """(id, unit_of, fold, label, predicted): each fold predicted by a model of the others (L8, L18)."""
    dealt = cut(folds(rows.where(F.col("label").isNotNull() & F.col("unit_of").isNotNull() & F.col("x").isNotNull()), k))
    parts = sorted(r["fold"] for r in dealt.select("fold").distinct().collect())  # a row for each fold
    done = [classify(dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f), method, trees, seed) for f in parts]
    return reduce(DataFrame.unionByName, done).select("id", "unit_of", "fold", F.col("label").cast("string").alias("label"), "predicted")


def permutation_importance(train: DataFrame, test: DataFrame, method: str = "forest", trees: int = 100, seed: int = 1) -> DataFrame:
    """(feature, importance): accuracy on ``test`` less the accuracy when that feature's values are dealt
    to other rows, all features with one model each row (L9). Values move along a random order of rows."""
    base = cut(test.where(F.col("label").isNotNull()).select("id", "label", "unit_of", "x"))
    d = len(base.first()["x"])
    order = Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id")  # the test rows of one assessment
    moved = base.withColumn("next", F.coalesce(F.lead("x").over(order), F.first("x").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    mixed = F.explode(F.transform(F.sequence(F.lit(-1), F.lit(d - 1)), lambda j: F.struct(j.alias("feature"), F.transform("x", lambda v, i: F.when(i == j, F.get("next", i)).otherwise(v)).alias("x"))))
    found = classify(train, moved.select("id", "label", "unit_of", mixed.alias("m")).select("id", "label", "unit_of", "m.feature", "m.x"), method, trees, seed)
    right = found.groupBy("feature").agg(F.avg((F.col("predicted") == F.col("label").cast("string")).cast("double")).alias("a"))
    return right.where("feature >= 0").crossJoin(F.broadcast(right.where("feature < 0").select(F.col("a").alias("whole")))).select("feature", (F.col("whole") - F.col("a")).alias("importance"))


def cross_regress(rows: DataFrame, k: int = 5, trees: int = 100, seed: int = 1) -> DataFrame:
    """(id, unit_of, fold, label, predicted): regression of a numeric label by bagged trees, fold by fold
    (L16, L17)."""
    dealt = cut(folds(_ready(rows), k, spread=False))
    done = []
    for f in sorted(r["fold"] for r in dealt.select("fold").distinct().collect()):  # a row for each fold
        model = RandomForestRegressor(featuresCol="raw", labelCol="y", numTrees=trees, maxDepth=10, seed=seed).fit(dealt.where(F.col("fold") != f).withColumn("y", F.col("label").cast("double")))
        done.append(model.transform(dealt.where(F.col("fold") == f)).select("id", "unit_of", "fold", F.col("label").cast("double").alias("label"), F.col("prediction").alias("predicted")))
    return reduce(DataFrame.unionByName, done)


def mixture(vectors: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5), seed: int = 1) -> DataFrame:
    """(id, cluster, probability, k, silhouette): Gaussian mixtures of ``vectors(id, x)``, of the number of
    clusters whose silhouette is largest (L4)."""
    fine = vectors.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).withColumn("raw", array_to_vector(F.col("x").cast("array<double>")))
    fine = cut(MinMaxScaler(inputCol="raw", outputCol="features").fit(fine).transform(fine).select("id", "features"))
    best = None
    for k in ks:
        out = GaussianMixture(k=k, seed=seed, maxIter=60).fit(fine).transform(fine)
        many = out.select("prediction").distinct().count()
        score = ClusteringEvaluator().evaluate(out) if many > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, k, out)
    score, k, out = best
    return out.select("id", F.col("prediction").alias("cluster"), F.array_max(vector_to_array("probability")).alias("probability"), F.lit(k).alias("k"), F.lit(float(score)).alias("silhouette"))
