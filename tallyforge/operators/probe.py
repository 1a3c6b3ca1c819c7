"""Probes of how well a label is recovered from features, and a registry of regressors.

The probe is a pipeline of standardisation, an optional projection onto principal components and
a class-balanced logistic model, fitted in each fold on the other folds, repeated with other
seeds, against the balanced accuracy of always naming the largest class.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import leakage_score, severity
from .model import group_folds, stratified_folds

#: Rows of one task of a fit.
ROWS = 10_000


def make_model(name: str, seed: int = 0):
    """A regressor by name; ``knn`` and the exact ridge are functions of ``model``."""
    common = {"featuresCol": "features", "labelCol": "target"}
    if name == "ridge":
        return LinearRegression(regParam=1.0, elasticNetParam=0.0, standardization=True, solver="normal", **common)
    if name == "forest":
        return RandomForestRegressor(numTrees=300, minInstancesPerNode=2, maxDepth=15, featureSubsetStrategy="all", seed=seed, **common)
    if name == "gradient_boosting":
        return GBTRegressor(maxIter=200, maxDepth=2, stepSize=0.05, seed=seed, **common)
    raise ValueError(f"unknown model {name}; there are ridge, forest and gradient_boosting")


def held_out_predictions(df: DataFrame, fold: str, features: str, target: str, name: str, seed: int = 0) -> DataFrame:
    """``df`` (features: array of double) with ``prediction`` by a model of the other folds.

    A model reads all rows in each of its hundreds of steps, so rows are spread over a task for every ``ROWS`` of them, however few files hold them.
    """
    ready = df.withColumns({"features": array_to_vector(F.col(features).cast("array<double>")), "target": F.col(target).cast("double")})
    tasks = -(-ready.count() // ROWS)
    if tasks > 1:
        ready = ready.repartition(tasks)
    ready = ready.cache()
    out = None
    for (f,) in sorted(ready.select(fold).distinct().collect()):  # as many as there are folds
        model = make_model(name, seed).fit(ready.where(F.col(fold) != f))
        part = model.transform(ready.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out.drop("features", "target")


def probe(df: DataFrame, label: str, vector: str, key: str, folds: int = 3, seed: int = 17, repeats: int = 1, components: int | None = None, group: str | None = None) -> DataFrame:
    """(repeat, fold, balanced_accuracy, chance) of each fit.

    A label needs two rows at least; the number of folds is capped by the rarest label's rows.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
    if sizes.k < 2 or sizes.least < 2:
        raise ValueError("a probe needs two labels with two rows each")
    folds = min(folds, sizes.least)
    spark = df.sparkSession
    x = df.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    x = StringIndexer(inputCol=label, outputCol="_y").fit(x).transform(x)
    rows = []
    for repeat in range(repeats):
        dealt = (group_folds(x, group, folds) if group else stratified_folds(x, label, key, folds, seed + repeat)).cache()
        for f in range(folds):
            train, test = dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f)
            counts = train.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
            total = train.count()
            weighted = train.join(F.broadcast(counts), "_y").withColumn("_w", F.lit(total) / (sizes.k * F.col("_n")))  # one row per label
            stages = [StandardScaler(inputCol="_x", outputCol="_s", withMean=True)]
            if components:
                stages = [PCA(k=components, inputCol="_x", outputCol="_p"), StandardScaler(inputCol="_p", outputCol="_s", withMean=True)]
            stages.append(LogisticRegression(featuresCol="_s", labelCol="_y", weightCol="_w", regParam=1 / max(total, 1), standardization=False, maxIter=200, family="binomial" if sizes.k == 2 else "multinomial"))
            done = Pipeline(stages=stages).fit(weighted).transform(test)
            recall = done.groupBy("_y").agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("r"))
            rows.append((repeat, f, recall.agg(F.avg("r")).first()[0], 1 / recall.count()))
        dealt.unpersist()
    return spark.createDataFrame(rows, "repeat int, fold int, balanced_accuracy double, chance double")


def metric_summary(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, population deviation, least and greatest."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def audit(df: DataFrame, feature_sets: dict[str, str], label: str, key: str, **options) -> DataFrame:
    """(feature_set, balanced_accuracy, chance, score, severity), worst first."""
    out = None
    for name, vector in feature_sets.items():
        row = probe(df, label, vector, key, **options).agg(F.avg("balanced_accuracy").alias("balanced_accuracy"), F.avg("chance").alias("chance")).withColumn("feature_set", F.lit(name))
        out = row if out is None else out.unionByName(row)
    out = out.withColumn("score", leakage_score(F.col("balanced_accuracy"), F.col("chance"))).withColumn("severity", severity(F.col("score")))
    return out.select("feature_set", "balanced_accuracy", "chance", "score", "severity").orderBy(F.desc("score"), "feature_set")


def control_efficacy(report: DataFrame, pairs: DataFrame, neutral: float = 0.15) -> DataFrame:
    """Of (raw, control) pairs of feature sets: both scores, absolute and relative reduction, and whether the control is below the bound."""
    a = report.select(F.col("feature_set").alias("raw"), F.col("score").alias("raw_score"))
    b = report.select(F.col("feature_set").alias("control"), F.col("score").alias("control_score"))
    met = pairs.join(a, "raw").join(b, "control")
    less = F.col("raw_score") - F.col("control_score")
    return met.select("raw", "control", "raw_score", "control_score", less.alias("reduction"), F.when(F.col("raw_score") > 0, less / F.col("raw_score")).alias("relative_reduction"), (F.col("control_score") < neutral).alias("neutralized"))


def linear_forecast(df: DataFrame, unit: str, x: str, y: str, start: float, least: int = 3) -> DataFrame:
    """Each unit's rows from ``start`` on with the value that a line through its earlier rows (at
    least ``least``) forecasts, and the absolute error: the cheap baseline of a forecast."""
    line = df.where(F.col(x) < start).groupBy(unit).agg(F.regr_slope(F.col(y), F.col(x)).alias("_b"), F.regr_intercept(F.col(y), F.col(x)).alias("_a"), F.count(F.lit(1)).alias("_n"))
    met = df.where(F.col(x) >= start).join(line.where(F.col("_n") >= least), unit)
    forecast = F.col("_a") + F.col("_b") * F.col(x)
    return met.withColumns({"forecast": forecast, "error": F.abs(forecast - F.col(y))}).drop("_a", "_b", "_n")
