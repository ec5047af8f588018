"""Models: congestion, disruption, volatility and company impact, and their metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Rows of a part of the training rows at most, where cores alone would make larger ones.
PART_ROWS = 4_000_000


def _steps(features: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        estimator,
    ])


def split_rows(df: DataFrame, key: Sequence[str], test: float = 0.2, seed: int = SEED, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split by a seeded hash of the row key: the same rows on every run and retry.

    The shares hold within each label value in expectation, not exactly: a rare
    label may lack rows on one side. Rows without ``label`` are left out.
    """
    rows = df.where(F.col(label).isNotNull()) if label else df
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(10_000)) / 10_000.0
    return rows.where(u >= test), rows.where(u < test)


def packed(rows: DataFrame, n: int, part_rows: int = PART_ROWS) -> DataFrame:
    """The same ``n`` rows in as many parts as there are cores, more only for parts above ``part_rows``.

    Trees are grown in hundreds of jobs that each send a result per part to the
    driver, so their number follows the cluster and not the files of the input.
    """
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / part_rows)))


def forest_regressor(features: Sequence[str], label: str, trees: int = 100, depth: int = 10) -> Pipeline:
    return _steps(features, RandomForestRegressor(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=1.0,
        cacheNodeIds=True))


def boosted_classifier(features: Sequence[str], label: str, iterations: int = 100, depth: int = 6, step: float = 0.1) -> Pipeline:
    return _steps(features, GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=step, seed=SEED, cacheNodeIds=True))


def linear_regressor(features: Sequence[str], label: str) -> Pipeline:
    return _steps(features, LinearRegression(featuresCol="features", labelCol=label))


def train_regression(df: DataFrame, pipeline: Pipeline, label: str, key: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """Fitted model and one row of train and test scores."""
    train, test = split_rows(df, key, label=label)
    train, test = train.persist(), test.persist()
    sizes = train.count(), test.count()
    model = pipeline.fit(packed(train, sizes[0]))

    def score(rows, metric):
        return RegressionEvaluator(labelCol=label, metricName=metric).evaluate(model.transform(rows))

    report = df.sparkSession.createDataFrame(
        [(type(model.stages[-1]).__name__, sum(sizes), score(train, "r2"), score(test, "r2"), score(test, "mse"))],
        "model string, samples bigint, train_r2 double, test_r2 double, test_mse double")
    for rows in (train, test):
        rows.unpersist()
    return model, report


def train_classifier(df: DataFrame, pipeline: Pipeline, label: str, key: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """Fitted model with accuracy and AUC (0.5 when the test rows hold one class)."""
    train, test = split_rows(df, key, label=label)
    train, test = train.persist(), test.persist()
    sizes = train.count(), test.count()
    model = pipeline.fit(packed(train, sizes[0]))
    predicted = model.transform(test).persist()
    facts = predicted.agg(
        F.count_distinct(label).alias("classes"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")).first()
    auc = BinaryClassificationEvaluator(labelCol=label).evaluate(predicted) if facts["classes"] == 2 else 0.5
    report = df.sparkSession.createDataFrame(
        [(type(model.stages[-1]).__name__, sum(sizes), facts["accuracy"], auc)],
        "model string, samples bigint, accuracy double, auc double")
    for rows in (train, test, predicted):
        rows.unpersist()
    return model, report


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Feature importances, strongest first."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((c, float(v)) for c, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Predictions (with the probability of class 1 where the model has one) beside the input columns."""
    scored = model.transform(df)
    extra = [vector_to_array("probability")[1].alias("probability_1")] if "probability" in scored.columns else []
    return scored.select(*df.columns, F.col("prediction").alias(out), *extra)


def train_all(trainers: Mapping[str, Callable[[], tuple[PipelineModel, DataFrame]]], existing: Mapping[str, PipelineModel] | None = None,
              retrain: bool = False) -> dict[str, PipelineModel]:
    """Train each named model unless it exists already."""
    models = dict(existing or {})
    for name, trainer in trainers.items():
        if retrain or name not in models:
            models[name] = trainer()[0]
    return models


def save_models(models: Mapping[str, PipelineModel], root: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{root}/{name}")


def load_models(names: Sequence[str], root: str) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{root}/{name}") for name in names}


def cross_validate(df: DataFrame, pipeline: Pipeline, label: str, key: Sequence[str], folds: int = 5, metric: str = "r2") -> DataFrame:
    """Score of every fold, and the mean and deviation over all folds in each row.

    Folds are hashes of the row key: the same on every run and retry.
    """
    fold = F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(folds)).cast("int")
    rows = df.where(F.col(label).isNotNull()).withColumn("_fold", fold)
    evaluator = RegressionEvaluator(labelCol=label, metricName=metric)
    scores = [float(evaluator.evaluate(pipeline.fit(rows.where(F.col("_fold") != k)).transform(rows.where(F.col("_fold") == k)))) for k in range(folds)]
    mean = sum(scores) / folds
    std = (sum((x - mean) ** 2 for x in scores) / max(1, folds - 1)) ** 0.5
    return df.sparkSession.createDataFrame([(k, x, mean, std) for k, x in enumerate(scores)], "fold int, score double, mean_score double, std_score double")


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, precision, recall and F1 from one pass of counts."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = df.agg(
        F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.count_if(y == p).alias("right"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.select(
        "n", F.try_divide("right", "n").alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MSE, MAE and R2 in one pass."""
    e = F.col(label) - F.col(prediction)
    return df.agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count(label))).alias("r2"))


def simple_regression(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """One-feature least squares as a plain aggregate."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))
