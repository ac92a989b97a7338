"""Train-only scaling, binary models and evaluation of pair representations."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_stats(rows: DataFrame, column: str, width: int, by: list[str]) -> DataFrame:
    """Mean and population deviation of each coordinate of an array column, as arrays, in one aggregation without exploding."""
    at = [F.element_at(column, i + 1) for i in range(width)]
    return rows.groupBy(*by).agg(F.array(*(F.avg(x) for x in at)).alias("mean"), F.array(*(F.stddev_pop(x) for x in at)).alias("sd"))


def scaled(rows: DataFrame, stats: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Rows with the column standardised by ``stats``; a coordinate without spread is only centred.  ``stats`` has one row per group of ``by``."""
    joined = rows.join(F.broadcast(stats), by) if by else rows.join(F.broadcast(stats))
    safe = F.transform("sd", lambda s: F.when(s > 0, s).otherwise(1.0))
    z = F.zip_with(F.zip_with(F.col(column), F.col("mean"), lambda x, m: x - m), safe, lambda x, s: x / s)
    return joined.withColumn(column, z).drop("mean", "sd")


def fit(train: DataFrame, kind: str = "logistic", width: int = 0):
    """A fitted classifier of ``train(x array<double>, label)``."""
    models = {
        "logistic": lambda: LogisticRegression(featuresCol="features", labelCol="label", maxIter=25, regParam=1e-3, standardization=False),
        "gbt": lambda: GBTClassifier(featuresCol="features", labelCol="label", maxDepth=4, maxIter=20, stepSize=0.1, subsamplingRate=0.8, seed=42),
        "mlp": lambda: MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[width, 32, 2], maxIter=50, seed=42),
    }
    if kind not in models:
        raise ValueError(f"unknown model: {kind!r}")
    return models[kind]().fit(train.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label")))


def score(model, test: DataFrame) -> DataFrame:
    """Test rows with ``score`` (probability of label 1) and ``predicted``."""
    out = model.transform(test.withColumn("features", array_to_vector("x")))
    return out.withColumn("score", F.element_at(vector_to_array("probability"), 2)).withColumn("predicted", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    y, p = F.col("label") == 1, F.col("predicted") == 1
    return scored.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
