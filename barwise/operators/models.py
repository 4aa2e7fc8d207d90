"""Fold-local classifiers: fit on training rows only, score validation and test rows.

Logistic models of all (fold, candidate, ...) groups are fitted together.
Newton steps need only sums of products per group, which are partial
aggregations of any number of rows; one small linear system per group is then
solved in a grouped function over a single row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwise.functions.rolling import safe_div
from barwise.session import ensure_checkpoint_dir


def scaling(train: DataFrame, features: list[str], groups) -> DataFrame:
    """Median, mean and population deviation (after imputation) of every feature per group."""
    med = train.groupBy(*groups).agg(F.array(*[F.coalesce(F.percentile(f, F.lit(0.5)), F.lit(0.0)) for f in features]).alias("_med"))
    x = train.join(med, list(groups))
    filled = [F.coalesce(F.col(f), F.col("_med")[i]) for i, f in enumerate(features)]
    moments = x.groupBy(*groups).agg(F.array(*[F.avg(c) for c in filled]).alias("_mean"),
                                     F.array(*[F.stddev_pop(c) for c in filled]).alias("_sd"))
    return med.join(moments, list(groups))


def standardise(df: DataFrame, features: list[str], scale: DataFrame, groups) -> DataFrame:
    """Array column ``_z``: intercept followed by the standardised features."""
    x = df.join(scale, list(groups))
    cells = [F.coalesce(safe_div(F.coalesce(F.col(f), F.col("_med")[i]) - F.col("_mean")[i], F.col("_sd")[i]), F.lit(0.0))
             for i, f in enumerate(features)]
    return x.withColumn("_z", F.array(F.lit(1.0), *cells)).drop("_med", "_mean", "_sd")


def _linear(coef: str) -> Column:
    return F.aggregate(F.zip_with("_z", coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def fit_logistic(train: DataFrame, features: list[str], label: str, groups, c: float = 1.0, steps: int = 25,
                 tol: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(scaling, coefficients) per group; ridge penalty 1/C on all but the intercept."""
    ensure_checkpoint_dir(train.sparkSession)
    groups = list(groups)
    scale = scaling(train, features, groups).checkpoint()
    rows = standardise(train.where(F.col(label).isNotNull()), features, scale, groups).select(
        *groups, "_z", F.col(label).cast("double").alias("_y")).checkpoint()
    p = len(features) + 1
    coef = rows.select(*groups).distinct().withColumn("_b", F.array(*[F.lit(0.0)] * p)).withColumn("_move", F.lit(1.0))
    fields = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.array(pdf["_b"].iat[0])
        hess = np.zeros((p, p))
        for v, (i, j) in zip(pdf["_h"].iat[0], pairs):
            hess[i, j] = hess[j, i] = v
        ridge = np.full(p, 1.0 / c)
        ridge[0] = 0.0
        step = np.linalg.solve(hess + np.diag(ridge + 1e-12), np.array(pdf["_g"].iat[0]) - ridge * b)
        return pdf[groups].assign(_b=[(b + step).tolist()], _move=[float(np.abs(step).max())])
    for _ in range(steps):
        x = rows.join(coef.drop("_move"), groups).withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-_linear("_b"))))
        w = F.col("_p") * (1.0 - F.col("_p"))
        sums = x.groupBy(*groups).agg(
            F.first("_b").alias("_b"), F.array(*[F.sum((F.col("_y") - F.col("_p")) * F.col("_z")[i]) for i in range(p)]).alias("_g"),
            F.array(*[F.sum(w * F.col("_z")[i] * F.col("_z")[j]) for i, j in pairs]).alias("_h"))
        coef = sums.groupBy(*groups).applyInPandas(solve, f"{fields}, _b array<double>, _move double").checkpoint()
        if not coef.where(F.col("_move") > tol).limit(1).count():
            break
    else:
        raise ValueError(f"logistic fits that did not converge in {steps} steps: {coef.where(F.col('_move') > tol).count()}")
    return scale, coef.drop("_move")


def predict_logistic(df: DataFrame, features: list[str], scale: DataFrame, coef: DataFrame, groups, name: str = "p") -> DataFrame:
    x = standardise(df, features, scale, list(groups)).join(coef, list(groups))
    return x.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-_linear("_b")))).drop("_z", "_b")


def boosted_trees(train: DataFrame, score: DataFrame, features: list[str], label: str, seed: int = 42, trees: int = 20,
                  depth: int = 3, rate: float = 0.1, name: str = "p") -> DataFrame:
    """Gradient-boosted trees of one training set on Spark ML, with median imputation fitted on it."""
    filled = [f"_i_{f}" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled, relativeError=1e-4),
              VectorAssembler(inputCols=filled, outputCol="_vec", handleInvalid="keep"),
              GBTClassifier(featuresCol="_vec", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]
    model = Pipeline(stages=stages).fit(train.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")))
    scored = model.transform(score.drop(label))
    keep = [c for c in score.columns if c != label]
    return scored.select(*keep, vector_to_array("probability")[1].alias(name))
