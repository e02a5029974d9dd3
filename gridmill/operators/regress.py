"""Regression on design matrices.

Least squares needs only sums of products, so it is one aggregation with partial
sums on the executors and a small linear system (terms x terms) on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.plans.formula import Formula, design, parse


def least_squares(df: DataFrame, formula: str | Formula, ndv: float | None = None) -> DataFrame:
    """(term, coefficient, std_error, t, p_value, r2, aic, n); p-values by the normal approximation of t."""
    f = parse(formula) if isinstance(formula, str) else formula
    names = list(f.terms) + (["intercept"] if f.intercept else [])
    x = design(df, f, ndv).withColumn("intercept", F.lit(1.0))
    cols = [*names, "y"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = x.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), *[F.sum(F.col(a) * F.col(b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).first()
    n, k = row["n"], len(names)
    if n <= k:
        raise ValueError(f"{n} rows do not determine {k} coefficients")
    products = {p: row[f"p{i}"] for i, p in enumerate(pairs)}
    get = lambda a, b: products.get((a, b), products.get((b, a)))
    xx = np.array([[get(a, b) for b in names] for a in names])
    xy = np.array([get(a, "y") for a in names])
    beta = np.linalg.solve(xx, xy)
    rss = max(0.0, get("y", "y") - beta @ xy)
    tss = get("y", "y") - row["sy"] ** 2 / n if f.intercept else get("y", "y")
    error = np.sqrt(np.maximum(np.diag(np.linalg.inv(xx)) * rss / (n - k), 0))
    aic = n * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1) + 2 * k
    rows = [(t, float(b), float(e), float(b / e) if e else None, math.erfc(abs(b / e) / math.sqrt(2)) if e else None, float(1 - rss / tss) if tss else None, float(aic), n) for t, b, e in zip(names, beta, error, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, t double, p_value double, r2 double, aic double, n long")


def predict(df: DataFrame, formula: str | Formula, coefficients: dict[str, float]) -> DataFrame:
    """``df`` with ``predicted``: the sum of coefficients times terms."""
    f = parse(formula) if isinstance(formula, str) else formula
    total = F.lit(float(coefficients.get("intercept", 0.0)))
    for name, term in f.terms.items():
        total = total + F.lit(float(coefficients.get(name, 0.0))) * term.cast("double")
    return df.withColumn("predicted", total)


def logistic(df: DataFrame, formula: str | Formula, order: str, train_share: float = 0.75) -> tuple[dict[str, float], DataFrame]:
    """(coefficients, confusion counts): fitted on the first share of rows in ``order``, tested on the rest."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    f = parse(formula) if isinstance(formula, str) else formula
    cut = df.agg(F.percentile_approx(order, F.lit(train_share), F.lit(10_000)).alias("c")).first()["c"]
    assemble = VectorAssembler(inputCols=list(f.terms), outputCol="features")
    train, test = (assemble.transform(design(df.filter(c), f)) for c in (F.col(order) <= cut, F.col(order) > cut))
    model = LogisticRegression(labelCol="y", regParam=0.0, fitIntercept=f.intercept).fit(train)
    weights = dict(zip(f.terms, model.coefficients.toArray().tolist(), strict=True)) | {"intercept": float(model.intercept)}
    return weights, model.transform(test).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


def lasso(df: DataFrame, formula: str | Formula, folds: int = 5, strengths: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0), seed: int = 7) -> tuple[dict[str, float], DataFrame]:
    """(coefficients of the cross-validated lasso, least squares on the terms that it keeps)."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    f = parse(formula) if isinstance(formula, str) else formula
    data = VectorAssembler(inputCols=list(f.terms), outputCol="features").transform(design(df, f))
    base = LinearRegression(labelCol="y", elasticNetParam=1.0, fitIntercept=f.intercept)
    grid = ParamGridBuilder().addGrid(base.regParam, list(strengths)).build()
    best = CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y"), numFolds=folds, seed=seed).fit(data).bestModel
    weights = dict(zip(f.terms, best.coefficients.toArray().tolist(), strict=True))
    kept = Formula(f.dependent, {k: v for k, v in f.terms.items() if abs(weights[k]) > 1e-9} or f.terms, f.masks, f.intercept)
    return weights, least_squares(df, kept)
