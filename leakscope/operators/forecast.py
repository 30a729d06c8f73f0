"""Ridership and revenue forecasts with boosted trees."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressionModel, DecisionTreeRegressor,
                                   GBTRegressionModel, GBTRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope.operators.features import FORECAST_FEATURES

# Fixed values.
NUM_TREES = 30
LEARNING_RATE = 0.1
MAX_DEPTH = 5
MIN_LEAF_ROWS = 5
MAX_BINS = 16
TRAIN_SHARE = 0.8


def split_dates(events: DataFrame, share: float = TRAIN_SHARE, date_col: str = "sim_date") -> DataFrame:
    """Distinct dates with the set each belongs to: the first floor(share * n) train."""
    dates = events.select(F.col(date_col).alias("sim_date")).distinct()
    # one row per calendar day
    place = F.row_number().over(W.orderBy("sim_date"))
    return dates.select(
        "sim_date",
        F.when(place <= F.floor(F.count("*").over(W.partitionBy()) * share), "train")
        .otherwise("test").alias("part"))


def last_train_date(events: DataFrame, share: float = TRAIN_SHARE, date_col: str = "sim_date"):
    return (split_dates(events, share, date_col).filter("part = 'train'")
            .agg(F.max("sim_date")).first()[0])


def assemble(features: DataFrame, names: list[str] = FORECAST_FEATURES) -> DataFrame:
    filled = features.withColumns(
        {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})
    return VectorAssembler(inputCols=names, outputCol="x").transform(filled)


def training_cells(features: DataFrame, targets: list[str],
                   names: list[str] = FORECAST_FEATURES) -> DataFrame:
    """Training rows merged by equal features: mean of each target and row count.

    A split is chosen by the squared error it removes, and merging rows that no
    split can part changes that error by a constant.  Weighted by their count,
    the cells judge a split as the rows do; the candidate splits themselves are
    quantiles of the cells, so trees come close to those of the rows without
    always being equal.  There are as many
    cells as stops times hours times weekdays, so one pass over the events
    replaces a pass per tree level.
    """
    return features.groupBy(*names).agg(
        *[F.avg(t).alias(t) for t in targets], F.count("*").cast("double").alias("weight"))


def fit_boosted_trees(cells: DataFrame, target: str, seed: int = 42, num_trees: int = NUM_TREES,
                      learning_rate: float = LEARNING_RATE, max_depth: int = MAX_DEPTH,
                      names: list[str] = FORECAST_FEATURES,
                      subset: str = "sqrt") -> GBTRegressionModel:
    """Boosted regression trees over weighted cells; a leaf keeps at least five rows."""
    rows = cells.agg(F.sum("weight")).first()[0] or 1.0
    return GBTRegressor(
        featuresCol="x", labelCol=target, predictionCol="prediction", weightCol="weight",
        maxIter=num_trees, stepSize=learning_rate, maxDepth=max_depth, maxBins=MAX_BINS,
        minInstancesPerNode=1, minWeightFractionPerNode=min(0.49, MIN_LEAF_ROWS / rows),
        featureSubsetStrategy=subset, seed=seed).fit(assemble(cells, names))


def fit_tree(rows: DataFrame, target: str, max_depth: int = 6, seed: int = 42,
             names: list[str] = FORECAST_FEATURES) -> DecisionTreeRegressionModel:
    """One regression tree."""
    return DecisionTreeRegressor(
        featuresCol="x", labelCol=target, maxDepth=max_depth, maxBins=MAX_BINS,
        minInstancesPerNode=MIN_LEAF_ROWS, seed=seed).fit(assemble(rows, names))


def predict(model, features: DataFrame, name: str = "predicted",
            names: list[str] = FORECAST_FEATURES) -> DataFrame:
    """Features with the prediction; a narrow step over the rows."""
    keep = features.columns
    return (model.setPredictionCol("_p").transform(assemble(features, names))
            .select(*keep, F.col("_p").alias(name)))
