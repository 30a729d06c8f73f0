"""Quality of forecasts and detections, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    mse = F.avg(error * error)
    return df.agg(F.avg(predicted).alias("mean_predicted"), mse.alias("mse"),
                  F.sqrt(mse).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
                  F.count("*").alias("n"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def detection_quality(df: DataFrame, label: Column, flag: Column) -> DataFrame:
    """Confusion counts, precision, recall and F1; 0 where a denominator is 0."""
    counts = df.agg(F.count_if(flag & label).alias("tp"), F.count_if(flag & ~label).alias("fp"),
                    F.count_if(~flag & ~label).alias("tn"), F.count_if(~flag & label).alias("fn"))
    tp = F.col("tp").cast("double")
    shares = counts.withColumns({"precision": _share(tp, F.col("tp") + F.col("fp")),
                                 "recall": _share(tp, F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return shares.withColumn("f1", _share(p * r * 2.0, p + r))
