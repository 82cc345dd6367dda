"""Forecast errors and epoch losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("MSE", "RMSE", "MAE", "MAPE")


def mape(y: Column, p: Column) -> Column:
    """Mean absolute percentage error over rows with a non-zero truth, 0 when there is none."""
    return F.coalesce(F.avg(F.when(y != 0, F.abs((y - p) / y))) * 100, F.lit(0.0))


def metric_columns(y: Column, p: Column) -> list[Column]:
    mse = F.avg((y - p) * (y - p))
    return [mse.alias("MSE"), F.sqrt(mse).alias("RMSE"), F.avg(F.abs(y - p)).alias("MAE"), mape(y, p).alias("MAPE")]


def regression_metrics(forecasts: DataFrame, *by: str, truth: str = "y_actual",
                       prediction: str = "y_pred") -> DataFrame:
    """All four metrics in one aggregate, overall or by group."""
    return forecasts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *metric_columns(F.col(truth), F.col(prediction)))


def batch_losses(errors: DataFrame) -> DataFrame:
    """Mean squared error and size of each batch. ``errors`` has epoch, rank, batch and error."""
    return errors.groupBy("epoch", "rank", "batch").agg(
        F.avg(F.col("error") * F.col("error")).alias("loss"), F.count(F.lit(1)).alias("size"))


def weighted_epoch_loss(losses: DataFrame) -> DataFrame:
    """Mean over samples."""
    return losses.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("size")) / F.sum("size")).alias("loss"))


def rank_epoch_loss(losses: DataFrame) -> DataFrame:
    """Mean over a rank's batches, whatever their sizes."""
    return losses.groupBy("epoch", "rank").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def reduced_epoch_loss(losses: DataFrame) -> DataFrame:
    """Mean over ranks of the ranks' means, which is not the mean over all batches."""
    return rank_epoch_loss(losses).groupBy("epoch").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("world_size"))
