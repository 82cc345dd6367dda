"""A fit that follows new bars without reading the old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcast.config import Settings
from seqcast.operators.ordering import number_rows
from seqcast.plans.panel import PanelFit, fit_from_profile


def add_to_profile(clean: DataFrame, features: Sequence[str], path: str, batch: str) -> None:
    """Add what a fit needs to know of a batch of prepared bars: a row per date with its number of bars and each feature's range.

    A batch has a folder of its own, so one that is added again replaces itself, and a lost write leaves the others as they are.
    """
    ranges = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("min", F.min), ("max", F.max))]
    (clean.groupBy("Date").agg(F.count(F.lit(1)).alias("rows"), *ranges).withColumn("batch", F.lit(batch))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def kept_profile(spark: SparkSession, features: Sequence[str], path: str) -> DataFrame:
    """The calendar and ranges of all batches so far; a date may be in several."""
    ranges = [f(f"{c}_{n}").alias(f"{c}_{n}") for c in features for n, f in (("min", F.min), ("max", F.max))]
    daily = spark.read.parquet(path).groupBy("Date").agg(F.sum("rows").alias("rows"), *ranges)
    return number_rows(daily, "Date", cells={"hour": F.substring(F.date_format("Date", "yyyy-MM-dd HH:mm"), 1, 13)})


def fit_kept(spark: SparkSession, settings: Settings, path: str) -> PanelFit:
    """The fit that a pass over all bars would find."""
    return fit_from_profile(kept_profile(spark, settings.features, path), settings)
