"""Bars as a table that is laid out for reading: pruned by year, bucketed and sorted by series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_store(bars: DataFrame, name: str, path: str, buckets: int) -> None:
    """Write bars (``Symbol``, ``Date`` and values) as the table ``name`` at ``path``.

    A folder per year; in each the series are dealt to ``buckets`` files by a hash of their symbol and sorted by date. The exchange that windows need is
    made here, once. Each bucket is written by one task, so a series should not hold much more than a bucket's share; one that does is cut by
    ``operators.windows.sequences`` instead.
    """
    (bars.withColumn("year", F.year("Date")).repartition(buckets, "Symbol").write.mode("overwrite").option("path", path)
     .partitionBy("year").bucketBy(buckets, "Symbol").sortBy("Symbol", "Date").saveAsTable(name))


def read_store(spark: SparkSession, name: str, first: datetime | None = None, last: datetime | None = None) -> DataFrame:
    """Bars of the table, of the dates from ``first`` to ``last``. Years outside are not read."""
    bars = spark.table(name)
    for bound, after in ((first, True), (last, False)):
        if bound is not None:
            date, at = F.col("Date"), F.lit(bound).cast("timestamp_ntz")
            bars = bars.where((date >= at) & (F.col("year") >= bound.year) if after else (date <= at) & (F.col("year") <= bound.year))
    return bars.drop("year")


def stored_sequences(rows: DataFrame, features: Sequence[str], target: str, window: int) -> DataFrame:
    """``sequences`` of rows that come from a store: the files of a bucket hold whole series, so nothing moves.

    ``rows`` has ``split``, ``Symbol``, ``Date`` and the feature columns, one row per symbol and date; the split is a function of the date.
    """
    series = Window.partitionBy("split", "Symbol").orderBy("Date")
    numbered = rows.select("split", "Symbol", "Date", F.array(*features).alias("_bar"), F.col(target).alias("y"), (F.row_number().over(series) - 1).alias("position"))
    return (numbered.withColumn("x", F.collect_list("_bar").over(series.rowsBetween(-window, -1)))
            .filter(F.col("position") >= window).select("split", "Symbol", "Date", F.col("position").cast("long").alias("position"), "x", "y"))
