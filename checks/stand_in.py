"""Bar tables, and tables of runs, made from the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqcast.config import Settings
from seqcast.functions.lstm import Weights
from seqcast.plans.panel import Panel, build_panel

KEPT = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
SETTINGS = Settings(symbols=KEPT)
# The second panel's series are cut into many blocks.
HOURLY = Settings(symbols=("click", "error", "purchase", "view"), block_rows=64, cell_rows=100)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, symbol: Column, date: Column, price: str, order: str) -> DataFrame:
    p = F.col(price)
    return rows.groupBy(symbol.alias("Symbol"), date.alias("Date")).agg(
        F.min_by(p, order).alias("Open"), F.max(p).alias("High"), F.min(p).alias("Low"),
        F.max_by(p, order).alias("Close"), F.count(F.lit(1)).cast("double").alias("Volume"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day: symbol is the priority, a day's price moves by order key."""
    return _bars(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"),
                 "o_totalprice", "o_orderkey")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour: symbol is the event type, an hour's value moves by event id."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return _bars(table(spark, sf_dir, "events"), F.col("event_type"), hour, "value", "event_id")


def daily_panel(spark: SparkSession, sf_dir: str, settings: Settings = SETTINGS) -> Panel:
    return build_panel(daily_bars(spark, sf_dir), settings)


def hourly_panel(spark: SparkSession, sf_dir: str, settings: Settings = HOURLY) -> Panel:
    return build_panel(hourly_bars(spark, sf_dir), settings)


def persistence(panel: Panel, split: str | None = None) -> DataFrame:
    """Each sequence's target, and the target feature one step earlier as its forecast."""
    value, place = F.col(f"{panel.settings.target}_scaled"), Window.partitionBy("split", "Symbol").orderBy("Date")
    return (panel.scaled(split).select("split", "Symbol", "Date", value.alias("y"), F.lag(value).over(place).alias("p"),
                                       F.row_number().over(place).alias("place"))
            .filter(F.col("place") > panel.settings.window).drop("place"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a log of runs, told apart by order and line."""
    f = F.col
    return table(spark, sf_dir, "lineitem").select(
        f("l_orderkey"), f("l_linenumber"),
        F.when(f("l_linestatus") == "F", "distributed").otherwise("standalone").alias("run_type"),
        f("l_linenumber").alias("num_processes"), f("l_returnflag").alias("storage"),
        F.array("l_returnflag", "l_linestatus").alias("symbols"),
        f("l_partkey").alias("n_samples"), (f("l_extendedprice") / 7).alias("training_time_seconds"),
        f("l_linenumber").alias("stopped_epoch"), f("l_shipdate").alias("finished"),
        (f("l_quantity") * f("l_quantity") / 7).alias("MSE"), (f("l_quantity") / 7).alias("RMSE"),
        (f("l_tax") / 7).alias("MAE"), (f("l_discount") * 100 / 7).alias("MAPE"))


def curves(spark: SparkSession, sf_dir: str, run: str = "o_custkey") -> DataFrame:
    """Orders as learning curves: a customer is a run, a month since 1995 an epoch.

    Losses are square roots: a short decimal could end right between two printed values,
    where engines round differently.
    """
    epoch = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    price = F.avg("o_totalprice")
    return (table(spark, sf_dir, "orders")
            .groupBy(F.col(run).cast("string").alias("run_id"), epoch.alias("epoch"))
            .agg((F.sqrt(price) / 7000).alias("train_loss"), (F.sqrt(price) / 13000).alias("val_loss")))


def priority_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a run per order priority, as a run has a folder of its own."""
    return curves(spark, sf_dir, "o_orderpriority")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as arrays of models: flag and status are the run, and the quantity is the array's size."""
    size = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("run_id"),
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("name"),
        F.array(size).alias("shape"), F.array_repeat(F.col("l_tax"), size).alias("values"))


def _hand_set() -> Weights:
    """One unit; a row per gate in the order input, forget, cell, output, and a column per feature."""
    return {"lstm.weight_ih_l0": np.array([[0.5, -0.3, 0.2, 0.4, 0.1], [0.1, 0.2, -0.1, 0.3, 0.2],
                                           [0.6, -0.2, 0.3, -0.5, 0.4], [-0.3, 0.5, 0.2, 0.1, -0.2]]),
            "lstm.weight_hh_l0": np.array([[0.3], [-0.2], [0.5], [0.4]]),
            "lstm.bias_ih_l0": np.array([0.1, 0.6, -0.1, 0.2]), "lstm.bias_hh_l0": np.array([0.05, 0.3, 0.1, -0.1]),
            "fc.weight": np.array([[1.5]]), "fc.bias": np.array([0.25])}


HAND_SET = _hand_set()
