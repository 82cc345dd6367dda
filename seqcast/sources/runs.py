"""Tables that a run writes, and how to read them back.

Every table carries ``run_id``; a run adds its rows to those of others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcast.functions.lstm import Weights, weight_shapes
from seqcast.functions.text import run_id, run_name
from seqcast.operators.metrics import METRICS

WEIGHTS_SCHEMA = "run_id string, name string, shape array<int>, values array<double>"
CURVE_SCHEMA = "run_id string, epoch int, train_loss double, val_loss double"
METRICS_FIELD = "aggregate_performance_metrics"
# Rows of a file of summaries.
ROWS_OF_FILE = 1_000_000
SUMMARY_SCHEMA = (
    "run_id string, run_name string, run_type string, num_processes int, storage string, stocks_analyzed array<string>, "
    "total_training_samples bigint, training_time_seconds double, stopped_at_epoch int, "
    f"{METRICS_FIELD} struct<{', '.join(f'{m}: double' for m in METRICS)}>"
)


def weights_table(spark: SparkSession, weights: Weights, run_id: str) -> DataFrame:
    rows = [(run_id, name, list(value.shape), [float(v) for v in value.ravel()]) for name, value in weights.items()]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA)


def weights_from_table(table: DataFrame, n_features: int, hidden: int, layers: int) -> Weights:
    """The arrays of one run's model. There are as many rows as the model has arrays."""
    shapes = weight_shapes(n_features, hidden, layers)
    rows = {r["name"]: r for r in table.collect()}
    if set(rows) != set(shapes):
        raise ValueError(f"weights table has {sorted(rows)}, the model needs {sorted(shapes)}")
    return {name: np.array(rows[name]["values"], np.float32).reshape(shape) for name, shape in shapes.items()}


def parameter_counts(table: DataFrame) -> DataFrame:
    """How many numbers each run's model has."""
    return table.groupBy("run_id").agg(F.sum(F.size("values")).alias("n_parameters"))


def curve_table(spark: SparkSession, curve: list[tuple[int, float, float | None]], run_id: str) -> DataFrame:
    return spark.createDataFrame([(run_id, *point) for point in curve], CURVE_SCHEMA)


def summarise(runs: DataFrame, unique: Column, run_type: Column, world_size: Column, storage: Column, symbols: Column,
              n_samples: Column, seconds: Column, stopped_epoch: Column, finished: Column) -> DataFrame:
    """Run summaries from a table with one row per run and its four metrics.

    Metrics are rounded to four places and times to two. World size and last epoch are a
    distributed run's only. ``unique`` tells runs of one name apart.
    """
    distributed = run_type == "distributed"
    name = run_name(run_type, world_size, F.size(symbols), finished)
    return runs.select(
        run_id(name, unique).alias("run_id"), name.alias("run_name"),
        run_type.alias("run_type"),
        F.when(distributed, world_size).cast("int").alias("num_processes"),
        storage.alias("storage"),
        symbols.alias("stocks_analyzed"),
        n_samples.cast("bigint").alias("total_training_samples"),
        F.round(seconds, 2).alias("training_time_seconds"),
        F.when(distributed, stopped_epoch).cast("int").alias("stopped_at_epoch"),
        F.struct(*[F.round(F.col(m), 4).alias(m) for m in METRICS]).alias(METRICS_FIELD))


def append_summary(summary: DataFrame, path: str, compression: str = "gzip") -> None:
    """JSON lines, whose field names take several times the room of the values unless they are compressed.

    A compressed file is read by one task, so none gets more than ``ROWS_OF_FILE`` rows.
    """
    summary.write.mode("append").option("maxRecordsPerFile", ROWS_OF_FILE).json(path, compression=compression)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).json(path)


def write_table(table: DataFrame, path: str) -> None:
    """Weights and curves: parquet, one folder per run. Nothing that is there is replaced."""
    table.write.mode("append").partitionBy("run_id").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str, run_id: str | None = None) -> DataFrame:
    """``run_id`` picks one run's folder."""
    table = spark.read.schema(schema).parquet(path)
    return table if run_id is None else table.where(F.col("run_id") == run_id)
