"""Forecasts from a trained model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.functions.lstm import Weights, predict
from seqcast.operators.scale import unscale
from seqcast.operators.windows import float_window, gathered_blocks
from seqcast.plans.panel import Panel
from seqcast.sources.ship import ship_package

# Windows that go through the network together.
CHUNK = 1024


def window_matrix(column: pa.Array, n_features: int) -> np.ndarray:
    """An Arrow list column of flat windows as (sample, step, feature), without copying."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1, n_features)


def predict_in_chunks(weights: Weights, x: np.ndarray) -> np.ndarray:
    parts = [predict(weights, np.ascontiguousarray(x[at:at + CHUNK])) for at in range(0, len(x), CHUNK)]
    return np.concatenate(parts) if parts else np.empty(0, np.float32)


def score(sequences: DataFrame, weights: Weights, n_features: int) -> DataFrame:
    """Add the model's scaled prediction ``p`` to every sequence; the window itself is dropped.

    Rows keep their key, so batches need no order and are never put together again. The
    weights travel with the function: their size depends on the model alone.
    """
    ship_package(sequences.sparkSession.sparkContext)
    keys = [c for c in sequences.columns if c not in ("x", "y")]
    rows = sequences.select(*keys, F.col("y").cast("float").alias("y"), float_window(F.col("x")).alias("x"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = predict_in_chunks(weights, window_matrix(batch.column("x"), n_features))
            kept = [batch.column(c) for c in (*keys, "y")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p, pa.float32())], names=[*keys, "y", "p"])

    schema = rows.select(*keys, "y").withColumn("p", F.lit(0.0).cast("float")).schema
    return rows.mapInArrow(scored, schema)


def score_blocks(blocks: DataFrame, window: int, predictor: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> DataFrame:
    """``split, Symbol, Date, position, y, p`` of every window of the blocks.

    ``predictor`` gets a block's bars, a row each, and returns a value for each row from ``window`` on; the last value of a bar is the target. A block's bars
    are moved once, not once for each window they are in.
    """
    ship_package(blocks.sparkSession.sparkContext)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, rows in enumerate(batch.column("rows")):
                position, date, bar = rows.values.flatten()
                bars = bar.flatten().to_numpy(zero_copy_only=False).reshape(len(bar), -1)
                n = len(bars) - window
                value = pa.float32() if kind == "float" else pa.float64()
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column("split")[i], n), pa.repeat(batch.column("Symbol")[i], n), date.slice(window), position.slice(window),
                     pa.array(bars[window:, -1], value), pa.array(predictor(bars), value)], ["split", "Symbol", "Date", "position", "y", "p"])

    date = dict(blocks.select(F.explode("rows").alias("row")).select("row.Date", "row.position").dtypes)
    return blocks.select("split", "Symbol", "rows").mapInArrow(
        scored, f"split string, Symbol string, Date {date['Date']}, position {date['position']}, y {kind}, p {kind}")


def forecast_actual(scored: DataFrame, target_bounds: tuple[float, float]) -> DataFrame:
    """Truth and prediction in price units, side by side."""
    return unscale(scored, target_bounds, {"y": "y_actual", "p": "y_pred"}).drop("y", "p")


def scaled_values(features: Sequence[str], target: str) -> list[str]:
    """Columns of a block's bars: the features, and the target last."""
    return [f"{c}_scaled" for c in (*features, target)]


def forecast(panel: Panel, weights: Weights, split: str) -> DataFrame:
    """Truth and prediction of every window of a split. The weights travel with the function: their size depends on the model alone."""
    s = panel.settings

    def predictor(bars: np.ndarray) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(bars[:-1, :-1], s.window, axis=0).transpose(0, 2, 1)
        return predict_in_chunks(weights, windows)

    blocks = gathered_blocks(panel.scaled(split), scaled_values(s.features, s.target), s.window, s.block_rows, panel.fit.cells, "float")
    return forecast_actual(score_blocks(blocks, s.window, predictor, "float"), panel.target_bounds)
