"""Normal equations of sliding windows from products of rows at a lag: no window is built."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.sources.ship import ship_package


def block_gram(bars: np.ndarray, window: int) -> np.ndarray:
    """Sums over all runs of ``window + 1`` rows of the products of any two values in them, by place and column of either.

    Two places ``d`` apart have the same products wherever they are in the run, but for those at the ends. So the sum for the first place is one
    product of matrices, and each further place drops the product at the head and takes in one at the tail. Places in order: the
    second is never before the first, and the rest is zero.
    """
    rows, width = bars.shape
    n = rows - window
    gram = np.zeros((window + 1, width, window + 1, width))
    if n <= 0:
        return gram
    for d in range(window + 1):
        more = window - d
        head = bars[:more, :, None] * bars[d: d + more, None, :]
        tail = bars[n: n + more, :, None] * bars[n + d: n + d + more, None, :]
        first = bars[:n].T @ bars[d: d + n]
        at = np.arange(more + 1)
        gram[at, :, at + d, :] = np.cumsum(np.concatenate([first[None], tail - head]), axis=0)
    return gram


def window_gram(blocks: DataFrame, width: int, window: int) -> DataFrame:
    """``i, j, products``: for two places ``i <= j`` of a run of ``window + 1`` rows, the sums of products of each column at ``i`` and each at ``j``.

    The columns are a one and the first ``width`` values of a bar, so the sums of values and the number of runs are among the products. ``blocks`` are those of
    ``gathered_blocks``. A task adds up its blocks, whatever their number, and the sums of tasks are added up in one aggregate.
    """
    ship_package(blocks.sparkSession.sparkContext)
    side = 1 + width

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((window + 1, side, window + 1, side))
        for batch in batches:
            for rows in batch.column("rows"):
                bar = rows.values.flatten()[-1]
                bars = bar.flatten().to_numpy(zero_copy_only=False).reshape(len(bar), -1)[:, :width]
                total += block_gram(np.hstack([np.ones((len(bars), 1)), bars]), window)
        i, j = np.triu_indices(window + 1)
        products = total[i, :, j, :].reshape(len(i), -1)
        offsets = pa.array(np.arange(len(i) + 1) * side * side, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(products.ravel()))],
                                         ["i", "j", "products"])

    parts = blocks.select("rows").mapInArrow(summed, "i int, j int, products array<double>")
    return (parts.groupBy("i", "j").agg(*(F.sum(F.col("products")[k]).alias(f"_{k}") for k in range(side * side)))
            .select("i", "j", F.array(*(f"_{k}" for k in range(side * side))).alias("products")))


def least_squares(gram: np.ndarray, target: int, ridge: float) -> tuple[np.ndarray, float]:
    """Coefficients by place and column, and the intercept, of the regression of the last row's column ``target`` on all rows before.

    ``gram`` is symmetric, with the ones in column 0. ``ridge`` shrinks the coefficients of standardised columns, in units of the target's spread; a
    column that does not vary gets none.
    """
    places, side = gram.shape[:2]
    n = gram[0, 0, 0, 0]
    used = [(i, c) for i in range(places - 1) for c in range(1, side)]
    at = np.array([i * side + c for i, c in used])
    flat = gram.reshape(places * side, places * side) / n
    y = (places - 1) * side + 1 + target
    means = flat[0]
    spread = flat - np.outer(means, means)
    deviation = np.sqrt(np.maximum(0, np.diag(spread)))
    varies = deviation[at] > 1e-12 * (1 + np.abs(means[at]))
    at = at[varies]
    coefficients = np.zeros(len(used))
    if len(at) and deviation[y] > 0:
        matrix = spread[np.ix_(at, at)] / np.outer(deviation[at], deviation[at]) + np.eye(len(at)) * ridge / deviation[y]
        wanted = spread[at, y] / (deviation[at] * deviation[y])
        solved = np.linalg.solve(matrix, wanted) if ridge else np.linalg.lstsq(matrix, wanted, rcond=1e-13)[0]
        coefficients[varies] = solved * deviation[y] / deviation[at]
    intercept = means[y] - coefficients[varies] @ means[at]
    return coefficients.reshape(places - 1, side - 1), float(intercept)


def collected(gram: DataFrame, width: int, window: int) -> np.ndarray:
    """The sums as one symmetric array by place and column of either. Its size is that of the model, squared."""
    side = 1 + width
    out = np.zeros((window + 1, side, window + 1, side))
    for r in gram.collect():
        products = np.array(r["products"]).reshape(side, side)
        out[r["i"], :, r["j"], :] = products
        out[r["j"], :, r["i"], :] = products.T
    return out
