"""A linear regression over the same windows: the yardstick for the sequence model, as a Spark ML estimator."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol, HasRegParam
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.operators.gram import collected, least_squares, window_gram
from seqcast.operators.split import TRAIN
from seqcast.operators.windows import BLOCK_ROWS, Cells, choose_cells, gathered_blocks
from seqcast.plans.panel import Panel
from seqcast.plans.scoring import forecast_actual, score_blocks

# Shrinks the weights of features that repeat one another within a window.
RIDGE = 1e-3
CELL_ROWS = 250_000


class _WindowParams(HasInputCols, HasLabelCol, HasPredictionCol, HasRegParam):
    """Value columns of a bar, the one to forecast (a value column itself), and how many bars before it are looked at."""

    window: Param[int] = Param(Params._dummy(), "window", "bars before the one that is forecast", TypeConverters.toInt)
    blockRows: Param[int] = Param(Params._dummy(), "blockRows", "bars of a series that are worked off together", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(window=60, blockRows=BLOCK_ROWS, regParam=RIDGE, predictionCol="p", labelCol="y")

    def _blocks(self, bars: DataFrame, cells: Cells | None = None) -> DataFrame:
        """Bars by series: ``Symbol`` and, if there is one, ``split``; ``Date`` orders them."""
        rows = bars if "split" in bars.columns else bars.withColumn("split", F.lit("all"))
        cells = cells or choose_cells(rows.groupBy("Date").agg(F.count(F.lit(1)).alias("rows")), CELL_ROWS)
        return gathered_blocks(rows, [*self.getInputCols(), self.getLabelCol()], self.getOrDefault("window"), self.getOrDefault("blockRows"), cells)


class WindowRegressor(Estimator, _WindowParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits by normal equations, which come from products of bars at a lag in one aggregate: what is collected is as large as the model, squared."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, labelCol: str | None = None, predictionCol: str | None = None, regParam: float | None = None,
                 window: int | None = None, blockRows: int | None = None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> WindowRegressorModel:
        return self.fit_blocks(self._blocks(dataset))

    def fit_blocks(self, blocks: DataFrame) -> WindowRegressorModel:
        columns, window = self.getInputCols(), self.getOrDefault("window")
        if self.getLabelCol() not in columns:
            raise ValueError(f"{self.getLabelCol()} is not one of the input columns {columns}")
        gram = collected(window_gram(blocks, len(columns), window), len(columns), window)
        if not gram[0, 0, 0, 0]:
            raise ValueError(f"no series is longer than the window of {window}")
        coefficients, intercept = least_squares(gram, columns.index(self.getLabelCol()), self.getRegParam())
        return self._copyValues(WindowRegressorModel()._set(coefficients=coefficients.ravel().tolist(), intercept=intercept))


class WindowRegressorModel(Model, _WindowParams, DefaultParamsReadable, DefaultParamsWritable):
    """Turns bars into ``split, Symbol, Date, position``, the label and its prediction, a row per bar with enough bars before it."""

    coefficients: Param[list[float]] = Param(Params._dummy(), "coefficients", "of each bar of the window and value column", TypeConverters.toListFloat)
    intercept: Param[float] = Param(Params._dummy(), "intercept", "of the regression", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.transform_blocks(self._blocks(dataset))

    def transform_blocks(self, blocks: DataFrame) -> DataFrame:
        window = self.getOrDefault("window")
        weights, intercept = np.array(self.getOrDefault("coefficients")).reshape(window, -1), self.getOrDefault("intercept")

        def predictor(bars: np.ndarray) -> np.ndarray:
            n = len(bars) - window
            return intercept + sum(bars[i: i + n, :-1] @ weights[i] for i in range(window))

        scored = score_blocks(blocks, window, predictor)
        return scored.withColumnsRenamed({"y": self.getLabelCol(), "p": self.getPredictionCol()})


def _estimator(panel: Panel, ridge: float) -> WindowRegressor:
    s = panel.settings
    return WindowRegressor(inputCols=[f"{c}_scaled" for c in s.features], labelCol=f"{s.target}_scaled", regParam=ridge, window=s.window, blockRows=s.block_rows)


def fit_window_regressor(panel: Panel, ridge: float = RIDGE) -> WindowRegressorModel:
    estimator = _estimator(panel, ridge)
    return estimator.fit_blocks(estimator._blocks(panel.scaled(TRAIN), panel.fit.cells))


def regressor_forecast(panel: Panel, model: WindowRegressorModel, split: str) -> DataFrame:
    scored = model.transform_blocks(model._blocks(panel.scaled(split), panel.fit.cells))
    return forecast_actual(scored.withColumnsRenamed({model.getLabelCol(): "y", model.getPredictionCol(): "p"}), panel.target_bounds)
