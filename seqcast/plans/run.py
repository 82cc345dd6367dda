"""One whole run: bars in, model, curve and summary out."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from seqcast.config import Settings
from seqcast.functions.text import ARTEFACTS, PROGRESS_LINE
from seqcast.operators.metrics import METRICS, regression_metrics
from seqcast.operators.split import TEST
from seqcast.plans.panel import Panel, build_panel
from seqcast.plans.reports import repeat_stats
from seqcast.plans.scoring import forecast
from seqcast.plans.training import TrainedModel, train, train_single
from seqcast.sources.bars import read_bars
from seqcast.sources.runs import (SUMMARY_SCHEMA, append_summary, curve_table, read_summaries, summarise, weights_table,
                                  write_table)


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunResult:
    model: TrainedModel
    summary: Row
    forecasts: DataFrame


def summary_of(spark: SparkSession, model: TrainedModel, forecasts: DataFrame, finished: datetime) -> DataFrame:
    """One row. Metrics are null where the test period is too short for a window."""
    s = model.settings
    found = regression_metrics(forecasts)
    measured = found.select(*[F.when(F.col("n") > 0, F.col(m)).alias(m) for m in METRICS])
    return summarise(
        measured, F.lit(uuid.uuid4().hex), F.lit(model.run_type), F.lit(s.world_size), F.lit(s.storage), F.array(*[F.lit(x) for x in s.symbols]),
        F.lit(model.n_samples), F.lit(model.seconds), F.lit(model.stopped_epoch),
        F.lit(finished.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))


def _report(epochs: int):
    """Logs the first and every tenth epoch while a run goes on."""
    def progress(epoch: int, train_loss: float, val_loss: float | None) -> None:
        if epoch == 1 or epoch % 10 == 0:
            log.info(PROGRESS_LINE, epoch, epochs, train_loss, float("nan") if val_loss is None else val_loss)

    return progress


def run_panel(panel: Panel, output_dir: str | None = None, single: bool = False) -> RunResult:
    """Train, forecast the test period and measure; write three tables unless ``output_dir`` is None.

    The time in the summary covers the epoch loop, not reading and window building.
    """
    spark = panel.bars.sparkSession
    progress = _report(panel.settings.epochs)
    model = train_single(panel, progress) if single else train(panel, progress=progress)
    forecasts = forecast(panel, model.weights, TEST)
    summary = summary_of(spark, model, forecasts, datetime.now()).first()
    if output_dir is not None:
        def path(artefact: str) -> str:
            return f"{output_dir.rstrip('/')}/{ARTEFACTS[artefact]}"

        write_table(weights_table(spark, model.weights, summary.run_id), path("weights"))
        write_table(curve_table(spark, model.curve, summary.run_id), path("curve"))
        append_summary(spark.createDataFrame([summary], SUMMARY_SCHEMA).coalesce(1), path("summary"), compression="none")
    return RunResult(model, summary, forecasts)


def run_repeatedly(spark: SparkSession, settings: Settings, times: int, format: str = "csv",
                   single: bool = False) -> DataFrame | None:
    """The same run several times, and the spread of the times of all runs like it so far."""
    for _ in range(times):
        if run(spark, settings, format, single) is None:
            return None
    summaries = read_summaries(spark, f"{settings.output_dir.rstrip('/')}/{ARTEFACTS['summary']}")
    return repeat_stats(summaries, "run_type", "num_processes")


def run(spark: SparkSession, settings: Settings, format: str = "csv", single: bool = False) -> RunResult | None:
    """A run from the bar table the settings name. A single run without input gives None."""
    bars = read_bars(spark, settings.bars_path, settings, format, missing_ok=single)
    if bars is None:
        return None
    return run_panel(build_panel(bars, settings), settings.output_dir, single)
