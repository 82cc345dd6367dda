"""Every operator on whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import stand_in
from checks.stand_in import SETTINGS, daily_bars, daily_panel, hourly_panel, persistence, table
from seqcast.config import Settings
from seqcast.functions.text import artefact_name, run_id, run_name
from seqcast.operators.gram import window_gram
from seqcast.operators.metrics import (batch_losses, mape, rank_epoch_loss, reduced_epoch_loss, regression_metrics,
                                       weighted_epoch_loss)
from seqcast.operators.prepare import bar_positions, drop_missing, filter_symbols, parse_dates, prepare, project_features
from seqcast.operators.scale import bounds_from_profile, narrowed, unscale
from seqcast.operators.shards import assign_shards, ordered_batches
from seqcast.operators.split import TEST, TRAIN, cutoffs, date_profile
from seqcast.operators.windows import flat_features, gathered_blocks, last_step, sequence_counts, series_positions
from seqcast.plans.incremental import add_to_profile, kept_profile
from seqcast.plans.panel import Panel, build_panel
from seqcast.plans.reports import accuracy_report, equivalence_report, milestones, repeat_stats, sized, speedup_report, storage_report
from seqcast.plans.run import summary_of
from seqcast.plans.scoring import forecast, forecast_actual, score
from seqcast.plans.training import train, train_single
from seqcast.plans.window_regressor import WindowRegressor, fit_window_regressor, regressor_forecast
from seqcast.sources.bars import read_bars
from seqcast.sources.runs import (CURVE_SCHEMA, METRICS_FIELD, WEIGHTS_SCHEMA, append_summary, parameter_counts, read_summaries,
                                  read_table, summarise, write_table)
from seqcast.sources.shared import new_table_path, written
from seqcast.sources.store import read_store, stored_sequences, write_store

FEATURES = SETTINGS.features
WORLD = 4
# All windows and epochs, with the default network and batches; ranks average their weights after eight steps.
TRAINED = SETTINGS.override(world_size=WORLD, sync_every=8)
# The same by the mean gradient of every step, for as many epochs as are laid out together.
EACH_STEP = SETTINGS.override(world_size=WORLD, epochs=5)
# All windows and epochs in one rank, with a small network and large batches.
ALONE = SETTINGS.override(world_size=WORLD, hidden_size=8, num_layers=1, batch_size=256, tasks=1)


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _metrics_rounded(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(df, 1, "MSE"), 4, "RMSE", "MAE", "MAPE")


# Scans, sources, sinks


def scan_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "bars-csv")
    daily_bars(spark, sf_dir).select("Close", "Date", "Symbol", "Volume", "Open", "Low", "High").withColumn(
        "Date", F.col("Date").cast("string")).write.csv(path, header=True)
    return parse_dates(read_bars(spark, path))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col
    return summarise(
        stand_in.runs(spark, sf_dir), F.concat_ws(".", "l_orderkey", "l_linenumber"), f("run_type"), f("num_processes"), f("storage"),
        f("symbols"), f("n_samples"), f("training_time_seconds"), f("stopped_epoch"), f("finished"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as runs leave them: appended to a log and read back."""
    path = new_table_path(spark, "run-summaries")
    append_summary(_summaries(spark, sf_dir), path)
    return read_summaries(spark, path)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = [F.col(f"{METRICS_FIELD}.{m}").alias(m) for m in ("MSE", "RMSE", "MAE", "MAPE")]
    return _log(spark, sf_dir).select(
        "run_id", "run_name", "run_type", "num_processes", "storage", F.array_join("stocks_analyzed", ",").alias("stocks_analyzed"),
        "total_training_samples", "training_time_seconds", "stopped_at_epoch", *flat)


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = run_name(F.col("run_type"), F.col("num_processes"), F.size("symbols"), F.col("finished"))
    unique = F.concat_ws(".", "l_orderkey", "l_linenumber")
    return (stand_in.runs(spark, sf_dir).select("l_orderkey", "l_linenumber", name.alias("run_name"), run_id(name, unique).alias("run_id"))
            .withColumn("weights_name", artefact_name("weights", F.col("run_id"))))


def curve_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milestones(stand_in.curves(spark, sf_dir), F.lit(200))


# Projections, filters, predicates


def symbols_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_symbols(daily_bars(spark, sf_dir), SETTINGS.symbols)


def dates_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a single order get a text that is no date."""
    text = F.col("Date").cast("string")
    marred = daily_bars(spark, sf_dir).withColumn("date_text", F.when(F.col("Volume") == 1, F.concat(text, F.lit("?"))).otherwise(text))
    return parse_dates(marred.select("Symbol", "date_text", F.col("date_text").alias("Date")), lenient=True)


def dates_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written month first; days with a single order get a text that is no date."""
    text = F.date_format("Date", "MM/dd/yyyy")
    marred = daily_bars(spark, sf_dir).withColumn("date_text", F.when(F.col("Volume") == 1, F.concat(F.lit("?"), text)).otherwise(text))
    return parse_dates(marred.select("Symbol", "date_text", F.col("date_text").alias("Date")), lenient=True, date_format="MM/dd/yyyy")


def features_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_features(daily_bars(spark, sf_dir), ("Volume", "Close"))


def missing_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with one order lack an open price, those with two have a low that is no number."""
    holed = daily_bars(spark, sf_dir).withColumns({
        "Open": F.when(F.col("Volume") != 1, F.col("Open")),
        "Low": F.when(F.col("Volume") == 2, F.lit(float("nan"))).otherwise(F.col("Low"))})
    return drop_missing(holed, FEATURES)


def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_panel(spark, sf_dir).split().select("Symbol", "Date", "split")


# Sorts, distinct, positional pick


def sorted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily_panel(spark, sf_dir)
    return bar_positions(panel.bars, panel.fit.cells)


def date_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return date_profile(prepare(daily_bars(spark, sf_dir), SETTINGS))


def split_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs(date_calendar(spark, sf_dir), SETTINGS.train_ratio, SETTINGS.val_ratio)


# Scaling


def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = date_profile(prepare(daily_bars(spark, sf_dir), SETTINGS), FEATURES)
    train_end = cutoffs(profile, SETTINGS.train_ratio, SETTINGS.val_ratio).select("train_end").scalar()
    return bounds_from_profile(profile, train_end, FEATURES)


def scaled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = [f"{c}_scaled" for c in FEATURES]
    return _rounded(daily_panel(spark, sf_dir).scaled().select("split", "Symbol", "Date", *scaled), 9, *scaled)


def unscale_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = daily_panel(spark, sf_dir)
    back = unscale(panel.scaled(), panel.target_bounds, {"Close_scaled": "Close_back"})
    return _rounded(back.select("Symbol", "Date", "Close_back"), 4, "Close_back")


def float32_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (daily_panel(spark, sf_dir).scaled()
            .select("Symbol", "Date", F.round(narrowed(F.col("Close_scaled")), 9).alias("Close_float")))


def scaler_fit_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of a profile that three batches of days were added to, one of them twice."""
    clean = prepare(daily_bars(spark, sf_dir), SETTINGS)
    path = new_table_path(spark, "profile")
    for batch in (0, 1, 2, 1):
        add_to_profile(clean.where(F.dayofyear("Date") % 3 == batch), FEATURES, path, str(batch))
    profile = kept_profile(spark, FEATURES, path)
    train_end = cutoffs(profile, SETTINGS.train_ratio, SETTINGS.val_ratio).select("train_end").scalar()
    return bounds_from_profile(profile, train_end, FEATURES)


# Windows


def _steps(sequences: DataFrame) -> DataFrame:
    """One row per sequence and step, features in columns again."""
    stepped = sequences.select("split", "Symbol", "Date", F.round("y", 9).alias("y"), F.posexplode("x").alias("at", "bar"))
    return stepped.select("split", "Symbol", "Date", "y", (F.col("at") + 1).alias("step"),
                          *[F.round(F.col("bar")[i], 9).alias(c) for i, c in enumerate(FEATURES)])


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(daily_panel(spark, sf_dir).sequences())


def sequences_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(hourly_panel(spark, sf_dir).sequences())


def sequences_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a bucketed table of bars."""
    name = f"bars_{uuid.uuid4().hex}"
    write_store(prepare(daily_bars(spark, sf_dir), SETTINGS), name, new_table_path(spark, "store"), WORLD)
    panel = build_panel(read_store(spark, name), SETTINGS)
    return _steps(stored_sequences(panel.scaled(), [f"{c}_scaled" for c in FEATURES], f"{SETTINGS.target}_scaled", SETTINGS.window))


def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = hourly_panel(spark, sf_dir)
    return series_positions(panel.split(), panel.fit.cells).select("split", "Symbol", "Date", "position")


def counted_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_counts(daily_panel(spark, sf_dir).split(), SETTINGS.window)


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each flat window and a sum that depends on the order of its values."""
    flat = flat_features(F.col("x"))
    weighted = F.aggregate(F.transform(flat, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return daily_panel(spark, sf_dir).sequences().select(
        "split", "Symbol", "Date", F.size(flat).cast("bigint").alias("n_values"), F.round(weighted, 4).alias("weighted_sum"))


def last_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = last_step(F.col("x"))
    return daily_panel(spark, sf_dir).sequences().select(
        "split", "Symbol", "Date", *[F.round(step[i], 9).alias(c) for i, c in enumerate(FEATURES)])


# Metrics and losses


def _persisted_forecasts(spark: SparkSession, sf_dir: str, split: str | None) -> DataFrame:
    panel = daily_panel(spark, sf_dir)
    return unscale(persistence(panel, split), panel.target_bounds, {"y": "y_actual", "p": "y_pred"})


def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics_rounded(regression_metrics(_persisted_forecasts(spark, sf_dir, TEST)))


def metrics_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics_rounded(regression_metrics(_persisted_forecasts(spark, sf_dir, None), "split", "Symbol"))


def mape_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts, many of which are zero, with the tax as their forecast."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.round(mape(F.col("l_discount"), F.col("l_tax")), 6).alias("MAPE"), F.count(F.lit(1)).alias("n"))


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch losses of the persistence forecast over two epochs of sharded train windows."""
    panel = daily_panel(spark, sf_dir)
    errors = persistence(panel, TRAIN).select("Symbol", "Date", (F.col("y") - F.col("p")).alias("error"))
    dealt = assign_shards(panel.sequence_keys(TRAIN), WORLD, SETTINGS.batch_size, epochs=(0, 1))
    return batch_losses(dealt.join(errors, ["Symbol", "Date"]))


def losses_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_losses(spark, sf_dir), 9, "loss")


def epoch_loss_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(weighted_epoch_loss(_losses(spark, sf_dir)), 9, "loss")


def epoch_loss_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rank_epoch_loss(_losses(spark, sf_dir)), 9, "loss")


def epoch_loss_allreduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reduced_epoch_loss(_losses(spark, sf_dir)), 9, "loss")


# Shards and batches


def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By keys alone: the stand-in has one bar per symbol and date."""
    panel = daily_panel(spark, sf_dir)
    return assign_shards(panel.sequence_keys(TRAIN).drop("position"), WORLD, SETTINGS.batch_size, cells=panel.fit.cells)


def epoch_reshuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(daily_panel(spark, sf_dir).sequence_keys(TRAIN), WORLD, SETTINGS.batch_size, epochs=(1, 2)).drop("position")


def train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(daily_panel(spark, sf_dir).sequence_keys(TRAIN), 1, SETTINGS.batch_size).drop("rank", "position")


def batches_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_batches(daily_panel(spark, sf_dir).sequence_keys(), SETTINGS.batch_size).drop("position")


# Training and scoring


def bars_once(spark: SparkSession, sf_dir: str, settings: Settings) -> Panel:
    """A panel of bars that are made once: a run looks at them some nine times, for a row per symbol and day of however many orders."""
    return build_panel(written(daily_bars(spark, sf_dir), "bars"), settings)


def _trained(spark: SparkSession, sf_dir: str, settings: Settings, single: bool = False) -> DataFrame:
    """Summary of a run over all train windows."""
    panel = bars_once(spark, sf_dir, settings)
    model = train_single(panel) if single else train(panel)
    return summary_of(spark, model, forecast(panel, model.weights, TEST), datetime.now())


def train_sequence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, TRAINED)


def train_each_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, EACH_STEP)


def train_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, ALONE, single=True)


def _written_table(spark: SparkSession, rows: DataFrame, name: str, schema: str) -> DataFrame:
    path = new_table_path(spark, name)
    write_table(rows, path)
    return read_table(spark, path, schema)


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = _written_table(spark, stand_in.priority_curves(spark, sf_dir), "curves", CURVE_SCHEMA)
    return _rounded(curves, 9, "train_loss", "val_loss")


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and numbers of each model as its table holds them."""
    models = _written_table(spark, stand_in.weights(spark, sf_dir), "weights", WEIGHTS_SCHEMA)
    arrays = models.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_arrays"), F.sum(F.col("shape")[0]).alias("n_shaped"),
        F.round(F.sum(F.aggregate("values", F.lit(0.0), lambda a, v: a + v)), 4).alias("total"))
    return arrays.join(parameter_counts(models), "run_id")


def _scored_panel(spark: SparkSession, sf_dir: str) -> Panel:
    return daily_panel(spark, sf_dir, SETTINGS.override(hidden_size=1, num_layers=1))


def score_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of one unit with weights set by hand."""
    scored = score(_scored_panel(spark, sf_dir).sequences(TEST), stand_in.HAND_SET, len(FEATURES)).drop("position")
    return scored.select("split", "Symbol", "Date", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("y", "p")])


def forecast_in_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = forecast(_scored_panel(spark, sf_dir), stand_in.HAND_SET, TEST).drop("position")
    return _rounded(prices, 3, "y_actual", "y_pred")


def window_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close regressed on the close before it, which a line fitted in SQL does too."""
    panel = daily_panel(spark, sf_dir, SETTINGS.override(features=("Close",), window=1))
    model = fit_window_regressor(panel, ridge=0.0)
    found = regression_metrics(regressor_forecast(panel, model, TEST), "Symbol")
    return _rounded(_rounded(found.withColumn("MSE", F.col("MSE") / 1e6), 1, "MSE", "RMSE", "MAE"), 4, "MAPE")


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the values at any two places of a train window, target included: 61 places of five features."""
    panel = daily_panel(spark, sf_dir)
    blocks = gathered_blocks(panel.scaled(TRAIN), [f"{c}_scaled" for c in FEATURES], SETTINGS.window, SETTINGS.block_rows, panel.fit.cells)
    names = [f"{a}_{b}" for a in ("one", *FEATURES) for b in ("one", *FEATURES)]
    return window_gram(blocks, len(FEATURES), SETTINGS.window).select("i", "j", *[F.round(F.col("products")[k], 4).alias(n) for k, n in enumerate(names)])


def window_regressor_of_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regression on 60 bars of five features, saved in a pipeline, loaded, and measured."""
    panel = daily_panel(spark, sf_dir)
    path = new_table_path(spark, "pipeline")
    scaled = [f"{c}_scaled" for c in FEATURES]
    stage = WindowRegressor(inputCols=scaled, labelCol=f"{SETTINGS.target}_scaled", window=SETTINGS.window)
    Pipeline(stages=[stage]).fit(panel.scaled(TRAIN)).write().save(path)
    scored = PipelineModel.load(path).transform(panel.scaled(TEST)).withColumnRenamed(f"{SETTINGS.target}_scaled", "y")
    return _metrics_rounded(regression_metrics(forecast_actual(scored, panel.target_bounds), "Symbol"))


# Run comparison


def speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(speedup_report(_log(spark, sf_dir)), 6, "seconds", "speedup", "efficiency")


def storage_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(storage_report(_log(spark, sf_dir), "N"), 6, "seconds", "improvement")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(accuracy_report(_log(spark, sf_dir)), 6, "MAPE", "RMSE")


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = repeat_stats(_summaries(spark, sf_dir), "run_type", "num_processes", "storage")
    return _rounded(stats, 6, "mean", "low", "high", "spread")


def equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by number of processes against those of one process, within a twentieth of these."""
    found = equivalence_report(sized(_summaries(spark, sf_dir)), F.col(f"{METRICS_FIELD}.MAPE"), 0.05)
    return _rounded(found, 6, "mean", "difference", "freedom", "p")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_bars": scan_bars,
    "filter_symbols": symbols_kept,
    "parse_dates": dates_parsed,
    "parse_dates_by_format": dates_by_format,
    "project_features": features_projected,
    "drop_missing": missing_dropped,
    "sorted_bars": sorted_bars,
    "date_calendar": date_calendar,
    "split_cutoffs": split_cutoffs,
    "chrono_split": chrono_split,
    "scaler_fit": scaler_fit,
    "scaler_fit_in_batches": scaler_fit_in_batches,
    "scaled_bars": scaled_bars,
    "unscale_target": unscale_target,
    "float32_roundtrip": float32_roundtrip,
    "sequences": sequences,
    "sequences_in_cells": sequences_in_cells,
    "sequences_from_store": sequences_from_store,
    "series_positions": row_positions,
    "sequence_counts": counted_sequences,
    "flat_features": flattened,
    "last_step": last_steps,
    "regression_metrics": overall_metrics,
    "metrics_by_symbol": metrics_by_symbol,
    "mape_masked": mape_masked,
    "batch_losses": losses_by_batch,
    "epoch_loss_weighted": epoch_loss_weighted,
    "epoch_loss_by_rank": epoch_loss_by_rank,
    "epoch_loss_allreduce": epoch_loss_allreduce,
    "shard_assignment": shard_assignment,
    "epoch_reshuffle": epoch_reshuffle,
    "train_batches": train_batches,
    "ordered_batches": batches_in_order,
    "run_summary": run_summary,
    "run_name": run_names,
    "curve_milestones": curve_milestones,
    "speedup_report": speedups,
    "storage_report": storage_gain,
    "accuracy_report": accuracy,
    "repeat_stats": repeats,
    "equivalence_report": equivalence,
    "train_sequence_model": train_sequence_model,
    "train_each_step": train_each_step,
    "train_single": train_alone,
    "learning_curve": learning_curve,
    "model_table": model_table,
    "score_sequences": score_sequences,
    "forecast_actual": forecast_in_prices,
    "fit_window_regressor": window_regressor,
    "fit_window_regressor_60": window_regressor_of_60,
    "window_gram": gram,
}
