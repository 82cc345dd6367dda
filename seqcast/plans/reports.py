"""Comparisons between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.functions.student import with_student_above
from seqcast.functions.text import progress_line
from seqcast.sources.runs import METRICS_FIELD


def milestones(curve: DataFrame, epochs: Column) -> DataFrame:
    """Progress at the first and every tenth epoch."""
    return curve.where((F.col("epoch") % 10 == 0) | (F.col("epoch") == 1)).select(
        "run_id", "epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_loss", 6).alias("val_loss"),
        progress_line(F.col("epoch"), epochs, F.col("train_loss"), F.col("val_loss")).alias("line"))


def repeat_stats(runs: DataFrame, *by: str, value: str = "training_time_seconds") -> DataFrame:
    """Spread of a value over repeated runs of the same configuration."""
    v = F.col(value)
    return runs.groupBy(*by).agg(F.count(v).alias("runs"), F.avg(v).alias("mean"), F.min(v).alias("low"),
                                 F.max(v).alias("high"), F.stddev_samp(v).alias("spread"))


def sized(runs: DataFrame) -> DataFrame:
    """Runs with their number of processes; a single-process run, whose summary has none, counts as one."""
    return runs.withColumn("num_processes", F.coalesce("num_processes", F.lit(1)))


def _base_mean(means: DataFrame, label: str, base: object) -> Column:
    """The base's mean time, looked up once as a scalar."""
    return means.where(F.col(label) == F.lit(base)).select("seconds").scalar()


def _mean_seconds(runs: DataFrame, label: str) -> DataFrame:
    return runs.groupBy(label).agg(F.avg("training_time_seconds").alias("seconds"))


def speedup_report(runs: DataFrame, base: int = 1) -> DataFrame:
    """Mean time by world size, and how many times faster than ``base`` it is."""
    means = _mean_seconds(sized(runs), "num_processes")
    speedup = _base_mean(means, "num_processes", base) / F.col("seconds")
    return means.select("num_processes", "seconds", speedup.alias("speedup"),
                        (speedup * F.lit(base) / F.col("num_processes")).alias("efficiency"))


def storage_report(runs: DataFrame, base: str, label: str = "storage") -> DataFrame:
    """Mean time by storage, and the percentage saved against ``base``."""
    means = _mean_seconds(runs, label)
    base_mean = _base_mean(means, label, base)
    return means.select(label, "seconds", ((base_mean - F.col("seconds")) / base_mean * 100).alias("improvement"))


def accuracy_report(summaries: DataFrame) -> DataFrame:
    """Mean MAPE and RMSE by world size."""
    return sized(summaries).groupBy("num_processes").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(f"{METRICS_FIELD}.MAPE").alias("MAPE"),
        F.avg(f"{METRICS_FIELD}.RMSE").alias("RMSE"))


def equivalence_report(runs: DataFrame, value: Column, margin: float, label: str = "num_processes", base: object = 1, alpha: float = 0.05) -> DataFrame:
    """Whether runs with other labels are as good as those with ``base``: two one-sided t tests of the difference of means.

    The means count as equal if the difference lies surely within ``margin`` of the base's mean: ``p`` is the larger of the chances, were it beyond
    either side, of a difference as near to zero as that found. Variances may differ (Welch). Counts, means and variances come from one aggregate, and
    the base's are looked up once. A label with fewer than two runs, or without any spread beside the base, has no ``p``.
    """
    groups = runs.select(F.col(label), value.alias("_value")).groupBy(label).agg(
        F.count("_value").alias("runs"), F.avg("_value").alias("mean"), F.var_samp("_value").alias("variance"))
    one = groups.where(F.col(label) == F.lit(base)).select(F.struct("runs", "mean", "variance")).scalar()
    own, of_base = F.col("variance") / F.col("runs"), one["variance"] / one["runs"]
    compared = (groups.where(F.col(label) != F.lit(base))
                .select(label, "runs", "mean", (F.col("mean") - one["mean"]).alias("difference"), F.abs(one["mean"] * margin).alias("bound"),
                        F.sqrt(own + of_base).alias("error"),
                        (F.pow(own + of_base, 2) / (F.pow(own, 2) / (F.col("runs") - 1) + F.pow(of_base, 2) / (one["runs"] - 1))).alias("freedom")))
    for side, t in (("_low", F.col("bound") + F.col("difference")), ("_high", F.col("bound") - F.col("difference"))):
        compared = with_student_above(compared.withColumn("_t", t / F.nullif(F.col("error"), F.lit(0.0))), "_t", "freedom", side)
    return (compared.withColumn("p", F.when(F.col("error") > 0, F.greatest("_low", "_high"))).withColumn("equivalent", F.col("p") < alpha)
            .select(label, "runs", "mean", "difference", "freedom", "p", "equivalent"))
