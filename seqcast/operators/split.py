"""Chronological split at two calendar positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.operators.ordering import number_rows

TRAIN, VALIDATION, TEST = "train", "val", "test"


def date_profile(bars: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """The numbered calendar: distinct dates, position, and each feature's range on that date.

    One pass over the bars serves both the cut-offs and the scaler, since the train bounds
    are bounds of the dates' bounds. Rows combine on the map side, so a date that holds much
    of the table costs no more than another.
    """
    ranges = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("min", F.min), ("max", F.max))]
    daily = bars.groupBy("Date").agg(F.count(F.lit(1)).alias("rows"), *ranges)
    # Dates are counted by the hour, so that a calendar of instants is not numbered in one task.
    return number_rows(daily, "Date", cells={"hour": F.substring(F.date_format("Date", "yyyy-MM-dd HH:mm"), 1, 13)})


def cutoffs(profile: DataFrame, train_ratio: float, val_ratio: float) -> DataFrame:
    """One row: number of dates, the two cut-off positions and the dates there.

    Both cut-off dates belong to the split on their left, hence train has one date more than
    its share.
    """
    counted = profile.agg(F.count(F.lit(1)).alias("n"))

    def share(ratio: float) -> Column:
        return F.floor(F.col("n") * F.lit(float(ratio))).cast("bigint")

    placed = counted.select("n", share(train_ratio).alias("train_pos"),
                            (share(train_ratio) + share(val_ratio)).alias("val_pos"))
    at = placed.select(F.struct("n", "train_pos", "val_pos")).scalar()

    def date_at(name: str) -> Column:
        return F.max(F.when(F.col("position") == at[name], F.col("Date")))

    return profile.agg(
        date_at("train_pos").alias("train_end"), date_at("val_pos").alias("val_end"),
    ).select(at["n"].alias("n_dates"), at["train_pos"].alias("train_pos"), at["val_pos"].alias("val_pos"),
             "train_end", "val_end")


def split_name(date: Column, train_end: Column, val_end: Column) -> Column:
    return F.when(date <= train_end, TRAIN).when(date <= val_end, VALIDATION).otherwise(TEST)


def in_split(split: str, date: Column, train_end: Column, val_end: Column) -> Column:
    """The split as a range of dates, which reaches the scan as a filter."""
    if split == TRAIN:
        return date <= train_end
    if split == VALIDATION:
        return (date > train_end) & (date <= val_end)
    if split == TEST:
        return date > val_end
    raise ValueError(f"no split named {split!r}")
