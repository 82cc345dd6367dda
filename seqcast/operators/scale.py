"""Min-max scaling with bounds fitted on the train period."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A range below this counts as zero, and a zero range scales by one.
SMALLEST_RANGE = 10 * sys.float_info.epsilon


def bounds_from_profile(profile: DataFrame, train_end: Column, features: Sequence[str]) -> DataFrame:
    """One row with minimum and maximum of every feature in train, over all symbols together.

    Taken from the calendar's bounds by date, without another pass over the bars.
    """
    return profile.where(F.col("Date") <= train_end).agg(
        *[f(f"{c}_{n}").alias(f"{c}_{n}") for c in features for n, f in (("min", F.min), ("max", F.max))])


def _divisor(low: float | Column, high: float | Column) -> Column:
    width = F.lit(high) - F.lit(low)
    return F.when(width < SMALLEST_RANGE, F.lit(1.0)).otherwise(width)


def scaled(value: Column, low: float | Column, high: float | Column) -> Column:
    """Into [0, 1] for values within the bounds; others are not clipped."""
    return (value - F.lit(low)) / _divisor(low, high)


def unscaled(value: Column, low: float | Column, high: float | Column) -> Column:
    return value * _divisor(low, high) + F.lit(low)


def scale(bars: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Add ``<feature>_scaled`` for every feature in ``bounds``."""
    return bars.withColumns({f"{c}_scaled": scaled(F.col(c), *b) for c, b in bounds.items()})


def unscale(df: DataFrame, bounds: tuple[float, float], columns: Mapping[str, str]) -> DataFrame:
    """Add unscaled columns: ``columns`` maps a scaled column to the new one's name."""
    return df.withColumns({new: unscaled(F.col(old).cast("double"), *bounds) for old, new in columns.items()})


def narrowed(value: Column) -> Column:
    """The double after a trip through a 32-bit float."""
    return value.cast("float").cast("double")
